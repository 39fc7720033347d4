"""Network flows: keys, retransmissions, sessions by packet count, reassembly.

Windows over flows come from :func:`running`. Only reassembly of bytes, which is sequential by nature, holds one session of
one flow in a task; :func:`sessions` bounds what a session spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe.operators.running import running

IDLE_PACKETS = 10_000
WINDOW = 1 << 20


def flow_keys(packets: DataFrame) -> DataFrame:
    """Adds ``flow``: the same text for both directions."""
    a = F.concat_ws(":", "src_ip", "src_port")
    b = F.concat_ws(":", "dest_ip", "dest_port")
    swap = (F.col("src_ip") > F.col("dest_ip")) | ((F.col("src_ip") == F.col("dest_ip")) & (F.col("src_port") > F.col("dest_port")))
    return packets.withColumn("flow", F.when(swap, F.concat_ws("-", b, a)).otherwise(F.concat_ws("-", a, b)))


def flow_table(packets: DataFrame, order: str = "event_id") -> DataFrame:
    """flow, packets, first, last and the forward direction, which is that of the first packet."""
    first = F.min_by(F.struct("src_ip", "src_port", "dest_ip", "dest_port"), order)
    rows = flow_keys(packets).groupBy("flow").agg(F.count(F.lit(1)).alias("packets"), F.min(order).alias("first"), F.max(order).alias("last"), first.alias("f"))
    return rows.select("flow", "packets", "first", "last", "f.src_ip", "f.src_port", "f.dest_ip", "f.dest_port")


def trimmed(segments: DataFrame, stream: str, order: str, seq: str, length: str) -> DataFrame:
    """Segments with what they add: ``new_seq`` and ``new_length`` after the bytes that came before in order of arrival; a
    length of 0 is a retransmission that was seen whole."""
    end = F.col(seq) + F.col(length)
    seen = running(segments, stream, order, {"_seen": ("before", end)})
    start = F.greatest(F.col(seq), F.coalesce("_seen", F.col(seq)))
    return seen.withColumn("new_seq", start).withColumn("new_length", F.greatest(end - F.col("new_seq"), F.lit(0))).drop("_seen")


def sessions(packets: DataFrame, stream: str, order: str, idle: int = IDLE_PACKETS) -> DataFrame:
    """Adds ``session``, from 1: a stream that is silent for more than ``idle`` packets of the whole capture starts anew."""
    before = running(packets, stream, order, {"_before": ("before", F.col(order))})
    fresh = before.withColumn("_new", F.when(F.col("_before").isNull() | (F.col(order) - F.col("_before") > idle), 1).otherwise(0))
    return running(fresh, stream, order, {"session": ("sum", F.col("_new"))}).drop("_before", "_new")


def reassembled(segments: DataFrame) -> DataFrame:
    """(stream, session, content, events, gaps) from id, stream, session, seq, data of TCP segments. A FIN or RST doesn't close a
    stream; its last event is the destruction at the end of input or session. ``gaps`` (at, length) are bytes that
    content lacks: what stands at or after ``at`` lies ``length`` further in the stream.

    Bytes are in order of sequence numbers: overlaps keep the first copy, gaps are filled with zeros, those above ``WINDOW`` are left
    out and listed instead, equal numbers keep their order of arrival. Empty segments, and those without a number, are only reported.
    """
    rows = segments.select("id", F.col("stream").cast("long").alias("stream"), F.col("session").cast("long").alias("session"), "seq", F.col("data").cast("binary").alias("data"))
    flow = Window.partitionBy("stream", "session").orderBy(F.col("seq").asc_nulls_last(), "id", "data")
    earlier = flow.rowsBetween(Window.unboundedPreceding, -1)
    # Ordered by number, a stream has reached the largest end of what came before, from the first segment's number on.
    end = F.when(F.octet_length("data") > 0, F.col("seq") + F.octet_length("data"))
    at = F.greatest(F.first("seq").over(flow.rowsBetween(Window.unboundedPreceding, 0)), F.max("_end").over(earlier))
    rows = rows.withColumn("_end", end).withColumns({"_n": F.row_number().over(flow), "_at": at})
    gap, start = F.col("seq") - F.col("_at"), F.greatest("_at", "seq")
    rows = rows.withColumns({"_gap": F.when(F.col("_end").isNotNull() & (gap > 0), gap), "_new": F.when(F.col("_end") > F.col("_at"), F.col("_end") - start)})
    zeros = F.when(F.col("_gap") <= WINDOW, F.col("_gap"))
    rows = rows.withColumn("_out", F.coalesce(zeros, F.lit(0)) + F.coalesce("_new", F.lit(0)))
    data = F.when(F.col("_new") == F.octet_length("data"), F.col("data")).otherwise(F.expr("right(data, int(_new))"))
    piece = F.when(zeros.isNotNull(), F.concat(F.repeat(F.lit("\0"), zeros.cast("int")).cast("binary"), data)).when(F.col("_new").isNotNull(), data)
    said = lambda what: F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{what}"))
    what = F.when(F.col("_end").isNull(), F.array(said("misc"))).when(F.col("_gap").isNotNull(), F.array(said("gap"), said("data"))).when(F.col("_new").isNull(), F.array(said("retran"))).otherwise(F.array(said("data")))
    events = F.when(F.col("_n") == 1, F.concat(F.array(said("est")), what)).otherwise(what)
    left_out = F.when(F.col("_gap") > WINDOW, F.struct(F.coalesce(F.sum("_out").over(earlier), F.lit(0)).alias("at"), F.col("_gap").alias("length")))
    rows = rows.select("stream", "session", "id", "_n", piece.alias("_piece"), events.alias("_events"), left_out.alias("_left"))
    ordered = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("_n", c))))
    got = rows.groupBy("stream", "session").agg(F.expr("listagg(_piece) within group (order by _n)").alias("content"), ordered("_events").alias("events"), ordered("_left").alias("gaps"), F.max("id").alias("id"))
    all_events = F.concat(F.flatten(F.transform("events", lambda x: x["_events"])), F.array(said("destroy")))
    return got.select("stream", "session", F.coalesce("content", F.lit(b"")).alias("content"), all_events.alias("events"), F.transform("gaps", lambda x: x["_left"]).alias("gaps"))


def datagrams(segments: DataFrame) -> DataFrame:
    """UDP: contents in order of arrival, without a queue."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "data")))
    return segments.groupBy("stream", "session").agg(F.transform(ordered, lambda x: x["data"]).alias("parts"))


def combined(packets: DataFrame, pair: str, order: str, length: str) -> DataFrame:
    """Adds ``position`` of each packet in the combined output of both directions of a stream pair."""
    done = running(packets, pair, order, {"_done": ("sum", F.col(length))})
    return done.withColumn("position", F.col("_done") - F.col(length)).drop("_done")
