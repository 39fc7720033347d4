"""Attribute-value rows into wide tables.

Rows (entity, attribute, value) become one row per entity with exactly the declared, typed columns. Facts are reduced
before they are brought together: repeated rows count once (facts are told apart by a hash of 64 bits), a column's value is the one most rows of the entity state
(ties: the smallest). So an entity holds at most one row per column when it is shuffled, however many it had. Sorted by
entity, these rows are streamed into columnar batch builders: column indices place each value in a typed buffer whose
validity mask starts empty.

Null entities are dropped; an entity without a readable fact has a row of nulls; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.functions import values as V

# The value column, the Spark type and the Arrow type of each declared data type.
TYPES = {
    "string": ("s", T.StringType(), pa.string()),
    "bigint": ("i", T.LongType(), pa.int64()),
    "double": ("d", T.DoubleType(), pa.float64()),
    "timestamp": ("t", T.TimestampType(), pa.timestamp("us", tz="UTC")),
    "boolean": ("b", T.BooleanType(), pa.bool_()),
}
MAX_COLUMNS = 5000


def declared(columns: DataFrame, tbl: str) -> list[tuple[str, str]]:
    """(column_name, data_type) of one table, by name. They become a schema, so there may be ``MAX_COLUMNS`` at most."""
    rows = columns.filter(F.col("tbl") == tbl).select("column_name", "data_type").distinct().orderBy("column_name").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns are declared for {tbl}")
    return [(r[0], r[1]) for r in rows]


def cells(facts: DataFrame, entity: str, prop: str, value: str, columns: list[tuple[str, str]]) -> DataFrame:
    """entity, k (index of the column, -1 in one row per entity), and s, i, d, t, b of which the column's type fills one."""
    index = {name: k for k, (name, _) in enumerate(columns)}
    rows = facts.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.col(prop).alias("p"), F.col(value).alias("v"))
    if index:
        k = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in index.items() for x in kv]), F.coalesce(V.property_name(F.col("p")), F.lit(""))), F.lit(-1))
    else:
        k = F.lit(-1)
    rows = rows.select("entity", k.alias("k"), "v", F.xxhash64("p", "v").alias("fact"))
    of = lambda kind: [index[n] for n, t in columns if t == kind]
    parse = {"string": V.text_value, "bigint": V.whole_value, "double": V.real_value, "timestamp": V.time_value, "boolean": V.truth_value}
    typed = [(F.when(F.col("k").isin(of(kind)), f(F.col("v"))) if of(kind) else F.lit(None)).cast(TYPES[kind][1]).alias(TYPES[kind][0]) for kind, f in parse.items()]
    rows = rows.select("entity", "k", "fact", *typed)
    names = [x for x, _, _ in TYPES.values()]
    filled = F.coalesce(*[F.when(F.col(x).isNotNull(), True) for x in names]).isNotNull()
    # What fills nothing is one row per entity and task before anything is moved.
    rows = rows.select("entity", F.when(filled, F.col("k")).otherwise(F.lit(-1)).alias("k"), F.when(filled, F.col("fact")).alias("fact"), *names)
    # A distinct count combines repeated facts in each task and needs one exchange, by entity, column and value: a hot entity is spread.
    votes = rows.groupBy("entity", "k", *names).agg(F.count_distinct("fact").alias("n"))
    value_key = F.struct(*names)
    return votes.groupBy("entity", "k").agg(F.min(F.struct((-F.col("n")).alias("n"), value_key.alias("v"))).alias("m")).select("entity", "k", *[F.col(f"m.v.{x}").alias(x) for x in names])


class Builder:
    """Streams sorted cells into wide record batches. The cells of the last entity of a batch wait for the next."""

    def __init__(self, entity: pa.DataType, columns: list[tuple[str, str]]) -> None:
        self.columns = columns
        self.schema = pa.schema([("entity", entity), *((n, TYPES[t][2]) for n, t in columns)])

    def build(self, cells: pa.Table) -> pa.RecordBatch:
        cells = cells.combine_chunks()
        ent = cells.column("entity").combine_chunks() if isinstance(cells.column("entity"), pa.ChunkedArray) else cells.column("entity")
        if isinstance(ent, pa.ChunkedArray):
            ent = ent.chunk(0)
        codes = np.asarray(ent.dictionary_encode().indices)
        first = np.concatenate([[True], codes[1:] != codes[:-1]])
        row = np.cumsum(first) - 1
        n, k = int(row[-1]) + 1, np.asarray(cells.column("k").to_numpy())
        out = [ent.take(pa.array(np.flatnonzero(first)))]
        for index, (_, kind) in enumerate(self.columns):
            name, _, arrow = TYPES[kind]
            at = np.flatnonzero(k == index)
            valid = np.zeros(n, dtype=bool)
            valid[row[at]] = True
            got = cells.column(name).take(pa.array(at))
            if kind == "string":
                place = np.zeros(n, dtype=np.int64)
                place[row[at]] = np.arange(len(at))
                out.append(got.combine_chunks().take(pa.array(place, mask=~valid)) if len(at) else pa.nulls(n, arrow))
            elif kind == "boolean":
                buffer = np.zeros(n, dtype=bool)
                buffer[row[at]] = got.to_numpy().astype(bool)
                out.append(pa.array(buffer, mask=~valid))
            else:
                buffer = np.zeros(n, dtype=np.float64 if kind == "double" else np.int64)
                buffer[row[at]] = (got.cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()) if kind == "timestamp" else got).to_numpy()
                made = pa.array(buffer, mask=~valid)
                out.append(made.cast(arrow) if kind == "timestamp" else made)
        out = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in out]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, self.schema)], schema=self.schema)

    def stream(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            ent = held.column("entity").combine_chunks()
            ent = ent.chunk(0) if isinstance(ent, pa.ChunkedArray) else ent
            codes = np.asarray(ent.dictionary_encode().indices)
            changes = np.flatnonzero(codes[1:] != codes[:-1])
            if len(changes):
                cut = int(changes[-1]) + 1
                yield self.build(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield self.build(held)


def wide(facts: DataFrame, columns: list[tuple[str, str]], entity: str = "entity", prop: str = "property", value: str = "value") -> DataFrame:
    """One row per entity with ``columns``; the entity keeps its name and type. Other columns of ``facts`` are ignored."""
    kind = facts.schema[entity].dataType
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    if not isinstance(kind, (T.LongType, T.IntegerType, T.StringType)):
        raise TypeError(f"an entity is a string, an int or a long, not {kind.simpleString()}")
    builder = Builder(arrow, columns)
    schema = T.StructType([T.StructField("entity", kind), *(T.StructField(n, TYPES[t][1]) for n, t in columns)])
    sorted_cells = cells(facts, entity, prop, value, columns).repartition("entity").sortWithinPartitions("entity", "k")
    out = sorted_cells.mapInArrow(builder.stream, schema)
    return out.select(F.col("entity").alias(entity), *[F.col(f"`{n}`") for n, _ in columns])


def filled(table: DataFrame, entity: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(entity as text, column_name) of each cell of a wide table that is not null."""
    if not columns:
        return table.select(F.col(entity).cast("string").alias("entity"), F.lit("").alias("column_name")).limit(0)
    names = F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(n)) for n, _ in columns]))
    return table.select(F.col(entity).cast("string").alias("entity"), F.explode(names).alias("column_name"))
