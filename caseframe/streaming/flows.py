"""Sessions of flows by packet count as a stateful stream: state per stream is the last packet id and the session number, so
it doesn't grow with the stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream long, id long, session long"
STATE = "last long, session long"


def _number(idle: int):  # noqa: ANN202
    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, session = state.get if state.exists else (None, 0)
        for rows in batches:
            rows = rows.sort_values("id")
            numbers = []
            for i in rows["id"]:
                if last is None or i - last > idle:
                    session += 1
                last = i if last is None else max(last, i)
                numbers.append(session)
            yield pd.DataFrame({"stream": key[0], "id": rows["id"].to_numpy(), "session": numbers})
        state.update((int(last), int(session)))

    return each


def sessions(packets: DataFrame, idle: int) -> DataFrame:
    """(stream, id, session) of a stream of (stream, id): a stream that is silent for more than ``idle`` packets starts anew.
    Packets of later batches are taken to come later; the caller orders batches."""
    return packets.groupBy("stream").applyInPandasWithState(_number(idle), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
