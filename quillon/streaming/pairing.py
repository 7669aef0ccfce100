"""Mate pairing over a stream of classified reads: a pending read waits in the state of its name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ROW = "file_id string, qname string, ord long, role string, motif string, tid int, start long, end long"


def confirmed_stream(rows: DataFrame) -> DataFrame:
    """Confirmed repeat reads of a stream of classified reads (as plans.sinks.classified), with their outcome.

    Reads of a name pair in order of ord inside a trigger, and in order of triggers. The state of a name is
    one read at most. The values of emitted reads are those of the batch operator.
    """

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["ord", "role", "motif", "tid", "start", "end"]
        come = pd.concat(list(batches))[columns].sort_values("ord").astype(object).values.tolist()
        # a column with nulls comes as floats, which the state would not take for integers
        come = [[None if v is None or v != v else int(v) if isinstance(v, float) else v for v in r] for r in come]
        waiting = [list(state.get)] if state.exists else []
        queue = waiting + come
        out = []
        for a, b in zip(queue[::2], queue[1::2]):
            outcome = "paired" if a[1] == b[1] == "IRR" else "anchored"
            out += [[*key, *r, outcome] for r in (a, b) if r[1] == "IRR" and r[4] is not None]
        if len(queue) % 2:
            state.update(tuple(queue[-1]))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["file_id", "qname", *columns, "outcome"])
            yield frame.astype({"ord": "int64", "tid": "int32", "start": "int64", "end": "int64"})

    grouped = rows.groupBy("file_id", "qname")
    return grouped.applyInPandasWithState(pair, f"{_ROW}, outcome string", "ord long, role string, motif string, tid int, start long, end long", "append", GroupStateTimeout.NoTimeout)
