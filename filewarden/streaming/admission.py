"""Rate limiting on a stream of calls, with Spark's keyed state.

The state of an api is one window of accepted calls, as counts per second. It lives in Spark's state store under the
checkpoint of the query, so a replayed batch starts from the state it had, and it is dropped by a timer once the
watermark is a window past its last call. Calls are decided in the order of the batches; within a batch by (ts, id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from filewarden.operators.admission import API_LIMITS, DEFAULT_LIMIT, WINDOW_SECONDS

_STATE = "seconds ARRAY<BIGINT>, accepted ARRAY<BIGINT>"


class _Window:
    """Accepted calls per second, of the last window only."""

    def __init__(self, window: int, limit: int, seconds=(), accepted=()):
        self.window, self.limit = window, limit
        self.live = dict(zip(seconds, accepted))

    def admit(self, second: int, calls: int) -> int:
        """How many of `calls` calls in a second are accepted. Seconds do not fall."""
        self.live = {s: n for s, n in self.live.items() if second - s < self.window}
        n = min(calls, max(self.limit - sum(self.live.values()), 0))
        if n:
            self.live[second] = self.live.get(second, 0) + n
        return n


def admitted_stream(
    calls: DataFrame,
    limits: dict[str, int] | None = None,
    default: int = DEFAULT_LIMIT,
    window: int = WINDOW_SECONDS,
    call_id: str = "call_id",
    late: str = "0 seconds",
) -> DataFrame:
    """The calls of a stream (call_id, api, ts) that are accepted, in append mode.

    A batch's calls must not be older than those of the batch before by more than `late`; such calls are late for the
    watermark as well. Per api and batch only the first calls of a second that the limit leaves room for are held.
    """
    limits = API_LIMITS if limits is None else limits
    fields = {f.name: f.dataType for f in calls.schema.fields}
    kind = fields[call_id]
    schema = T.StructType([T.StructField(call_id, kind), T.StructField("api", T.StringType())])

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        api = key[0]
        limit = limits.get(api, default)
        known = _Window(window, limit, *(state.get if state.exists else ()))
        counts: dict[int, int] = {}
        first: dict[int, list] = {}
        for batch in batches:
            for second, part in batch.groupby("second"):
                counts[second] = counts.get(second, 0) + len(part)
                rows = first.get(second, []) + list(zip(part["micros"].tolist(), part[call_id].tolist()))
                first[second] = sorted(rows)[:limit]
        accepted = []
        for second in sorted(counts):
            accepted += [i for _, i in first[second][: known.admit(int(second), counts[second])]]
        state.update((list(known.live), list(known.live.values())))
        latest = max([*counts, *known.live]) + window
        state.setTimeoutTimestamp(int(max(latest * 1000, state.getCurrentWatermarkMs() + 1)))
        if accepted:
            yield pd.DataFrame({call_id: accepted, "api": api})

    keyed = calls.withWatermark("ts", late).select(
        call_id, "api", "ts", F.unix_timestamp("ts").alias("second"), F.unix_micros("ts").alias("micros")
    )
    return keyed.groupBy("api").applyInPandasWithState(
        decide, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def write_admitted(admitted: DataFrame, folder: str, checkpoint: str):
    """Starts the query that appends the accepted calls to the table in `folder`; what has arrived is worked through once."""
    return (
        admitted.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def decisions(calls: DataFrame, admitted: DataFrame, call_id: str = "call_id") -> DataFrame:
    """Every call of `calls` with `accepted`, from the table of accepted calls."""
    marked = admitted.select(call_id, "api").distinct().withColumn("accepted", F.lit(True))
    return calls.join(marked, [call_id, "api"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
