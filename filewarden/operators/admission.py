"""Rate limiting of external calls: trailing counts, remaining calls and admission.

Calls are first counted per (api, second). The count is a partial aggregate, so an
api that makes a third of all calls still reaches a shuffle as one row per second
and task. Nothing ever collects the calls of one api.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filewarden.operators.results import as_timestamp

# Calls per window by api, the default, and the window.
API_LIMITS = {"openai": 20, "virustotal": 4}
DEFAULT_LIMIT = 10
WINDOW_SECONDS = 60

# Seconds per window chunk: bounds the rows of one window partition at chunk + window.
CHUNK_SECONDS = 3600


def api_limit(api: Column, limits: dict[str, int] | None = None, default: int = DEFAULT_LIMIT) -> Column:
    limits = API_LIMITS if limits is None else limits
    out = F.lit(default)
    for name, limit in limits.items():
        out = F.when(api == name, F.lit(limit)).otherwise(out)
    return out


def calls_per_second(calls: DataFrame) -> DataFrame:
    """`calls(api, ts)` to (api, second, calls)."""
    return calls.groupBy("api", F.unix_timestamp("ts").alias("second")).agg(F.count("*").alias("calls"))


def _with_trailing(seconds: DataFrame, value: str, window: int) -> DataFrame:
    """Add `trailing`: the sum of `value` over the `window` seconds ending with each (api, second).

    The running window is cut into chunks of time: a second also travels to the
    next chunk if it lies within `window` of it, and is dropped there afterwards.
    So one hot api spreads over many window partitions of bounded size. A second
    adds its value and takes it back one window later, so a running sum does: its
    work grows with the seconds, not with the seconds times those of a window.
    """
    chunk_seconds = max(CHUNK_SECONDS, window)
    second = F.col("second")
    chunk = F.floor(second / chunk_seconds)
    reaches_next = second % chunk_seconds >= chunk_seconds - window + 1
    ends_in = F.floor((second + window) / chunk_seconds)
    step = lambda of, at, change: F.struct(of.alias("chunk"), at.alias("at"), change.alias("change"))
    steps = F.array(
        step(chunk, second, F.col(value)),
        F.when(reaches_next, step(chunk + 1, second, F.col(value))),
        F.when(reaches_next | (ends_in == chunk), step(ends_in, second + window, -F.col(value))),
    )
    spread = seconds.select("*", chunk.alias("home"), F.explode(F.array_compact(steps)).alias("step")).select("*", "step.*")
    frame = W.partitionBy("api", "chunk").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    return (
        spread.withColumn("trailing", F.sum("change").over(frame))
        .filter((F.col("home") == F.col("chunk")) & (F.col("at") == second))
        .select(*seconds.columns, "trailing")
    )


def trailing_calls(calls: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """(api, second, calls, trailing): calls within the `window` seconds ending with each second."""
    return _with_trailing(calls_per_second(calls), "calls", window)


def with_trailing_calls(calls: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """Every call with the number of calls of its api in the window ending with its second."""
    per_second = trailing_calls(calls, window).select(
        F.col("api").alias("__api"), F.col("second").alias("__second"), F.col("trailing").alias("calls_in_window")
    )
    match = (F.col("api") == F.col("__api")) & (F.unix_timestamp("ts") == F.col("__second"))
    return calls.join(per_second, match, "left").drop("__api", "__second")


def remaining_calls(
    calls: DataFrame,
    as_of: datetime,
    limits: dict[str, int] | None = None,
    default: int = DEFAULT_LIMIT,
    window: int = WINDOW_SECONDS,
) -> DataFrame:
    """Per api: calls left in the window ending at `as_of`, and seconds until the oldest one expires."""
    now = F.unix_timestamp(as_timestamp(as_of))
    second = F.unix_timestamp("ts")
    live = (now - second < window) & (second <= now)
    counted = calls.groupBy("api").agg(
        F.count_if(live).alias("calls_in_window"), F.min(F.when(live, second)).alias("oldest")
    )
    return counted.select(
        "api",
        "calls_in_window",
        F.greatest(F.lit(0), api_limit(F.col("api"), limits, default) - F.col("calls_in_window"))
        .cast("bigint")
        .alias("remaining"),
        F.coalesce(F.greatest(F.lit(0), F.col("oldest") + window - now), F.lit(0)).cast("bigint").alias("reset_seconds"),
    )


def _with_chain(seconds: DataFrame, window: int) -> DataFrame:
    """Seconds whose calls depend on earlier decisions, and those these decisions need, with the `chain` they belong to.

    A second is over if more calls were *attempted* in the window that ends with it than the limit allows; all calls of
    other seconds are accepted, whatever was decided before. So only over seconds less than a window apart depend on
    each other: they form a chain, which starts with known state, the attempts of the window before it. All other
    seconds have no chain. The first second of a chain is carried from chunk to chunk of time, one row each.
    """
    size = max(CHUNK_SECONDS, window)
    chunk = F.floor(F.col("second") / size)
    offset = F.col("second") % size
    near = F.array_compact(
        F.array(F.when(offset < window - 1, chunk - 1), chunk, F.when(offset >= size - window + 1, chunk + 1))
    )
    spread = seconds.select("*", chunk.alias("home"), F.explode(near).alias("chunk"))
    # The nearest over seconds on both sides, one running value each way; they count if they are less than a window away.
    over_at = F.when(F.col("over"), F.col("second"))
    part, others = W.partitionBy("api", "chunk"), (W.unboundedPreceding, -1)
    last = F.last(over_at, ignorenulls=True).over(part.orderBy("second").rowsBetween(*others))
    following = F.last(over_at, ignorenulls=True).over(part.orderBy(F.desc("second")).rowsBetween(*others))
    linked = (
        spread.withColumn("last_over", last)
        .withColumn("next_over", following)
        .filter(F.col("home") == F.col("chunk"))
        .withColumn("last_over", F.when(F.col("last_over") > F.col("second") - window, F.col("last_over")))
        .withColumn("next_over", F.when(F.col("next_over") < F.col("second") + window, F.col("next_over")))
    )
    target = F.when(F.col("over"), F.col("second")).otherwise(F.col("next_over"))
    opens = F.col("last_over").isNull() | (F.col("last_over") <= target - window)
    needed = linked.withColumn("start", F.when(opens, target)).filter(target.isNotNull())
    before = W.partitionBy("api").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        needed.groupBy("api", "chunk")
        .agg(F.max("start").alias("last_start"))
        .withColumn("earlier_start", F.max("last_start").over(before))
        .select("api", "chunk", "earlier_start")
    )
    so_far = W.partitionBy("api", "chunk").orderBy("second").rowsBetween(W.unboundedPreceding, 0)
    within = needed.withColumn("start", F.max("start").over(so_far))
    return within.join(carried, ["api", "chunk"]).select(*seconds.columns, F.coalesce("start", "earlier_start").alias("chain"))


def _fold_seconds(window: int):
    """Greedy admission over rows sorted by (api, chain, second); carries at most one window of state."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, live, used = None, deque(), 0
        for batch in batches:
            accepted = []
            columns = (batch.column(c).to_pylist() for c in ("api", "chain", "second", "calls", "carried", "api_limit"))
            for api, chain, second, calls, carried, limit in zip(*columns):
                if (api, chain) != run:
                    run, live, used = (api, chain), deque(), 0
                while live and second - live[0][0] >= window:
                    used -= live.popleft()[1]
                n = min(calls, max(limit - used - carried, 0))
                if n + carried:
                    live.append((second, n + carried))
                    used += n + carried
                accepted.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("api"), batch.column("second"), batch.column("calls"), pa.array(accepted, pa.int64()), batch.column("over")],
                names=["api", "second", "calls", "accepted", "over"],
            )

    return fold


def accepted_per_second(
    calls: DataFrame,
    limits: dict[str, int] | None = None,
    default: int = DEFAULT_LIMIT,
    window: int = WINDOW_SECONDS,
    carried: DataFrame | None = None,
) -> DataFrame:
    """(api, second, calls, accepted): how many calls of each second are let through.

    A call is accepted while fewer than the limit of *accepted* calls lie in the
    window before it. That is sequential only within a chain of seconds with too
    many attempts, each less than a window after the one before; chains are spread
    over the cluster, and each is folded as a sorted stream with one window of
    state in memory. All other seconds are accepted whole where they are. What is
    left in one task is an api that stays over its limit: one row per second of
    its chain, 86 400 a day. `carried(api, second, accepted)` holds earlier
    accepted calls.
    """
    zero = F.lit(0).cast("bigint")
    seconds = calls_per_second(calls).withColumn("carried", zero)
    if carried is not None:
        earlier = carried.select("api", "second", zero.alias("calls"), F.col("accepted").alias("carried"))
        seconds = (
            seconds.unionByName(earlier)
            .groupBy("api", "second")
            .agg(F.sum("calls").alias("calls"), F.sum("carried").alias("carried"))
        )
    limit = api_limit(F.col("api"), limits, default).cast("bigint")
    tried = _with_trailing(seconds.withColumn("tried", F.col("calls") + F.col("carried")), "tried", window)
    judged = tried.withColumn("api_limit", limit).withColumn("over", (F.col("trailing") > F.col("api_limit")) & (F.col("calls") > 0))
    ordered = (
        _with_chain(judged.drop("tried", "trailing"), window)
        .repartition("api", "chain")
        .sortWithinPartitions("api", "chain", "second")
    )
    folded = ordered.mapInArrow(_fold_seconds(window), "api STRING, second BIGINT, calls BIGINT, accepted BIGINT, over BOOLEAN")
    free = judged.filter("NOT over AND calls > 0").select("api", "second", "calls", F.col("calls").alias("accepted"))
    return free.unionByName(folded.filter("over").drop("over"))


def admit(
    calls: DataFrame,
    call_id: str = "call_id",
    limits: dict[str, int] | None = None,
    default: int = DEFAULT_LIMIT,
    window: int = WINDOW_SECONDS,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Every call of `calls(call_id, api, ts)` with `accepted`; within a second, by (ts, id).

    At most `limit` calls of one second can be accepted, so only those candidates
    are ranked: the row-number filter is applied before the shuffle (window group
    limit), however many calls fall into one second.
    """
    limits = API_LIMITS if limits is None else limits
    highest = max([default, *limits.values()])
    per_second = accepted_per_second(calls, limits, default, window, carried).filter("accepted > 0")
    order = W.partitionBy("api", "second").orderBy("ts", call_id)
    candidates = (
        calls.select(call_id, "api", "ts", F.unix_timestamp("ts").alias("second"))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= highest)
    )
    admitted = (
        candidates.join(per_second.select("api", "second", F.col("accepted").alias("quota")), ["api", "second"])
        .filter(F.col("position") <= F.col("quota"))
        .select(call_id, F.lit(True).alias("accepted"))
    )
    return calls.join(admitted, call_id, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
