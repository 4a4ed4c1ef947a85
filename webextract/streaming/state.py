"""Keyed state machines over event streams: rate limits, concurrency, logs and caches.

In batch, events are dealt by key, sorted by time and folded in one pass, so a key of any number of events takes constant
memory; in a stream the same step functions run in keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

# The host delay's start, bounds, and steps.
START_DELAY, LEAST_DELAY, MOST_DELAY = 2.0, 0.5, 120.0
#: delay, successes in a row, rate limits in a row, time of the last rate limit (negative: none)
RateState = tuple[float, int, int, float]
RATE_START: RateState = (START_DELAY, 0, 0, -1.0)


def rate_step(state: RateState, ts: float, limited: bool) -> RateState:
    """A host's delay after a success or a rate limit."""
    delay, streak, limits, last = state
    if not limited:
        streak += 1
        return (max(LEAST_DELAY, delay * 0.9), 0, 0, last) if streak >= 10 else (delay, streak, 0, last)
    gap = ts - last if last >= 0 else 1e18
    limits += 1
    delay *= 2.0 if gap < 30 else 1.5 if gap < 60 else 1.25
    if limits >= 3:
        delay *= 1.5
    return min(delay, MOST_DELAY), 0, limits, ts


#: limit, successes in a row, time of the last rate limit (negative: none)
LimitState = tuple[int, int, float]


def limit_step(state: LimitState, ts: float, limited: bool, least: int = 1, most: int = 32) -> LimitState:
    """Additive increase after 25 successes and a minute of quiet, halving on a rate limit."""
    limit, streak, last = state
    if limited:
        return max(least, limit // 2), 0, ts
    streak += 1
    if streak >= 25 and (last < 0 or ts - last >= 60) and limit < most:
        return limit + 1, 0, last
    return limit, streak, last


def fold(events: DataFrame, start: tuple, step: Callable, schema: str) -> DataFrame:
    """(key, ts double, seq, limited) -> (key, ts, seq, state...) after each event, in order of ts and seq for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), start
        for batch in batches:
            out = []
            for k, ts, seq, limited in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, state = k, start
                state = step(state, ts, limited)
                out.append((k, ts, seq, *state))
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=arrow, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(f"key long, ts double, seq long, {schema}")
    arrow, names = to_arrow_schema(kind), kind.names
    return events.select("key", "ts", "seq", "limited").repartition("key").sortWithinPartitions("key", "ts", "seq").mapInArrow(run, kind)


def rate_fold(events: DataFrame) -> DataFrame:
    """Host delays after every event."""
    return fold(events, RATE_START, rate_step, "delay double, streak int, limits int, last_limit double")


def limit_fold(events: DataFrame, start: int = 4) -> DataFrame:
    """Concurrency limits after every event."""
    return fold(events, (start, 0, -1.0), limit_step, "limit int, streak int, last_limit double")


def rate_stream(events: DataFrame, keep: str = "10 minutes") -> DataFrame:
    """The same delays over a stream with a timestamp column ``at``: one row per key and micro-batch.

    Events of a micro-batch are put in order by key; the watermark ends the state of keys that have been quiet.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else RATE_START
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for ts, limited in zip(rows.ts, rows.limited, strict=True):
            now = rate_step(now, float(ts), bool(limited))
        state.update(now)
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 600_000)
        yield pd.DataFrame({"key": [key[0]], "delay": [now[0]], "streak": [now[1]], "limits": [now[2]]})

    return events.withWatermark("at", keep).groupBy("key").applyInPandasWithState(
        update, "key long, delay double, streak int, limits int", "delay double, streak int, limits int, last_limit double", "append", GroupStateTimeout.EventTimeTimeout
    )


def recent_limit_share(events: DataFrame, seconds: int = 300, ring: int = 100) -> DataFrame:
    """(key, ts, seq, limited) -> with share: of the key's last ``ring`` events, those of the last seconds that were limited.

    Both frames end at the event, so what they have in common is the shorter one: running counts at its two ends give the
    share, and nothing is gathered.
    """
    w = W.partitionBy("key").orderBy("ts", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    one = F.when(F.col("limited"), 1).otherwise(0)
    # Events and limited ones up to this one, and up to those that the time frame and the ring leave out.
    held = events.withColumn("n", F.row_number().over(w)).withColumn("all_limited", F.sum(one).over(upto))
    in_ring = F.struct(F.least(F.col("n"), F.lit(ring)).alias("n"), F.sum(one).over(w.rowsBetween(-(ring - 1), 0)).alias("limited"))
    old = F.struct("n", "all_limited")
    near = W.partitionBy("key").orderBy("micros").rangeBetween(W.unboundedPreceding, -seconds * 1_000_000)
    held = held.withColumn("micros", F.round(F.col("ts") * 1e6).cast("long")).withColumn("in_ring", in_ring).withColumn("old", F.max(old).over(near))
    in_time = F.struct((F.col("n") - F.coalesce("old.n", F.lit(0))).alias("n"), (F.col("all_limited") - F.coalesce("old.all_limited", F.lit(0))).alias("limited"))
    held = held.withColumn("recent", F.when(F.col("n") - F.coalesce("old.n", F.lit(0)) < ring, in_time).otherwise(F.col("in_ring")))
    share = F.when(F.col("recent.n") > 0, F.col("recent.limited") / F.col("recent.n")).otherwise(F.lit(0.0))
    return held.select("key", "ts", "seq", "limited", share.alias("share"))


def ring(events: DataFrame, size: int = 100) -> DataFrame:
    """The last ``size`` events of each key."""
    w = W.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("place_from_end", F.row_number().over(w)).filter(F.col("place_from_end") <= size).drop("place_from_end")


def host_stats(events: DataFrame, now: float | None = None, seconds: int = 300, size: int = 100) -> DataFrame:
    """(key, ts, seq, limited) -> (key, requests, limits, delay, recent_share) after all events; the recent share is that of
    the ring's events of the last seconds before ``now``, by default each key's last event."""
    last = rate_fold(events).groupBy("key").agg(F.max_by("delay", F.struct("ts", "seq")).alias("delay"))
    totals = events.groupBy("key").agg(F.count("*").alias("requests"), F.count_if("limited").alias("limits"), F.max("ts").alias("last_ts"))
    since = F.lit(float(now)) if now is not None else F.col("last_ts")
    recent = ring(events, size).join(totals.select("key", "last_ts"), "key").filter(F.col("ts") > since - seconds)
    share = recent.groupBy("key").agg((F.count_if("limited") / F.count("*")).alias("recent_share"))
    return totals.drop("last_ts").join(last, "key").join(share, "key", "left").na.fill(0.0, ["recent_share"])


def stable_snapshots(snapshots: DataFrame, key: str, order: list[str], fingerprint: str) -> DataFrame:
    """Snapshots whose fingerprint equals the key's one before: the page has come to rest."""
    w = W.partitionBy(key).orderBy(*order)
    return snapshots.withColumn("before", F.lag(fingerprint).over(w)).filter(F.col("before") == F.col(fingerprint)).drop("before")


def jittered(delay: Column, chance: Column) -> Column:
    """A delay times 0.8 to 1.2, by a chance from 0 to 1."""
    return delay * (F.lit(0.8) + F.lit(0.4) * chance)


def one_after_another(requests: DataFrame) -> DataFrame:
    """(key, ts, seq, delay) -> start: a request starts its own delay after the one before it of the same lock, or when it comes.

    start_n = max(ts_n, start_(n-1) + delay_n) = S_n + max over i <= n of (ts_i - S_i), S the running sum of delays. One lock
    is one line of requests by nature; ``key`` names it (a crawl, or a host).
    """
    w = W.partitionBy("key").orderBy("ts", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    waits = requests.withColumn("waits", F.sum("delay").over(upto))
    return waits.withColumn("start", F.max(F.col("ts") - F.col("waits")).over(upto) + F.col("waits")).drop("waits")


def last_writes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key: an aggregation, combined before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, "last.*")


def queue_stats(changes: DataFrame, now: float) -> DataFrame:
    """pending, oldest_age and newest_id of a change log (change_id, created_at)."""
    return changes.agg(
        F.count("*").alias("pending"), F.greatest(F.lit(0.0), F.lit(now) - F.min("created_at")).alias("oldest_age"),
        F.max_by("change_id", F.struct("created_at", "change_id")).alias("newest_id"),
    )


def changed_only(snapshots: DataFrame, key: str, order: list[str], fingerprint: str) -> DataFrame:
    """Snapshots whose fingerprint differs from the key's one before."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.lag(fingerprint).over(w)
    return snapshots.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col(fingerprint))).drop("before")


def least_recently_used(accesses: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Keys that a cache of ``size`` holds after all accesses: a top-k of the keys' last accesses."""
    last = accesses.groupBy(key).agg(F.max(F.struct(*order)).alias("last"))
    return last.orderBy(F.desc("last")).limit(max(1, size)).select(key, "last.*")


def throttled(requests: DataFrame, delay: float) -> DataFrame:
    """(key, ts, seq) -> start: a request waits until ``delay`` after the one before it of its key.

    start_n = max(ts_n, start_(n-1) + delay) = n * delay + max over i <= n of (ts_i - i * delay), a running maximum.
    """
    w = W.partitionBy("key").orderBy("ts", "seq")
    n = F.row_number().over(w)
    best = F.max(F.col("ts") - F.col("n") * delay).over(w.rowsBetween(W.unboundedPreceding, 0))
    return requests.withColumn("n", n).withColumn("start", best + F.col("n") * delay).drop("n")


def compaction_stream(changes: DataFrame, key: str, order: list[str], path: str, checkpoint: str):
    """Append-only changes to a table of last writes, one version per micro-batch under ``path``."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = last_writes(batch, key, order)
        if epoch > 0:
            before = spark.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1}")
            now = last_writes(before.unionByName(now.select(*before.columns)), key, order)
        now.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
