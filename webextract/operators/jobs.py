"""Crawl jobs as tables: life cycle from events, admission, joins with results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: A job's states, in the order in which it goes through them.
STATES = ("queued", "running", "completed", "failed")


def job_states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs (job_id) with the status of their last event (job_id, at, status): queued where there is none; events of unknown
    jobs or statuses are left out."""
    last = events.filter(F.col("status").isin(*STATES)).groupBy("job_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    return jobs.join(last, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("queued")))


def can_start(states: DataFrame, most_running: int) -> DataFrame:
    """running, can_start"""
    n = states.agg(F.count_if(F.col("status") == "running").alias("running"))
    return n.withColumn("can_start", F.col("running") < most_running)


def with_results(states: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with the counts of their results, zero where there are none."""
    n = lambda s: F.count_if(F.col("result") == s).alias(s)
    counts = results.groupBy("job_id").agg(n("success"), n("failed"), n("skipped"))
    return states.join(counts, "job_id", "left").na.fill(0, ["success", "failed", "skipped"])


def response_cache(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (key) with the stored answer of their key and whether it was a hit; a stored null reads as a miss. Each request
    is one row: of answers (key, answer[, place]) of one key the last by place counts, or the greatest where there is none."""
    last = F.max_by("answer", "place") if "place" in stored.columns else F.max("answer")
    return requests.join(stored.groupBy("key").agg(last.alias("answer")), "key", "left").withColumn("hit", F.col("answer").isNotNull())


def requeued(fetched: DataFrame) -> DataFrame:
    """(url, status) -> the URLs of the next round: rate-limited and not fetched otherwise."""
    ok = fetched.groupBy("url").agg(F.max((F.col("status") < 400).cast("int")).alias("ok"), F.max((F.col("status") == 429).cast("int")).alias("limited"))
    return ok.filter("ok = 0 and limited = 1").select("url")


#: What stands for a status where a fetch ended without one: connection or read timeout, any other error.
TIMED_OUT, BROKEN = 0, -1


def retry_plan(status: Column, attempt: Column, host_delay: Column) -> tuple[Column, Column]:
    """(action, wait) of a discovery fetch: done, gone (404, 410), retry after a wait, or stop (any other error than a timeout)."""
    action = F.when(status == BROKEN, "stop").when(status == TIMED_OUT, "retry").when(status < 400, "done").when(status.isin(404, 410), "gone").otherwise("retry")
    wait = F.when(status == 429, host_delay).when(status.isin(403, 503), 5.0 * attempt).when(status == 0, host_delay * attempt).otherwise(0.0)
    return action, wait


def numbered(df: DataFrame, *order, name: str = "seq") -> DataFrame:
    """``df`` with its rows numbered from 1 in the order given, which must be strict: a range sort, whose partitions are
    numbered from where the ones before them end, so no task holds more than its range."""
    made = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    columns = df.columns
    own = staged(df.orderBy(*order).withColumn(name, made), "numbered").withColumn("part_of_order", F.shiftright(name, 33))
    offsets, n = [], 0
    for part, rows in sorted(own.groupBy("part_of_order").count().collect()):
        offsets.append((part, n))
        n += rows
    before = df.sparkSession.createDataFrame(offsets, "part_of_order long, rows_before long")
    at = F.col("rows_before") + F.col(name).bitwiseAND((1 << 33) - 1) + 1
    return own.join(F.broadcast(before), "part_of_order").select(*columns, at.alias(name))


def ordered_seeds(seeds: DataFrame) -> DataFrame:
    """(url) -> (url, seq): sorted, each once."""
    return numbered(seeds.filter(F.col("url").isNotNull()).select("url").distinct(), "url").select("url", F.col("seq").cast("int").alias("seq"))
