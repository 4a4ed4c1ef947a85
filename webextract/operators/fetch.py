"""Fetching as tables: a snapshot joined by URL, a fetch function with retries, and the choice between fetchers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import urls as U
from ..session import spread

#: url -> (html, status)
Fetch = Callable[[str], tuple[str, int]]
# Fetches of a URL at most, statuses besides 500 and above that are fetched again, polls for a stable page,
# the status of a page whose selector did not appear, and of an answer without one.
ATTEMPTS, RETRIED, POLLS, SELECTOR_TIMEOUT, UNKNOWN_STATUS = 3, (408, 429), 20, 408, 200


def from_snapshot(urls: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Wanted rows (url, ...) with html and status of their URL in a snapshot (url, html[, status]), compared in crawl form;
    both null, and ``error`` set, where the snapshot has no such page. Each wanted row is one row: of pages of one URL the first
    by URL as written, status and html counts."""
    status = F.col("status").cast("int") if "status" in snapshot.columns else F.lit(200)
    known = snapshot.select(U.normalized(F.col("url")).alias("fetch_key"), "html", status.alias("status"), F.lit(True).alias("known"), F.col("url").alias("written"))
    first = W.partitionBy("fetch_key").orderBy("written", "status", "html")
    known = known.filter(F.col("fetch_key").isNotNull()).withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth", "written")
    found = urls.withColumn("fetch_key", U.normalized(F.col("url"))).join(known, "fetch_key", "left")
    return found.withColumn("error", F.when(F.col("known").isNull(), F.concat(F.lit("Not in snapshot: "), F.coalesce("url", F.lit(""))))).drop("fetch_key", "known")


def fetch_once(fetch: Fetch, url: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int | None, str | None, int]:
    """(html, status, error, attempts used) of a URL: tried again after errors and retried statuses, with growing waits; the
    last answer counts, even a bad one."""
    answer: tuple[str | None, int | None, str | None] = (None, None, None)
    for n in range(1, attempts + 1):
        try:
            html, status = fetch(url)
            answer = (html, UNKNOWN_STATUS if status is None else int(status), None)
            if answer[1] < 500 and answer[1] not in RETRIED:
                return *answer, n
        except Exception as e:  # whatever the caller's function raises is this URL's error
            answer = (None, None, f"{e}" or type(e).__name__)
        if n < attempts:
            sleep(min(0.3 * n, 1.5))
    return *answer, attempts


def fetched(urls: DataFrame, fetch: Fetch, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url) -> (url, html, status, error, attempts) by a user's function, run where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
        for batch in batches:
            for url in batch.column(0).to_pylist():  # a row at a time: answers may be long
                got = (url, *fetch_once(fetch, url, attempts, sleep))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(got, kinds, strict=True)], names=["url", "html", "status", "error", "attempts"])

    return spread(urls.select("url").filter(F.col("url").isNotNull())).mapInArrow(run, "url string, html string, status int, error string, attempts int")


def choose_fetcher(available: Iterable[str], prefer_browser: bool = True) -> str:
    """browser or http: the preferred one if it is there, else the other."""
    have = set(available)
    for name in ("browser", "http") if prefer_browser else ("http", "browser"):
        if name in have:
            return name
    raise ImportError("no fetcher is available: give a function for 'browser' or 'http'")


def stable_pages(polls: DataFrame, most: int = POLLS) -> DataFrame:
    """(url, poll, content) -> (url, poll, content, stable): each URL's first poll that equals the one before, of ``most``
    polls; else its last."""
    w = W.partitionBy("url").orderBy("poll")
    marked = polls.withColumn("n", F.row_number().over(w)).withColumn("same", F.coalesce(F.lag("content").over(w) == F.col("content"), F.lit(False))).filter(F.col("n") <= most)
    pick = lambda c: F.struct("poll", "content", F.lit(c).alias("stable"))
    one = marked.groupBy("url").agg(F.min_by(pick(True), F.when(F.col("same"), F.col("n"))).alias("first"), F.max_by(pick(False), "n").alias("last"))
    return one.select("url", F.coalesce("first", "last").alias("p")).select("url", "p.*")


def browser_status(status: Column, selector_seen: Column) -> Column:
    """The status a browser's answer counts as."""
    return F.when(~F.coalesce(selector_seen, F.lit(True)), SELECTOR_TIMEOUT).otherwise(F.coalesce(status, F.lit(UNKNOWN_STATUS)))
