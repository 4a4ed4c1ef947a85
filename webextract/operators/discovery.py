"""Discovery of URLs: breadth-first rounds over a snapshot of answers, with retries, rate limits and a second fetcher.

A round is what lies in the queue: it is fetched by joins with the snapshot, and its pages' links and the URLs to be tried
again, in the order of one worker, are the next round. The answers of a URL are used up one by one, so a URL that was rate
limited meets its next answer when its turn comes again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import staged
from . import crawl
from .jobs import BROKEN, numbered

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class DiscoveryConfig:
    """Bounds and rules of a discovery."""

    max_pages: int | None = None
    max_retries: int = 3
    prefer_browser: bool = True
    allow_query: bool = False
    markdown_suffix: str | None = None
    force: bool = False
    #: Whether a URL in discovery form is to be visited, besides those whose paths end like files.
    accept: Callable[[Column], Column] | None = None
    #: Called after each round with the URLs found in it (url, converted); what it raises is logged.
    on_discovered: Callable[[DataFrame, int], None] | None = None
    #: Called after each round with its number and the URLs collected so far.
    on_progress: Callable[[int, int], None] | None = None


@dataclass(frozen=True)
class Discovery:
    """What was found: ``urls`` (url), collected and converted; ``log`` (round, seq, url, outcome); ``found`` (round, url,
    converted), the URLs that links led to."""

    urls: DataFrame
    log: DataFrame
    found: DataFrame


def _walked(statuses: Column, used: Column, most: int) -> Column:
    """(ok, limited, took, at) of a run of fetches over a URL's answers from ``used`` on: up to ``most`` are tried, to the
    first that is good, gone (404, 410) or an error that is not tried again."""
    s = F.slice(statuses, used + 1, most)
    final = F.transform(s, lambda x: ((x > 0) & (x < 400)) | x.isin(404, 410, BROKEN))
    at = F.array_position(final, True).cast("int")
    took = F.when(at > 0, at).otherwise(F.size(s))
    ok = F.coalesce((at > 0) & F.try_element_at(s, F.greatest(at, F.lit(1))).between(1, 399), F.lit(False))
    limited = F.exists(F.slice(s, 1, F.greatest(took, F.lit(0))), lambda x: x == 429)
    return F.struct(ok.alias("ok"), limited.alias("limited"), took.alias("took"), (used + at).alias("at"))


def _answers(snapshot: DataFrame | None, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(url, statuses in the order of attempts) and (url, attempt, html)."""
    if snapshot is None:
        snapshot = spark.createDataFrame([], "url string, attempt int, status int, html string")
    if "attempt" not in snapshot.columns:
        snapshot = snapshot.withColumn("attempt", F.lit(1))
    status = F.col("status").cast("int") if "status" in snapshot.columns else F.lit(200)
    s = snapshot.select("url", F.col("attempt").cast("int").alias("attempt"), status.alias("status"), "html")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("attempt", "status"))), lambda x: x["status"])
    return s.groupBy("url").agg(ordered.alias("statuses")), s.select("url", "attempt", "html")


def discover(
    spark: SparkSession, start_urls: DataFrame, http: DataFrame | None, config: DiscoveryConfig = DiscoveryConfig(), browser: DataFrame | None = None, recent: DataFrame | None = None
) -> Discovery:
    """Crawl from ``start_urls`` (url) over snapshots of answers (url in discovery form, html[, status, attempt from 1]).

    The preferred fetcher comes first; the other one where it had neither content nor a rate limit (for the browser: where
    it had no answer at all). A URL that was rate limited goes back to the end of the queue; other failures are forgotten,
    and tried again if a later page links there. URLs in ``recent`` (url) count as collected without a fetch, unless
    ``force``. With ``max_pages`` the queue ends as soon as so many are collected.
    """
    http_statuses, http_pages = _answers(http, spark)
    browser_statuses, browser_pages = _answers(browser, spark)
    has_browser = browser is not None
    wanted = lambda u: U.is_page(u) & (F.coalesce(config.accept(u), F.lit(False)) if config.accept else F.lit(True))
    normal = lambda c: U.discovered(F.col(c), allow_query=config.allow_query)

    def converted(url: Column, is_seed: Column) -> Column:
        return U.markdown_url(url, is_seed, config.markdown_suffix, config.allow_query)

    # In the order of the URLs as given; of those alike once normalised the first counts.
    firsts = start_urls.filter(F.col("url").isNotNull()).select(F.col("url").alias("raw"), normal("url").alias("url")).filter(F.col("url").isNotNull() & wanted(F.col("url")))
    queue = numbered(firsts.groupBy("url").agg(F.min("raw").alias("raw")), "raw").select("url", "seq", F.lit(0).alias("used"), F.lit(0).alias("browser_used"))
    queue = staged(queue, "queue")
    seeds = queue.select("url", F.lit(True).alias("is_seed"))
    visited: list[DataFrame] = []
    logs: list[DataFrame] = []
    found: list[DataFrame] = []
    collected, n = 0, 0
    while not queue.isEmpty() and (config.max_pages is None or collected < config.max_pages):
        n += 1
        # What each URL's fetches come to.
        q = queue
        if recent is not None and not config.force:
            q = q.join(recent.select("url").distinct().withColumn("known", F.lit(True)), "url", "left")
        else:
            q = q.withColumn("known", F.lit(None).cast("boolean"))
        none = F.array().cast("array<int>")
        q = q.join(http_statuses.withColumnRenamed("statuses", "http"), "url", "left").join(browser_statuses.withColumnRenamed("statuses", "browser"), "url", "left")
        retries = 1 if config.prefer_browser and has_browser else max(1, config.max_retries)
        q = q.withColumn("h", _walked(F.coalesce("http", none), F.col("used"), retries))
        # A browser's answer counts whatever its status, but for a rate limit.
        b = F.try_element_at(F.coalesce("browser", none), F.col("browser_used") + 1)
        q = q.withColumn("b", F.struct((b.isNotNull() & (b != 429)).alias("ok"), F.coalesce(b == 429, F.lit(False)).alias("limited"), b.isNotNull().cast("int").alias("took"), (F.col("browser_used") + 1).alias("at")))
        first, second = ("b", "h") if config.prefer_browser and has_browser else ("h", "b")
        done = F.col(f"{first}.ok") | F.col(f"{first}.limited")
        turn = F.when(done | F.lit(not has_browser and first == "h"), F.lit(first)).otherwise(F.lit(second))
        q = q.withColumn("by", turn).withColumn("r", F.when(F.col("by") == "h", F.col("h")).otherwise(F.col("b")))
        tried = lambda x: F.when((F.col("by") == x) | F.lit(first == x), F.col(f"{x}.took")).otherwise(0)
        outcome = F.when(F.col("known"), "skipped").when(F.col("r.ok"), "success").when(F.col("r.limited"), "limited").otherwise("failed")
        took = F.when(F.col("known"), 0).otherwise(F.lit(None))
        q = q.select(
            "url", "seq", outcome.alias("outcome"), "by", F.col("r.at").alias("at"),
            (F.col("used") + F.coalesce(took, tried("h"))).alias("used"), (F.col("browser_used") + F.coalesce(took, tried("b"))).alias("browser_used"),
        )
        q = staged(q, "fetched")
        gained = q.filter(F.col("outcome").isin("success", "skipped"))
        if config.max_pages is not None:  # what comes after the last page that is wanted stays in the queue
            last = gained.select("seq").orderBy("seq").limit(config.max_pages - collected).agg(F.count("*"), F.max("seq")).first()
            if last[0] >= config.max_pages - collected:
                q = q.filter(F.col("seq") <= last[1])
                gained = q.filter(F.col("outcome").isin("success", "skipped"))
        logs.append(q.select(F.lit(n).alias("round"), "seq", "url", "outcome"))
        collected += gained.count()
        visited.append(gained.select("url"))

        # Links of the pages, in their order, that lead to what is neither visited nor in the queue.
        pages = lambda name, rows: q.filter((F.col("outcome") == "success") & (F.col("by") == name)).join(rows.withColumnRenamed("attempt", "at"), ["url", "at"])
        answered = pages("h", http_pages).select("seq", "url", "html").unionByName(pages("b", browser_pages).select("seq", "url", "html"))
        links = crawl.extract_links(answered.select(F.col("seq").alias("page_id"), "url", "html"), only_a=False, http_only=False)
        links = links.select(F.col("page_id").alias("from_seq"), "pos", normal("link").alias("url")).filter(F.col("url").isNotNull() & wanted(F.col("url")))
        links = links.groupBy("url", "from_seq").agg(F.min("pos").alias("pos"))
        for before in visited[:-1]:
            links = links.join(before, "url", "left_anti")
        here = q.select("url", F.col("seq").alias("own_seq"), "outcome")
        links = links.join(here, "url", "left").filter(F.col("own_seq").isNull() | ((F.col("outcome") == "failed") & (F.col("own_seq") < F.col("from_seq"))))
        new = links.groupBy("url").agg(F.min(F.struct("from_seq", "pos")).alias("m")).select("url", F.col("m.from_seq").alias("from_seq"), F.col("m.pos").alias("pos"))
        new = staged(new, "found")
        found.append(new.select(F.lit(n).alias("round"), "url", converted(F.col("url"), F.lit(False)).alias("converted")))
        if config.on_discovered:
            try:
                config.on_discovered(found[-1].select("url", "converted"), n)
            except Exception as e:  # whatever the caller's function raises
                log.warning("the callback for discovered URLs failed in round %d: %s", n, e)
        if config.on_progress:
            config.on_progress(n, collected)
        again = q.filter("outcome = 'limited'").select("url", F.col("seq").alias("from_seq"), F.lit(-1).alias("pos"))
        following = numbered(new.unionByName(again), "from_seq", "pos", "url")
        # Answers that were used up before.
        spent = reduce(DataFrame.unionByName, [x.select("url", "used", "browser_used") for x in (q, *([tries] if n > 1 else []))])
        tries = staged(spent.groupBy("url").agg(F.max("used").alias("used"), F.max("browser_used").alias("browser_used")), "tries")
        queue = staged(following.select("url", "seq").join(tries, "url", "left").na.fill(0, ["used", "browser_used"]), "queue")

    if not logs:
        none = spark.createDataFrame([], "round int, seq long, url string, outcome string")
        return Discovery(none.select("url"), none, none.select("round", "url", F.col("url").alias("converted")))
    gone_through = reduce(DataFrame.unionByName, logs)
    had = gone_through.filter(F.col("outcome").isin("success", "skipped")).select("url").distinct().join(seeds, "url", "left")
    output = had.select(converted(F.col("url"), F.coalesce("is_seed", F.lit(False))).alias("url"))
    return Discovery(had.select("url").union(output).distinct(), gone_through, reduce(DataFrame.unionByName, found))


def skip_count(discovery: Discovery) -> int:
    """URLs that were skipped as recently visited."""
    return discovery.log.filter("outcome = 'skipped'").count()
