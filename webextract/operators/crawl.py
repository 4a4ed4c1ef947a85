"""Crawling over a snapshot of pages: links, admission, breadth-first rounds, results, manifests and files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import urls as U
from ..session import spread, staged
from ..sources import sitemaps
from .jobs import numbered

#: Results of a block of running counts.
PROGRESS_ROWS = 65_536


@dataclass(frozen=True)
class CrawlConfig:
    """Bounds and filters of a crawl."""

    output_dir: str = "crawl"
    seeds: tuple[str, ...] = ()
    sitemaps: tuple[str, ...] = ()
    allow_prefixes: tuple[str, ...] = ()
    deny_prefixes: tuple[str, ...] = ()
    max_pages: int = 100
    max_depth: int = 3
    concurrency: int = 5
    worker_count: int = 1
    rate_limit_delay: float = 1.0
    follow_links: bool = True


class _Hrefs(HTMLParser):
    def __init__(self, only_a: bool):
        super().__init__(convert_charrefs=True)
        self.only_a, self.found = only_a, []

    def handle_starttag(self, tag, attrs):
        if tag == "a" or not self.only_a:
            href = next((v for k, v in attrs if k == "href"), None)
            if href:
                self.found.append(href)


def hrefs(html: str, only_a: bool = True) -> list[str]:
    """href values in document order."""
    p = _Hrefs(only_a)
    p.feed(html)
    p.close()
    return p.found


def extract_links(pages: DataFrame, *, only_a: bool = True, http_only: bool = True, keep_url: bool = False) -> DataFrame:
    """(page_id, url, html) -> (page_id, pos, link): resolved links in document order, repeats included; with ``keep_url`` the
    page's url as well.

    The batch crawler takes links of ``a`` that are http(s); discovery takes every element's href. Pages that cannot be
    parsed have no links.
    """
    kinds = [pa.int64(), pa.int32(), pa.string(), *([pa.string()] if keep_url else [])]
    names = ["page_id", "pos", "link", *(["url"] if keep_url else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = 0
                try:
                    found = hrefs(html or "", only_a)
                except Exception:  # whatever the tokenizer meets in a page
                    continue
                for h in found:
                    try:
                        link = urljoin(url or "", h.strip() if http_only else h)
                        good = not http_only or urlsplit(link).scheme in ("http", "https")
                    except ValueError:
                        continue
                    if good:
                        out.append((page, n, link, url))
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(run, "page_id long, pos int, link string" + ", url string" * keep_url)


def on_seed_hosts(urls: DataFrame, seeds: DataFrame) -> DataFrame:
    """``urls`` (url) with ``same_host``: whether it is http(s) on the authority of one of ``seeds`` (url)."""
    hosts = seeds.select(U.netloc(F.col("url")).alias("seed_host")).distinct().withColumn("same_host", F.lit(True))
    found = urls.join(hosts, U.netloc(F.col("url")) == F.col("seed_host"), "left").drop("seed_host")
    return found.withColumn("same_host", F.coalesce("same_host", F.lit(False)) & U.scheme(F.col("url")).isin("http", "https"))


#: Rows of a level up to which it is numbered in one task and broadcast to its pages (its URLs and numbers).
LEVEL_ROWS = 100_000
#: (url, seq) of a level's pages -> (seq, pos, url): their links in crawl form.
Expand = Callable[[DataFrame], DataFrame]


def from_edges(edges: DataFrame) -> Expand:
    """Links from a table (src, pos, dst) of crawl forms."""
    return lambda level: level.join(edges, F.col("url") == F.col("src")).select("seq", "pos", F.col("dst").alias("url"))


def from_pages(pages: DataFrame) -> Expand:
    """Links from a snapshot (url, html): only the level's pages are parsed."""
    snapshot = pages.select(U.normalized(F.col("url")).alias("key"), F.col("url").alias("base"), "html")

    def expand(level: DataFrame) -> DataFrame:
        small = F.broadcast(level) if level.limit(LEVEL_ROWS + 1).count() <= LEVEL_ROWS else level
        here = snapshot.join(small, F.col("key") == F.col("url")).select(F.col("seq").alias("page_id"), F.col("base").alias("url"), "html")
        return extract_links(here).select(F.col("page_id").alias("seq"), "pos", U.normalized(F.col("link")).alias("url"))

    return expand


def breadth_first(
    spark: SparkSession, config: CrawlConfig, links: Expand | DataFrame, skip: DataFrame | None = None, seeds: DataFrame | None = None, sitemap_documents: DataFrame | None = None
) -> DataFrame:
    """(url, depth, parent, seq): the URLs a single worker admits, in its order.

    ``links`` gives the links of a level, or is a table of edges (src, pos, dst). Seeds, those of the configuration or
    ``seeds`` (seq, url), come first, then the URLs of the configured sitemaps, read from ``sitemap_documents`` (source, xml,
    status), then links by depth, place of their page and place on it; a URL is taken when first met, and the first
    ``max_pages`` are kept. Prefixes are compared in crawl form. A round expands the level before and anti-joins what was
    admitted; rounds are at most ``max_depth``. URLs in ``skip`` (url) are admitted but not followed.
    """
    expand = from_edges(links) if isinstance(links, DataFrame) else links
    good = U.admitted(F.col("url"), U.normal_prefixes(spark, config.allow_prefixes), U.normal_prefixes(spark, config.deny_prefixes))
    kind = "array<long>"

    def admitted(df: DataFrame, levels: list[DataFrame], count: int, depth: int) -> DataFrame:
        """The level of the new URLs among (url, place, parent), numbered on from ``count``."""
        for before in levels:
            df = df.join(before.select("url"), "url", "left_anti")
        one = df.filter(F.col("url").isNotNull() & good).groupBy("url").agg(F.min(F.struct("place", "parent")).alias("m")).select("url", "m.place", "m.parent")
        one, left = staged(one, "admitted"), max(0, config.max_pages - count)
        rows = one.count()
        if min(rows, left) <= LEVEL_ROWS:  # a top-k in one task, not a sort of all
            best = one.orderBy("place", "url").limit(left) if left < rows else one
            one = best.withColumn("seq", F.row_number().over(W.orderBy("place", "url")))
        else:
            one = numbered(one, "place", "url").filter(F.col("seq") <= left)
        return staged(one.select("url", F.lit(depth).alias("depth"), "parent", (F.col("seq") + count).alias("seq")), "frontier")

    listed = seeds.select("seq", "url") if seeds is not None else spark.createDataFrame(list(enumerate(config.seeds)), "seq long, url string")
    first = listed.select(U.normalized(F.col("url")).alias("url"), F.array(F.lit(0), "seq").cast(kind).alias("place"))
    if config.sitemaps and sitemap_documents is not None:
        sources = spark.createDataFrame(list(enumerate(config.sitemaps)), "n long, source string").groupBy("source").agg(F.min("n").alias("n"))
        found = sitemaps.load(sources.select("source"), sitemap_documents).join(sources, "source")
        first = first.unionByName(found.select(U.normalized(F.col("url")).alias("url"), F.concat(F.array(F.lit(1), "n"), "place").cast(kind).alias("place")))
    levels = [admitted(first.withColumn("parent", F.lit(None).cast("string")), [], 0, 0)]
    count = levels[0].count()
    for depth in range(1, config.max_depth + 1 if config.follow_links else 1):
        if count >= config.max_pages or levels[-1].isEmpty():
            break
        here = levels[-1].select("url", "seq") if skip is None else levels[-1].select("url", "seq").join(skip.select("url"), "url", "left_anti")
        out = expand(here).join(here.toDF("parent", "seq"), "seq").select("url", F.array("seq", "pos").cast(kind).alias("place"), "parent")
        levels.append(admitted(out, levels, count, depth))
        count += levels[-1].count()
    return reduce(DataFrame.unionByName, levels)


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, pos, dst) of a whole snapshot."""
    keyed = pages.withColumn("page_id", F.monotonically_increasing_id()).select("page_id", "url", "html")
    links = extract_links(keyed, keep_url=True)
    return links.select(U.normalized(F.col("url")).alias("src"), "pos", U.normalized(F.col("link")).alias("dst"))


def classified(success: Column, words: Column, error: Column) -> tuple[Column, Column]:
    """(status, error) of a crawled page."""
    status = F.when(success & (words > 0), "success").when(success, "skipped").otherwise("failed")
    return status, F.when(success & (words > 0), F.lit(None).cast("string")).when(success, "No content extracted").otherwise(error)


def crawl_results(articles: DataFrame, extracted_at: Column) -> DataFrame:
    """Articles as crawl results; a crawl's ``seq`` is kept where there is one."""
    status, error = classified(F.col("success"), F.col("word_count"), F.col("error"))
    path = F.when(status == "success", U.flat_filename(F.col("url")))
    seq = ["seq"] if "seq" in articles.columns else []
    return articles.select(*seq, "url", path.alias("file_path"), status.alias("status"), error.alias("error"), "warnings", "word_count", "title", "markdown", extracted_at.alias("extracted_at"))


def markdown_file(url: Column, title: Column, extracted_at: Column, words: Column, body: Column) -> Column:
    """Text of a Markdown file with its front matter."""
    return F.concat(
        F.lit("---\nurl: "), url, F.lit('\ntitle: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"\nextracted_at: '), extracted_at,
        F.lit("\nword_count: "), words.cast("string"), F.lit("\n---\n\n"), body,
    )


def markdown_texts(results: DataFrame) -> DataFrame:
    """(url, file_path, text) of the successful results."""
    text = markdown_file(F.col("url"), F.col("title"), F.col("extracted_at"), F.col("word_count"), F.col("markdown"))
    return results.filter("status = 'success'").select("url", "file_path", text.alias("text"))


class _File:
    """A file of any file system that Spark knows, written from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.out.close()

    def write(self, text: str) -> None:
        self.out.write(bytearray(text.encode()))


def write_markdown(results: DataFrame, path: str) -> DataFrame:
    """One file per successful result under ``path``; the results, of which those that could not be written have failed.

    Files are written one at a time as the rows come, so the driver holds one; a crawl has ``max_pages`` of them at most.
    For results of any number there is ``write_markdown_table``.
    """
    spark, failed = results.sparkSession, []
    for r in markdown_texts(results).toLocalIterator():
        try:
            with _File(spark, f"{path}/{r.file_path}") as f:
                f.write(r.text)
        except Exception as e:  # of the file system, through the JVM
            said = str(getattr(e, "java_exception", None) and e.java_exception.getMessage() or e)
            failed.append((r.url, f"Write failed: {said}"))
    return with_write_failures(results, spark.createDataFrame(failed, "url string, write_error string"))


def with_write_failures(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Results of which those in ``failures`` (url, write_error) have failed and have no file."""
    r = results.join(F.broadcast(failures), "url", "left")
    bad = F.col("write_error").isNotNull()
    new = {"status": F.when(bad, "failed").otherwise(F.col("status")), "error": F.when(bad, F.col("write_error")).otherwise(F.col("error")), "file_path": F.when(~bad, F.col("file_path"))}
    return r.withColumns(new).select(*results.columns)


def write_markdown_table(results: DataFrame, path: str) -> None:
    """The files' names and texts as Parquet rows."""
    markdown_texts(results).select("file_path", "text").write.mode("overwrite").parquet(path)


def counters(results: DataFrame) -> DataFrame:
    """total_pages, successful, failed, skipped."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total_pages"), n("success").alias("successful"), n("failed").alias("failed"), n("skipped").alias("skipped"))


def manifest(results: DataFrame, config: CrawlConfig, job_id: str, started_at: str, completed_at: str, seconds: float) -> DataFrame:
    """(kind, seq, json): the job's head, and the results one JSON row each, so that no row holds them all.

    ``kind`` is head or result, and ``seq`` the place in the crawl (by URL where the results have none).
    """
    top = counters(results).select(
        F.lit("head").alias("kind"), F.lit(0).cast("long").alias("seq"),
        F.to_json(F.struct(F.lit(job_id).alias("job_id"), F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"), F.lit(json.dumps(asdict(config))).alias("config"), "total_pages", "successful", "failed", "skipped", F.lit(seconds).alias("duration_seconds"))).alias("json"),
    )
    if "seq" not in results.columns:
        results = numbered(results, "url", F.xxhash64("status", "title", "word_count"))
    fields = ["url", "file_path", "status", "error", "warnings", "word_count", "title", "extracted_at"]
    rows = results.select(F.lit("result").alias("kind"), F.col("seq").cast("long").alias("seq"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
    return top.unionByName(rows)


def write_manifest(parts: DataFrame, path: str) -> None:
    """manifest.json of a crawl: the head, then all results in crawl order, one at a time."""
    head = json.loads(parts.filter("kind = 'head'").first()["json"])
    head["config"] = json.loads(head["config"])
    shown = json.dumps(head, indent=2)
    with _File(parts.sparkSession, path) as f:
        f.write(shown.removesuffix("\n}") + ',\n  "results": [')
        comma = ""
        for r in parts.filter("kind = 'result'").orderBy("seq").toLocalIterator():
            f.write(comma + "\n    " + json.dumps(json.loads(r["json"]), indent=2).replace("\n", "\n    "))
            comma = ","
        f.write("\n  ]\n}\n")


RESULT_FIELDS = "url string, file_path string, status string, error string, warnings array<string>, word_count int, title string, extracted_at string"


def load_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest as one row; None if it is missing or no manifest."""
    schema = f"job_id string, started_at string, completed_at string, total_pages int, successful int, failed int, skipped int, duration_seconds double, results array<struct<{', '.join(f.replace(' ', ':', 1) for f in RESULT_FIELDS.split(', '))}>>, config map<string,string>"
    try:
        df = spark.read.schema(schema).json(path, multiLine=True)
        return None if df.filter("job_id is not null").isEmpty() else df
    except Exception:
        return None


def render(articles: DataFrame, how: str) -> DataFrame:
    """Articles as one ``out`` column: json, markdown or text."""
    if how == "markdown":
        return articles.select("page_id", F.col("markdown").alias("out"))
    if how == "text":
        said = F.format_string("Title: %s\nAuthor: %s\nWords: %d\n\n%s", "title", F.coalesce("author", F.lit("Unknown")), "word_count", "excerpt")
        return articles.select("page_id", said.alias("out"))
    fields = [F.col("url"), F.col("title"), F.col("author").alias("byline"), F.lit("ltr").alias("dir"), F.col("content"), F.length("content").alias("length"), F.col("excerpt"), F.lit(None).cast("string").alias("siteName"), F.col("markdown"), F.col("word_count"), F.col("success")]
    return articles.select("page_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("out"))


def load_url_list(lines: DataFrame) -> DataFrame:
    """(pos, line) -> (pos, url): trimmed, without blanks and comments, each at its first place."""
    t = lines.select("pos", F.trim("line").alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    return t.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def progress(results: DataFrame, order: str) -> DataFrame:
    """Running counts over results in the order of a column: successful, failed, skipped, fetched.

    Results are numbered by a range sort and counted in blocks, to which the counts of the blocks before are added, so no
    task holds all of them.
    """
    kinds = {"successful": "success", "failed": "failed", "skipped": "skipped"}
    rows = numbered(results.select(order, "url", "status"), order, "url", name="fetched").withColumn("block", F.floor(F.col("fetched") / PROGRESS_ROWS))
    sums = rows.groupBy("block").agg(*[F.count_if(F.col("status") == s).alias(f"{n}_of") for n, s in kinds.items()])
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    before = sums.select("block", *[F.coalesce(F.sum(f"{n}_of").over(earlier), F.lit(0)).alias(f"{n}_before") for n in kinds])
    inside = W.partitionBy("block").orderBy("fetched").rowsBetween(W.unboundedPreceding, 0)
    counted = rows.withColumns({n: F.count_if(F.col("status") == s).over(inside) for n, s in kinds.items()}).join(before, "block")
    return counted.select(order, "url", "status", *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in kinds], "fetched")


def progress_rate(collected: DataFrame, at: str, started: float, every: int = 10) -> DataFrame:
    """(collected, seconds, per_second) whenever ``every`` more pages are collected, by the time ``at`` (seconds) of each."""
    n = numbered(collected.select(F.col(at).cast("double").alias("at"), F.xxhash64(*collected.columns).alias("tie")), "at", "tie", name="collected").filter(F.col("collected") % every == 0)
    seconds = F.col("at") - F.lit(float(started))
    return n.select("collected", seconds.alias("seconds"), F.when(seconds > 0, F.col("collected") / seconds).otherwise(F.lit(0.0)).alias("per_second"))
