"""Extract articles from pages, or crawl a snapshot: ``python -m webextract extract|crawl ...``"""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import urls as U
from .operators import article, crawl
from .plans import config, observe, rules
from .session import new_path, staged, staging, table
from .sources import html

# Exit codes.
DONE, FAILED, INTERRUPTED = 0, 1, 130


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="webextract")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="article of HTML files, or of standard input")
    e.add_argument("--file", help="path or glob of HTML files")
    e.add_argument("--stdin", action="store_true", help="read standard input, as without --file")
    e.add_argument("--url", default="", help="base URL of standard input")
    e.add_argument("-o", "--output", choices=("json", "markdown", "text"), default="json")
    e.add_argument("--min-words", type=int, default=rules.MIN_WORDS_SERVED)
    e.add_argument("--no-images", action="store_true", help="told apart in caches only")
    e.add_argument("--no-code", action="store_true", help="told apart in caches only")
    c = sub.add_parser("crawl", help="breadth-first crawl over a snapshot of pages")
    c.add_argument("--snapshot", required=True, help="folder that holds pages.parquet (page_id, url, html[, status])")
    c.add_argument("--seed", action="append", default=[], help="URL to start from; may be repeated")
    c.add_argument("--sitemap", action="append", default=[], help="sitemap to start from, in the folder's sitemaps.parquet (source, xml, status)")
    c.add_argument("--output-dir", "-o", required=True)
    c.add_argument("--allow-prefix", action="append", default=[], help="admit only URLs that start so")
    c.add_argument("--deny-prefix", action="append", default=[], help="admit no URLs that start so")
    c.add_argument("--max-pages", type=int, default=100)
    c.add_argument("--max-depth", type=int, default=3)
    c.add_argument("--concurrency", type=int, default=5, help="noted in the manifest; Spark's cores decide")
    c.add_argument("--rate-limit", type=float, default=1.0, help="seconds between requests to a host, noted in the manifest")
    c.add_argument("--workers", type=int, default=1, help="noted in the manifest")
    follow = c.add_mutually_exclusive_group()
    follow.add_argument("--follow-links", dest="follow_links", action="store_true", default=True)
    follow.add_argument("--no-follow-links", dest="follow_links", action="store_false")
    for x in (e, c):
        x.add_argument("--log-level", default=os.environ.get("WEBEXTRACT_LOG_LEVEL"))
        x.add_argument("--log-format", default=os.environ.get("WEBEXTRACT_LOG_FORMAT"))
    a = p.parse_args(argv)
    if a.command == "crawl" and not a.seed and not a.sitemap:
        p.error("a crawl needs --seed or --sitemap")
    return a


def _extract(spark: SparkSession, a: argparse.Namespace) -> int:
    pages = html.read_html_files(spark, a.file).withColumn("page_id", F.xxhash64("url")) if a.file else html.page_of(spark, sys.stdin.read(), a.url)
    options = article.Options(min_words=a.min_words, images=not a.no_images, code=not a.no_code)
    articles = staged(article.extract_articles(pages, options), "articles")
    for r in crawl.render(articles, a.output).toLocalIterator():
        print(r.out)
    return DONE if not articles.filter(F.col("success")).isEmpty() else FAILED


def _crawl(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        config.check_output_dir(a.output_dir)
    except ValueError as e:
        print(e, file=sys.stderr)
        return FAILED
    if not config.has_space(a.output_dir):
        print(f"little space is left in {a.output_dir}", file=sys.stderr)
    options = crawl.CrawlConfig(a.output_dir, tuple(a.seed), tuple(a.sitemap), tuple(a.allow_prefix), tuple(a.deny_prefix), a.max_pages, a.max_depth, a.concurrency, a.workers, a.rate_limit, a.follow_links)
    began, started = time.time(), datetime.now(UTC).isoformat()
    pages = table(spark, a.snapshot, "pages")
    sitemaps = table(spark, a.snapshot, "sitemaps") if a.sitemap else None
    found = crawl.breadth_first(spark, options, crawl.from_pages(pages), sitemap_documents=sitemaps)
    status = "status" if "status" in pages.columns else None
    known = pages.withColumn("url", U.normalized(F.col("url"))).join(found.select("url", "seq"), "url").withColumn("page_id", F.col("seq"))
    got = article.extract_articles(known, status_col=status).withColumnRenamed("page_id", "seq")
    got = got.dropDuplicates(["seq"])  # a page that the snapshot has twice
    results = staged(crawl.crawl_results(got, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")), "results")
    results = crawl.write_markdown(results, a.output_dir)
    parts = crawl.manifest(results, options, new_path(spark, "crawl").rsplit("-", 1)[-1], started, datetime.now(UTC).isoformat(), round(time.time() - began, 3))
    crawl.write_manifest(parts, f"{a.output_dir}/manifest.json")
    n = crawl.counters(results).first()
    print(f"{n.total_pages} pages: {n.successful} written, {n.failed} failed, {n.skipped} skipped")
    return DONE if n.successful else FAILED


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    observe.setup_logs("cli", config.as_level(a.log_level), config.as_format(a.log_format, "text"))
    spark = SparkSession.builder.appName("webextract").getOrCreate()
    try:
        with staging(spark):
            return _extract(spark, a) if a.command == "extract" else _crawl(spark, a)
    except KeyboardInterrupt:
        return INTERRUPTED


if __name__ == "__main__":
    sys.exit(main())
