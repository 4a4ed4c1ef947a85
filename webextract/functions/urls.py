"""URL functions as columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import rules

#: scheme, authority, path, query, fragment
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, i: int) -> Column:
    """Part ``i`` of SPLIT, empty where absent."""
    return F.coalesce(F.regexp_extract(url, SPLIT, i), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def _with_query(q: Column) -> Column:
    return F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")


def _or_root(p: Column) -> Column:
    return F.when(p == "", "/").otherwise(p)


def normalized(url: Column) -> Column:
    """Crawl form: http:// where no scheme is given, lower-cased scheme and host, a path, no fragment; null if invalid."""
    t = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    t = F.when(scheme(t) == "", F.concat(F.lit("http://"), t)).otherwise(t)
    out = F.concat(scheme(t), F.lit("://"), F.lower(netloc(t)), _or_root(path(t)), _with_query(query(t)))
    return F.when((t != "http://") & (netloc(t) != ""), out)


def discovered(url: Column, allow_query: bool = False) -> Column:
    """Discovery form of http(s) URLs: no fragment, the query only if allowed, the host's case kept; null otherwise."""
    q = _with_query(query(url)) if allow_query else F.lit("")
    return F.when(scheme(url).isin("http", "https"), F.concat(scheme(url), F.lit("://"), netloc(url), _or_root(path(url)), q))


def stripped(url: Column) -> Column:
    """Without credentials, query and fragment; unchanged where scheme or host is missing."""
    host = F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(netloc(url), r":0*([1-9][0-9]*)$", 1)
    place = F.concat(host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""))
    return F.when((scheme(url) == "") | (host == ""), url).otherwise(F.concat(scheme(url), F.lit("://"), place, _or_root(path(url))))


def stable_hash(url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the stripped URL."""
    return F.substring(F.sha2(stripped(url), 256), 1, 16)


def host(url: Column) -> Column:
    """Lower-cased authority without one leading www."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def host_key(url: Column) -> Column:
    """Lower-cased authority, or null."""
    return F.nullif(F.lower(netloc(url)), F.lit(""))


def flat_filename(url: Column) -> Column:
    """host__path__parts.md"""
    p = F.regexp_replace(path(url), "^/+|/+$", "")
    p = F.when(p == "", "index").otherwise(p)
    p = F.concat(p, F.when(query(url) != "", F.concat(F.lit("_"), query(url))).otherwise(""))
    slug = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\-]", "_"), "_+", "_"), "^_+|_+$", "")
    slugs = F.filter(F.transform(F.split(p, "/"), slug), lambda s: s != "")
    name = F.when(F.size(slugs) > 0, F.array_join(slugs, "__")).otherwise("index")
    return F.concat(F.regexp_replace(F.lower(netloc(url)), ":", "_"), F.lit("__"), name, F.lit(".md"))


def markdown_url(url: Column, is_seed: Column, suffix: str | None = ".md", allow_query: bool = False) -> Column:
    """The Markdown variant of a page's URL: its .html or .htm replaced, other extensions kept as they are."""
    if not suffix:
        return url
    p = F.regexp_replace(_or_root(path(url)), "/+$", "")
    ext = F.lower(F.regexp_extract(p, r"\.([^./]*)$", 1))
    dotted = F.regexp_extract(p, r"([^/]*)$", 1).contains(".")
    html = ext.isin("html", "htm")
    base = F.when(dotted & html, F.regexp_replace(p, r"\.[^./]*$", "")).otherwise(p)
    new = F.when(p.endswith(suffix), p).otherwise(F.concat(base, F.lit(suffix)))
    q = _with_query(query(url)) if allow_query else F.lit("")
    keep = is_seed | (p == "") | (dotted & ~html & ~p.endswith(suffix))
    return F.when(keep, url).otherwise(F.concat(scheme(url), F.lit("://"), netloc(url), new, q))


def is_page(url: Column) -> Column:
    """Whether the path ends like a page rather than a file."""
    return ~F.lower(path(url)).rlike(r"\.(" + rules.either(rules.NOT_PAGES) + ")$")


def is_safe(url: Column) -> Column:
    """Whether the URL cannot run code."""
    t = F.lower(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""))
    return ~(t.startswith("javascript:") | t.startswith("vbscript:") | t.startswith("data:text/html"))


def admitted(url: Column, allow: list[str], deny: list[str]) -> Column:
    """Whether a normalised URL starts with one of ``allow`` (if any) and none of ``deny``."""
    starts = lambda prefixes: F.coalesce(*[F.when(url.startswith(p), True) for p in prefixes], F.lit(False))
    return (starts(allow) if allow else F.lit(True)) & ~(starts(deny) if deny else F.lit(False))


def normal_prefixes(spark: SparkSession, prefixes: Iterable[str]) -> list[str]:
    """Prefixes in the crawl form of URLs; invalid ones are left out."""
    rows = spark.createDataFrame([(p,) for p in prefixes], "p string").select(normalized(F.col("p")).alias("p")).collect()
    return [r.p for r in rows if r.p]


def on_hosts(url: Column, hosts: Iterable[str]) -> Column:
    """Whether an http(s) URL's authority is one of ``hosts``."""
    return scheme(url).isin("http", "https") & netloc(url).isin(*hosts)


def log_context(url: Column) -> Column:
    """url and url_hash for logs, without credentials and query; an empty map where there is no URL."""
    there = F.coalesce(url, F.lit("")) != ""
    return F.when(there, F.create_map(F.lit("url"), stripped(url), F.lit("url_hash"), stable_hash(url))).otherwise(F.create_map().cast("map<string,string>"))


def bypasses_proxy(host_port: Column, patterns: list[str]) -> Column:
    """Whether a host is on the bypass list: *, .suffix, *suffix, host:port (by host) or the exact name; no host always is."""
    h = F.lower(host_port)
    out = h.isNull() | (h == "")
    for p in (x.strip().lower() for x in patterns):
        if p == "*":
            out = out | F.lit(True)
        elif p.startswith("."):
            out = out | h.endswith(p[1:])
        elif p.startswith("*"):
            out = out | h.endswith(p[1:])
        elif p.count(":") == 1:
            out = out | (h == p.split(":")[0]) | (h == p)
        elif p:
            out = out | (h == p)
    return F.coalesce(out, F.lit(True))


@F.pandas_udf(T.StringType())
def title_of_path(urls: pd.Series) -> pd.Series:
    """Last path segment in title case, apostrophes and digits starting words; null for the root."""

    def one(p: str | None) -> str | None:
        return None if not p or p == "/" else p.strip("/").split("/")[-1].replace("-", " ").replace("_", " ").title()

    return urls.map(one)


def title_from_url(url: Column) -> Column:
    """Title made from the URL's path."""
    return title_of_path(path(url))


@F.pandas_udf(T.StringType())
def resolved(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(base, reference) -> absolute URL by RFC 3986; the reference itself where it cannot be resolved."""

    def one(base: str | None, ref: str | None) -> str | None:
        if ref is None:
            return None
        try:
            return urljoin(base or "", ref)
        except ValueError:
            return ref

    for base, ref in parts:
        yield pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def absolute_srcset(base: str, srcset: str) -> str:
    """A srcset with each candidate's URL resolved."""
    out = []
    for item in srcset.split(","):
        words = item.split()
        if words:
            out.append(" ".join([urljoin(base, words[0]), *words[1:]]))
    return ", ".join(out)


@F.pandas_udf(T.StringType())
def resolved_srcset(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(base, srcset) -> the srcset with absolute URLs; as it is where one cannot be resolved."""

    def one(base: str | None, srcset: str | None) -> str | None:
        try:
            return None if srcset is None else absolute_srcset(base or "", srcset)
        except ValueError:
            return srcset

    for base, srcset in parts:
        yield pd.Series([one(b, s) for b, s in zip(base, srcset, strict=True)], dtype=object)


def cache_key(url: Column, min_words: int = rules.MIN_WORDS, min_chars: int = 500, images: bool = True, code: bool = True, safe: bool = True) -> Column:
    """Key of a response cache."""
    return F.concat_ws("|", url, *[F.lit(str(int(x))) for x in (min_words, min_chars, images, code, safe)])
