"""URL lists that change over time, joined to captures as of their fetch times.

Dated list entries (added, removed) become validity intervals. A capture's URL gives the keys under which an entry could
match it: its host, each domain its host ends with, and each path prefix. An equi-join on the key, with the fetch time
inside the interval, evaluates every capture against the entries active when it was fetched. Lists of a checked size are
broadcast; longer ones are joined by key with salt: a key of many captures is dealt to as many tasks as its captures need, so a host or a whole top-level domain of any
share of the captures is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import staged

#: Intervals up to which a list is broadcast (about 100 bytes each), and captures of one key that meet in a task beyond.
ROWS_TO_BROADCAST, KEY_ROWS = 200_000, 100_000
ENTRY_SCHEMA = "list string, kind string, pattern string, listed_at timestamp_ntz, action string"

#: Entries as (list, kind, pattern, date, action).
ENTRIES = (
    ("spam", "domain", "example.org", "2024-03-01", "add"),
    ("spam", "domain", "example.org", "2024-06-15", "remove"),
    ("spam", "host", "tionsh.example.net", "2024-02-10", "add"),
    ("spam", "host", "tionsh.example.net", "2024-04-20", "remove"),
    ("spam", "host", "tionsh.example.net", "2024-09-05", "add"),
    ("malware", "domain", "tiontion.example.com", "2024-01-15", "add"),
    ("malware", "domain", "tiontion.example.com", "2024-11-01", "remove"),
    ("malware", "prefix", "blog.tionble.example.com/en", "2024-05-05", "add"),
    ("adult", "prefix", "tionsh.example.net/de", "2024-01-01", "add"),
    ("adult", "prefix", "tionsh.example.net/de", "2024-07-01", "remove"),
    ("adult", "host", "m.thther.example.org", "2024-08-08", "add"),
    ("trusted", "prefix", "tionsh.example.net/fr", "2024-02-10", "allow"),
    ("trusted", "host", "blog.ththth.example.org", "2024-03-01", "allow"),
    ("trusted", "host", "blog.ththth.example.org", "2024-05-01", "remove"),
)


def url_host(url: Column) -> Column:
    """Lower-cased host without credentials and port; empty where the URL has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def match_keys(url: Column) -> Column:
    """All keys under which an entry may match the URL: kind, a colon and the pattern."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda n: F.concat(F.lit("prefix:"), host, F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, n), "/"))).otherwise("")),
    )
    return F.when(host != "", F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)))


def validity(entries: DataFrame) -> DataFrame:
    """list, action, key, specificity, valid_from, valid_to of the entries that list something.

    An entry holds from its time until the next of the same list, kind and pattern; of several at one time, a removal and
    then the greatest action counts. Entries with a null in any column hold for no time.
    """
    known = entries.dropna(subset=["list", "kind", "pattern", "listed_at", "action"])
    same = W.partitionBy("list", "kind", "pattern").orderBy("listed_at", (F.col("action") == "remove").cast("int"), "action")
    key = F.concat("kind", F.lit(":"), F.lower(F.regexp_extract("pattern", "^([^/]*)", 1)), F.regexp_replace(F.regexp_extract("pattern", "^[^/]*(.*)$", 1), "/+$", ""))
    rank = F.when(F.col("kind") == "prefix", 3).when(F.col("kind") == "host", 2).otherwise(1) * 100_000 + F.length("pattern")
    return (
        known.withColumn("valid_to", F.lead("listed_at").over(same)).filter(F.col("action") != "remove")
        .filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("listed_at")))
        .select("list", "action", key.alias("key"), rank.alias("specificity"), F.col("listed_at").alias("valid_from"), "valid_to")
    )


def filter_captures(captures: DataFrame, entries: DataFrame, *, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """One row per row of ``captures``: capture_id, url, fetched_at, n_active, list, action, blocked.

    ``n_active`` counts the active entries that match; the most specific one (prefix before host before domain, then the
    longest pattern, then an allowing action, then the list's name) decides. Nothing matches null URLs, URLs without a
    host, or captures of null time. Rows alike in all three columns are decided alike. Other columns are not read.
    """
    rows = captures.select(F.col(id_col).alias("capture_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"))
    intervals = validity(entries)
    keyed = rows.filter(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).distinct().withColumn("key", F.explode(match_keys(F.col("url"))))
    if intervals.count() <= ROWS_TO_BROADCAST:
        joined = keyed.join(F.broadcast(intervals), "key")
    else:
        # Of the listed keys, those of more captures than a task should take are few: one for each KEY_ROWS keys of captures.
        many = keyed.groupBy("key").agg(F.ceil(F.count("*") / KEY_ROWS).cast("int").alias("deals")).filter("deals > 1")
        many = staged(many.join(intervals.select("key").distinct(), "key", "left_semi"), "hot-keys")
        small = F.broadcast(many) if many.count() <= ROWS_TO_BROADCAST else many
        deals = F.coalesce("deals", F.lit(1))
        salted = intervals.join(small, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
        dealt = keyed.join(small, "key", "left").withColumn("salt", F.pmod(F.xxhash64("capture_id", "url", "fetched_at"), deals).cast("int")).drop("deals")
        joined = dealt.join(salted, ["key", "salt"])
    active = joined.filter((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    order = F.struct("specificity", (F.col("action") == "allow").alias("allows"), "list", "action")
    decided = active.groupBy("capture_id", "url", "fetched_at").agg(F.count("*").alias("n_active"), F.max(order).alias("best"))
    names = ("capture_id", "url", "fetched_at")
    decided = decided.select(*[F.col(c).alias(f"decided_{c}") for c in names], F.col("n_active").alias("active"), "best")
    on = [F.col(c).eqNullSafe(F.col(f"decided_{c}")) for c in names]
    return rows.join(decided, on[0] & on[1] & on[2], "left").select(
        *names, F.coalesce("active", F.lit(0)).alias("n_active"), F.col("best.list").alias("list"), F.col("best.action").alias("action"),
        F.coalesce(F.col("best.action") != "allow", F.lit(False)).alias("blocked"),
    )


def made_entries(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Entries for about all hosts of ``pages``, whose lists and dates follow from the host's MD5, and those of ENTRIES.

    The tables hold no lists. So the list grows with the hosts: a quarter each are spam for a while, malware with their whole
    domain, trusted in part, or adult in part, twice. Each entry comes once, however many pages a host has.
    """
    digit = lambda i: F.position(F.substring(F.md5("host"), i, 1), F.lit("0123456789abcdef")) - 1
    hosts = pages.select(url_host(F.col(url_col)).alias("host")).filter("host <> ''").distinct()
    n = (digit(1) * 16 + digit(2)).alias("n")
    hosts = hosts.select("host", n)
    domain = F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".")
    day = F.col("n")

    def entry(kind: int, name: str, match: str, pattern: Column, at: Column, action: str) -> Column:
        listed = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(at.cast("int"))
        one = F.struct(F.lit(name).alias("list"), F.lit(match).alias("kind"), pattern.alias("pattern"), listed.alias("listed_at"), F.lit(action).alias("action"))
        return F.when(F.col("n") % 4 == kind, one)

    rows = F.array(
        entry(0, "spam", "host", F.col("host"), day, "add"), entry(0, "spam", "host", F.col("host"), day + 60, "remove"),
        entry(1, "malware", "domain", F.when(F.size(F.split("host", r"\.")) >= 3, domain), day, "add"),
        entry(2, "trusted", "prefix", F.concat("host", F.lit("/en")), F.floor(day / 2), "allow"),
        entry(3, "adult", "prefix", F.concat("host", F.lit("/de")), day, "add"), entry(3, "adult", "prefix", F.concat("host", F.lit("/de")), day + 30, "remove"),
        entry(3, "adult", "prefix", F.concat("host", F.lit("/de/")), day + 90, "add"),
    )
    made = hosts.select(F.explode(F.filter(rows, lambda e: e.isNotNull())).alias("e")).select("e.*")
    fixed = pages.sparkSession.createDataFrame([tuple(e) for e in ENTRIES], "list string, kind string, pattern string, day string, action string")
    fixed = fixed.select("list", "kind", "pattern", F.col("day").cast("timestamp_ntz").alias("listed_at"), "action")
    return made.unionByName(fixed).distinct()


def fetch_time(page_id: Column) -> Column:
    """The tables hold no fetch times; the id gives one within 2024."""
    return F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.pmod(page_id * 37, F.lit(366)).cast("int"))


SQL = r"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(((page_id * 37) % 366)::INTEGER) AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (
  SELECT DISTINCT host, (strpos('0123456789abcdef', md5(host)[1]) - 1) * 16 + strpos('0123456789abcdef', md5(host)[2]) - 1 AS n FROM c WHERE host <> ''),
made AS (
  SELECT 'spam' AS list, 'host' AS kind, host AS pattern, n AS day, 'add' AS action FROM h WHERE n % 4 = 0
  UNION ALL SELECT 'spam', 'host', host, n + 60, 'remove' FROM h WHERE n % 4 = 0
  UNION ALL SELECT 'malware', 'domain', regexp_extract(host, '([^.]*[.][^.]*[.][^.]*)$', 1), n, 'add' FROM h WHERE n % 4 = 1 AND regexp_matches(host, '[.].*[.]')
  UNION ALL SELECT 'trusted', 'prefix', host || '/en', n // 2, 'allow' FROM h WHERE n % 4 = 2
  UNION ALL SELECT 'adult', 'prefix', host || '/de', n, 'add' FROM h WHERE n % 4 = 3
  UNION ALL SELECT 'adult', 'prefix', host || '/de', n + 30, 'remove' FROM h WHERE n % 4 = 3
  UNION ALL SELECT 'adult', 'prefix', host || '/de/', n + 90, 'add' FROM h WHERE n % 4 = 3),
e AS (
  SELECT DISTINCT list, kind, pattern, TIMESTAMP '2024-01-01' + to_days(day::INTEGER) AS listed_at, action FROM made
  UNION SELECT list, kind, pattern, listed_at::TIMESTAMP, action FROM (VALUES {values}) v(list, kind, pattern, listed_at, action)),
i AS (
  SELECT list, action, kind || ':' || rtrim(pattern, '/') AS key, CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END * 100000 + length(pattern) AS spec,
         listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY list, kind, pattern ORDER BY listed_at, action = 'remove', action) AS valid_to FROM e),
m AS (
  SELECT c.page_id, c.url, c.fetched_at, i.list, i.action, i.spec FROM c JOIN i
  ON i.action <> 'remove' AND i.valid_from <= c.fetched_at AND (i.valid_to IS NULL OR c.fetched_at < i.valid_to) AND (
    i.key = 'host:' || c.host
    OR (i.key LIKE 'domain:%' AND (c.host = i.key[8:] OR suffix(c.host, '.' || i.key[8:])))
    OR (i.key LIKE 'prefix:%' AND (rtrim(c.host || c.path, '/') = i.key[8:] OR starts_with(c.host || c.path, i.key[8:] || '/'))))),
b AS (
  SELECT page_id, url, fetched_at, count(*) AS n_active, max(row(spec, action = 'allow', list, action)) AS best FROM m GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched_at, coalesce(b.n_active, 0) AS n_active, b.best[3] AS list, b.best[4] AS action,
       coalesce(b.best[4] <> 'allow', false) AS blocked
FROM c LEFT JOIN b ON c.page_id = b.page_id AND c.url = b.url AND c.fetched_at = b.fetched_at
""".replace("{values}", ", ".join(str(e) for e in ENTRIES))
