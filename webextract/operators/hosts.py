"""Rules of hosts as a table, joined to pages by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..plans import rules

SCHEMA = "host string, kept_tags array<string>, keeps_boilerplate boolean, moves_to array<string>, removes array<string>"


def host_rules(spark: SparkSession) -> DataFrame:
    """One row per host that has rules: tags that cleaning leaves, whether boilerplate stays, selectors of the node that is
    taken instead of the chosen one, and selectors that are removed from it."""
    hosts = sorted({*rules.KEPT_TAGS, *rules.KEEP_BOILERPLATE, *rules.MOVE_TO, *rules.REMOVE})
    rows = [(h, list(rules.KEPT_TAGS.get(h, ())), h in rules.KEEP_BOILERPLATE, list(rules.MOVE_TO.get(h, ())), list(rules.REMOVE.get(h, ()))) for h in hosts]
    return spark.createDataFrame(rows, SCHEMA)


def with_rules(pages: DataFrame, table: DataFrame) -> DataFrame:
    """Pages (url, ...) with the rules of their host; empty ones where it has none. The table has a row per host that has
    rules, and is broadcast."""
    found = pages.join(F.broadcast(table.withColumnRenamed("host", "rule_host")), U.host(F.col("url")) == F.col("rule_host"), "left")
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("kept_tags", "moves_to", "removes")}
    return found.withColumns({**lists, "keeps_boilerplate": F.coalesce("keeps_boilerplate", F.lit(False))}).drop("rule_host")


def stripped_tags(kept_tags: Column) -> Column:
    """The tags that cleaning removes where some are kept."""
    return F.array_except(F.array(*map(F.lit, rules.STRIP_TAGS)), kept_tags)
