"""Sitemaps: tolerant parsing, and loading of indexes by iterated joins."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged


def _root(xml: str | None):
    try:
        return ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def locations(xml: pd.Series) -> pd.Series:
    """Stripped text of every loc element at any depth and of any namespace; none from malformed XML."""

    def one(x):
        root = _root(x)
        if root is None:
            return []
        return [e.text.strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] == "loc" and e.text and e.text.strip()]

    return xml.map(one)


@F.pandas_udf(T.BooleanType())
def is_index(xml: pd.Series) -> pd.Series:
    """Whether the root is a sitemapindex."""
    return xml.map(lambda x: (r := _root(x)) is not None and r.tag.rsplit("}", 1)[-1] == "sitemapindex")


def is_local(source: Column, exists: Column | None = None) -> Column:
    """Whether a source is a path rather than a URL: not http(s), and with a slash, ending in .xml, or known to exist."""
    path = source.contains("/") | source.endswith(".xml")
    return ~source.rlike("(?i)^https?://") & (path if exists is None else path | exists)


def load(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """(source) and known documents (source, xml, status) -> (source, place, url) of all sitemaps that are reached.

    Indexes are followed level by level with a join per level, until a level is empty; a document is read once for each start,
    which also ends cycles. Local indexes lead to local documents only. Documents that are missing or of status 400 and above
    give nothing. ``place`` orders the URLs of a source as a reader meets them who follows each entry at once.
    """
    good = documents.filter(F.coalesce(F.col("status"), F.lit(200)) < 400).select(F.col("source").alias("at"), is_index("xml").alias("index"), locations("xml").alias("urls"))
    good = staged(good, "sitemaps")
    level = sources.select("source", F.col("source").alias("at")).distinct().withColumn("place", F.array().cast("array<int>"))
    levels = [level]
    while True:
        here = level.join(good, "at")
        following = here.filter("index").select("source", F.col("at").alias("parent"), "place", F.posexplode("urls").alias("pos", "at"))
        # What is followed is a known document, so it exists.
        following = following.filter(~is_local(F.col("parent"), F.lit(True)) | is_local(F.col("at"), F.lit(True)))
        following = following.groupBy("source", "at").agg(F.min(F.concat("place", F.array("pos"))).alias("place"))
        for before in levels:
            following = following.join(before.select("source", "at"), ["source", "at"], "left_anti")
        level = staged(following, "sitemaps")
        if level.isEmpty():
            break
        levels.append(level)
    seen = reduce(DataFrame.unionByName, levels)
    urls = seen.join(good, "at").filter(~F.col("index")).select("source", "place", F.posexplode("urls").alias("pos", "url"))
    return urls.select("source", F.concat("place", F.array("pos")).alias("place"), "url")
