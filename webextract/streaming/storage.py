"""A log of storage changes as an append-only table: last write wins, applied changes are archived and pruned in time."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .state import queue_stats

log = logging.getLogger(__name__)

# Changes that may wait and the age of the oldest (seconds) before the log complains, and how long applied
# changes are kept.
MOST_PENDING, MOST_AGE, RETENTION = 20, 60.0, 300.0
CHANGES = "store string, change_id string, created_at double, fingerprint string, worker string, payload binary"


@F.pandas_udf(T.StringType())
def canonical_document(text: pd.Series) -> pd.Series:
    """JSON of any depth in its compact form with sorted keys; null where it is none."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), separators=(",", ":"), sort_keys=True)
        except ValueError:
            return None

    return text.map(one)


def changes(rows: DataFrame) -> DataFrame:
    """(store, payload[, change_id, created_at, worker]) as changes: ids and times are made where they are missing, and each
    has its payload's fingerprint."""
    have = set(rows.columns)
    now = F.unix_micros(F.current_timestamp()) / 1e6
    at = F.coalesce("created_at", now) if "created_at" in have else now
    own = F.concat((at * 1e9).cast("decimal(20,0)").cast("string"), F.lit("-"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return rows.select(
        "store", (F.coalesce("change_id", own) if "change_id" in have else own).alias("change_id"), at.cast("double").alias("created_at"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("fingerprint"), (F.col("worker") if "worker" in have else F.lit(None)).cast("string").alias("worker"), F.col("payload").cast("binary").alias("payload"),
    )


@dataclass(frozen=True)
class Merged:
    """State after a merge: ``state`` (store, change_id, payload), ``processed`` changes with ``archived_at``, ``stats`` (store,
    pending, oldest_age, newest_id, too_many, too_old) as they were before it."""

    state: DataFrame
    processed: DataFrame
    stats: DataFrame


def merged(pending: DataFrame, now: float, processed: DataFrame | None = None, state: DataFrame | None = None, *, most_pending: int = MOST_PENDING, most_age: float = MOST_AGE, retention: float = RETENTION) -> Merged:
    """Apply all pending changes: of each store the last by (created_at, change_id) wins, all are archived, and archived ones
    older than ``retention`` seconds go (0 keeps all). Stores without pending changes keep their state."""
    order = F.struct("created_at", "change_id")
    last = pending.groupBy("store").agg(F.max_by(F.struct("change_id", "payload"), order).alias("l")).select("store", "l.change_id", "l.payload")
    if state is not None:
        last = last.unionByName(state.select(*last.columns).join(last.select("store"), "store", "left_anti"))
    stats = pending.groupBy("store").agg(
        F.count("*").alias("pending"), F.greatest(F.lit(0.0), F.lit(now) - F.min("created_at")).alias("oldest_age"), F.max_by("change_id", order).alias("newest_id")
    )
    stats = stats.withColumn("too_many", F.col("pending") > most_pending).withColumn("too_old", (F.col("oldest_age") > most_age) & F.lit(most_age > 0))
    archived = pending.withColumn("archived_at", F.lit(float(now)))
    if processed is not None:
        archived = processed.select(*archived.columns).unionByName(archived)
    if retention > 0:
        archived = archived.filter(F.col("archived_at") >= now - retention)
    return Merged(last, archived, stats)


class StorageLog:
    """Changes, archive and state as versions of tables under one path of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, **limits):
        self.spark, self.path, self.limits = spark, path.rstrip("/"), limits

    def append(self, rows: DataFrame) -> None:
        """Add changes; each is immutable."""
        changes(rows).write.mode("append").parquet(f"{self.path}/pending")

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    @property
    def state(self) -> DataFrame:
        return self._read("state", "store string, change_id string, payload binary")

    @property
    def processed(self) -> DataFrame:
        return self._read("processed", CHANGES + ", archived_at double")

    def stats(self, now: float) -> DataFrame:
        return queue_stats(self._pending(), now)

    def _pending(self) -> DataFrame:
        """Changes that the archive, or what was pruned from it, has not had."""
        every = self._read("pending", CHANGES)
        return every.join(self._read("applied", "change_id string"), "change_id", "left_anti").select(*every.columns)

    def merge(self, now: float) -> DataFrame:
        """Apply what is pending; the stats before it. Stores over a limit are logged as critical."""
        pending = staged(self._pending(), "pending")
        m = merged(pending, now, self.processed, self.state, **self.limits)
        stats = staged(m.stats, "stats")
        over = stats.filter("too_many or too_old")
        for r in over.orderBy("store").limit(100).collect():
            if r.too_many:
                log.critical("storage queue of %s holds %d changes", r.store, r.pending)
            if r.too_old:
                log.critical("storage queue of %s has waited %.2f s", r.store, r.oldest_age)
        state, processed = staged(m.state, "state"), staged(m.processed, "processed")
        state.write.mode("overwrite").parquet(f"{self.path}/state")
        processed.write.mode("overwrite").parquet(f"{self.path}/processed")
        pending.select("change_id").write.mode("append").parquet(f"{self.path}/applied")
        return stats
