"""A response cache as a table: least recently used entries go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..streaming.state import least_recently_used


class ResponseCache:
    """Answers by key, of which the ``capacity`` most recently used are kept. Each call is one step of time."""

    def __init__(self, spark: SparkSession, capacity: int = 1000, answer: str = "answer string"):
        self.spark, self.capacity, self.kind = spark, max(1, capacity), f"key string, {answer}, used_at long, place long"
        self.clear()

    def clear(self) -> None:
        self.entries, self.now = self.spark.createDataFrame([], self.kind), 0

    def size(self) -> int:
        return self.entries.count()

    def _keep(self, entries: DataFrame) -> None:
        held = least_recently_used(entries.select("key", "used_at", "place"), "key", ["used_at", "place"], self.capacity)
        self.entries = staged(entries.join(held.select("key"), "key", "left_semi"), "cache")

    def store(self, answers: DataFrame) -> None:
        """Add answers (key, answer[, place]); of one key the last by place counts."""
        self.now += 1
        place = F.col("place").cast("long") if "place" in answers.columns else F.lit(0).cast("long")
        new = answers.select("key", "answer", F.lit(self.now).cast("long").alias("used_at"), place.alias("place"))
        new = new.groupBy("key").agg(F.max_by(F.struct("answer", "used_at", "place"), "place").alias("x")).select("key", "x.*")
        self._keep(self.entries.join(new.select("key"), "key", "left_anti").unionByName(new))

    def lookup(self, requests: DataFrame) -> DataFrame:
        """Requests (key, ...) with answer and hit; a stored null reads as a miss. What is found counts as used."""
        self.now += 1
        asked = requests.select("key").distinct().withColumn("asked", F.lit(True))
        found = staged(requests.join(self.entries.select("key", "answer"), "key", "left").withColumn("hit", F.col("answer").isNotNull()), "lookup")
        now = F.when(F.col("asked") & F.col("answer").isNotNull(), F.lit(self.now).cast("long")).otherwise(F.col("used_at"))
        self.entries = staged(self.entries.join(asked, "key", "left").withColumn("used_at", now).drop("asked"), "cache")
        return found
