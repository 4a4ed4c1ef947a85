"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary one (tests); on a cluster there is none that all could see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="webextract-shared-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows and bytes that go to a Python worker at once, at most: texts may be long and workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, where the session's settings allow more."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(name).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    small_batches(spark)
    path = f"{shared_folder(spark)}/webextract/{name}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    return path


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing is read from any more: what was made of them has been staged itself."""
    for t in tables:
        drop_staged(t.sparkSession, t.staged_at)


_scopes: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged within the block when it ends; results must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_staged(spark, path)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read in fewer partitions than there are: for small inputs of one file, before
    work on each row. Larger inputs, streams, and what comes out of a shuffle, stay as they are."""
    if df.isStreaming:
        return df
    n, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    return df.repartition(n) if plan.execute().getNumPartitions() < n else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless their Python path has it anyway."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent.parent
    reached = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.master.startswith("local["):
        reached.add(os.path.realpath(os.getcwd()))
    if str(root) not in reached:
        folder = tempfile.mkdtemp(prefix="webextract-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/webextract", "zip", root, "webextract"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
