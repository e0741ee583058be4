"""Cut the lineage of an intermediate result in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_RECORDS: list[list[str]] = []

ROW, CHUNK = "_row", "_chunk"
CHUNK_BITS = 16  # 65,536 rows
MOST_BUCKETS = 100_000  # what Spark allows
# For jobs on wide rows: shuffle files go when a job ends, and a task keeps some files open
# instead of sorting rows by file. In place, rows in buckets are not moved for joins on (chunk, row).
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "4"}
IN_PLACE = WRITING | {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="opsframe-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and read it from there.

    Rows are kept as Parquet, so later passes read the columns they need only and
    losing executors cannot change what they see. Nothing is said about the order
    or the partitions of what is read back. Runs a Spark job at once. The files go
    when the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "settled")
    for paths in _RECORDS:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold inside."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions; with fewer, Spark would rather move the rows."""
    counts = [spark.conf.get(f"spark.sql.{key}", "1") for key in ("shuffle.partitions", "adaptive.coalescePartitions.initialPartitionNum")]
    return min(max(map(int, counts)), MOST_BUCKETS)


def settle_in_chunks(df: DataFrame) -> DataFrame:
    """``settle`` with two more columns: a number of each row and that of its chunk, in which
    rows lie next to each other.

    Rows are written where they are made, in buckets of chunks. Under ``IN_PLACE`` a join
    with a narrow table on both columns then moves that table only, and none of these rows.
    The table in the catalog that Spark needs for buckets is there while this runs.
    """
    spark = df.sparkSession
    path, name = scratch_folder(spark, "settled"), f"settled_{uuid.uuid4().hex}"
    for paths in _RECORDS:
        paths.append(path)
    rows = df.withColumn(ROW, F.monotonically_increasing_id()).withColumn(CHUNK, F.shiftright(ROW, CHUNK_BITS))
    try:
        rows.write.format("parquet").bucketBy(bucket_count(spark), CHUNK).options(path=path, compression="zstd").saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the checkpoint folder; what is written there goes with the session."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of all frames that are settled inside."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS[:] = [own for own in _RECORDS if own is not paths]


def discard_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders that ``recorded`` listed, those that are left."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing will read again.

    Only for frames that come straight from ``settle``: plans built on them that have
    not run yet fail afterwards.
    """
    spark = df.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    root = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if path.getName().startswith("settled-") and files.makeQualified(path.getParent()).equals(files.makeQualified(root)):
            files.delete(path, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
