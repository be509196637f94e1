"""Session construction and durable intermediate tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lorefold")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Taken from spark.checkpoint.dir; only a local
    session without that setting (tests) gets one of its own."""
    jsc = spark.sparkContext._jsc.sc()
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = jsc.getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lorefold-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialise(df: DataFrame, name: str, partitions_by: list[str] | None = None) -> DataFrame:
    """Write df as a zstd Parquet table in the shared folder and read it back. This cuts the
    lineage: the files survive lost executors, and later plans start from a scan with known
    sizes."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partitions_by:
        writer = writer.partitionBy(*partitions_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_mark(df: DataFrame) -> str:
    """A fingerprint of the names, lengths and times of the files behind df: equal while they are unchanged."""
    conf, jvm = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df.sparkSession.sparkContext._jvm
    marks = []
    for name in sorted(df.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(name)
        status = p.getFileSystem(conf).getFileStatus(p)
        marks.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(marks).encode()).hexdigest()[:16]


def tasks_for(spark: SparkSession, n_bytes: float, per_task: float = 64e6) -> int:
    """Number of tasks for a stage that holds about per_task bytes in each."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(n_bytes // per_task) + 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the catalogue folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
