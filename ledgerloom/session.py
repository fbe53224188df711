"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings.  Shuffle partition counts are left to the cluster; AQE
# coalesces them and splits the partitions a hot tenant, client or good makes.  Lines take up
# to twenty times their shuffled size in the sorts of one task, so partitions are joined up to
# a quarter of Spark's default only.  Generated methods above 8,000 bytes, which wide documents
# make, are never compiled by the JVM; such stages run operator by operator instead.  Shuffle
# files go when the job that wrote them ends, so a run of many jobs never holds those of all.
RUNTIME_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


# Input bytes one shuffle partition should stand for: a few, as input is compressed and its
# rows are sorted several times in a task, up to so many partitions, and more from there on.
# At 100 TB this makes about fifty thousand partitions; queries read a few columns only, so
# each stays well below it.
BYTES_PER_PARTITION = 32 * 1024**2
PARTITIONS = 10_000
MOST_BYTES_PER_PARTITION = 2 * 1024**3


def wanted_partitions(length: int) -> int:
    """Shuffle partitions for so many bytes of input."""
    return max(min(length // BYTES_PER_PARTITION, PARTITIONS), length // MOST_BYTES_PER_PARTITION)


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """Raise the number of shuffle partitions for large inputs, never lower it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = wanted_partitions(files.getContentSummary(path).getLength())
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder the cluster names.

    Only a local session, where driver and executors share one disk, may fall back to
    a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.path.join(tempfile.gettempdir(), f"ledgerloom-{context.applicationId}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
