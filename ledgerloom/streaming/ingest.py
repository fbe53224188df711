"""Streaming ingest: files of documents in, ledger rows out.

Each micro-batch goes through the batch run and writes folders named after it, so a
batch repeated after a failure replaces exactly what its first attempt wrote.  Numbering
follows the order of arrival; a late document takes the next number, so no watermark is
involved.  One stream at a time writes to a ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import INVOICE, QUOTATION
from ledgerloom.operators import numbering
from ledgerloom.plans import runs
from ledgerloom.sources import ledger
from ledgerloom.sources.ledger import BATCH

# Streams of different kinds number their batches in ranges of their own.
KIND_RANGE = 10**12
KIND_START = {INVOICE: 0, QUOTATION: KIND_RANGE}

LAST_BILLS = T.StructType(
    [
        T.StructField("company_id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("bill_num", T.LongType()),
        T.StructField("bill_timestamp", T.TimestampType()),
    ]
)
BILL_HEADER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("company_id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("bill_timestamp", T.TimestampType()),
    ]
)


def _other_batches(df: DataFrame, batch_id: int) -> DataFrame:
    """Everything but what an earlier attempt of this batch left behind."""
    return df.where(F.col(BATCH) != batch_id).drop(BATCH)


def last_bills(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Last bill per series before a batch.

    Every batch leaves a snapshot with one row per series, so this never reads the
    ledger, whatever its size.
    """
    earlier = [b for b in ledger.batch_ids(spark, path) if b < batch_id]
    if not earlier:
        return spark.createDataFrame([], LAST_BILLS)
    return spark.read.schema(LAST_BILLS).parquet(f"{path}/{BATCH}={earlier[-1]}")


def _store_last_bills(bills: DataFrame, seeds: DataFrame, path: str, batch_id: int) -> None:
    """Write the snapshot after a batch and drop those no repeated batch can ask for."""
    spark = bills.sparkSession
    touched = numbering.last_bill(bills)
    kept = seeds.join(touched, numbering.SERIES, "left_anti")
    kept.unionByName(touched).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
    for old in [b for b in ledger.batch_ids(spark, path) if b < batch_id][:-1]:
        ledger.delete_path(spark, f"{path}/{BATCH}={old}")


def ingest_batch(
    submissions: DataFrame,
    kind: str,
    folder: str,
    batch_id: int,
    companies: DataFrame,
    users: DataFrame | None = None,
) -> None:
    """Run one batch of documents against the ledger in ``folder`` and append it."""
    spark = submissions.sparkSession
    own = KIND_START[kind] + batch_id
    snapshots = f"{folder}/last_bills/{kind}"
    seeds = last_bills(spark, snapshots, own)
    run = runs.run_batch(
        submissions,
        kind,
        companies,
        clients=_other_batches(ledger.read_table(spark, folder, "beneficiaries"), own),
        goods=_other_batches(ledger.read_table(spark, folder, "goods"), own),
        seeds=seeds,
        stored_bills=_other_batches(ledger.read_table(spark, folder, "history"), own),
    )
    runs.append_run(run, folder, own, companies, users)
    written = ledger.read_table(spark, folder, "history").where(F.col(BATCH) == own)
    _store_last_bills(written, seeds, snapshots, own)
    runs.release(run)


def ingest_stream(
    spark: SparkSession,
    source: str,
    kind: str,
    folder: str,
    checkpoint: str,
    companies: DataFrame,
    users: DataFrame | None = None,
    max_files: int | None = None,
):
    """Ingest the JSON documents that arrived in ``source`` since the last call."""
    reader = ledger.json_submissions(spark.readStream, kind)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, kind, folder, batch_id, companies, users)

    return (
        reader.load(source)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def number_stream(
    spark: SparkSession,
    source: str,
    folder: str,
    checkpoint: str,
    max_files: int | None = None,
):
    """Number the bill headers that arrived in ``source`` since the last call."""
    reader = spark.readStream.schema(BILL_HEADER)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def handle(batch: DataFrame, batch_id: int) -> None:
        snapshots = f"{folder}/last_bills"
        seeds = last_bills(spark, snapshots, batch_id)
        target = f"{folder}/numbered/{BATCH}={batch_id}"
        numbering.number_bills(batch, seeds).write.mode("overwrite").parquet(target)
        _store_last_bills(spark.read.parquet(target), seeds, snapshots, batch_id)

    return (
        reader.parquet(source)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
