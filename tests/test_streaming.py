"""Streams give what the batch run gives."""

import posts
from pyspark.sql import functions as F

from ledgerloom.functions.text import INVOICE
from ledgerloom.operators import numbering
from ledgerloom.session import shared_dir
from ledgerloom.sources import ledger
from ledgerloom.streaming import ingest


def deliver(spark, folder, rows):
    posts.frame(spark, INVOICE, rows).coalesce(1).write.mode("append").json(f"{folder}/in")
    ingest.ingest_stream(
        spark, f"{folder}/in", INVOICE, f"{folder}/ledger", f"{folder}/checkpoint",
        posts.companies(spark),
    ).awaitTermination()


def test_deliveries_equal_one_batch(spark):
    rows = [
        posts.invoice(
            i,
            f"2024-0{3 + i // 4}-1{i % 4}",
            bname=["Ann", "Bob", ""][i % 3],
            bphno1=["6000000001", ""][i % 2],
            descp=[f"good {i % 5}", "nut"],
            qty=["x", "1"] if i == 5 else ["2", "1"],
        )
        for i in range(1, 13)
    ]
    folder = shared_dir(spark, "test-stream")
    for part in (rows[:3], rows[3:4], rows[4:]):
        deliver(spark, folder, part)
    whole = shared_dir(spark, "test-batch")
    ingest.ingest_batch(posts.frame(spark, INVOICE, rows), INVOICE, whole, 0, posts.companies(spark))

    def content(path, name, columns):
        return sorted(tuple(r) for r in ledger.read_table(spark, path, name).select(columns)
                      .fillna(-1).fillna("-").collect())

    for name, columns in {
        "history": ["id", "bill_num", "billed_to", "shipped_to", "amount"],
        "history_goods": ["history_id", "line_no", "goods_id", "qty", "amount"],
        "goods": ["company_id", "id", "descp", "rate"],
        "beneficiaries": ["company_id", "id", "name", "phno1"],
    }.items():
        assert content(f"{folder}/ledger", name, columns) == content(whole, name, columns)


def test_header_stream_numbers_like_the_batch(spark, sample):
    headers = sample.headers().select("id", "company_id", "type", "bill_timestamp")
    folder = shared_dir(spark, "test-numbers")
    for low, high in (("1990-01-01", "1996-05-01"), ("1996-05-01", "1997-01-15"),
                      ("1997-01-15", "2010-01-01")):
        part = headers.where(F.col("bill_timestamp").between(low, high) & (
            F.col("bill_timestamp") < F.lit(high).cast("timestamp")))
        part.write.mode("append").parquet(f"{folder}/in")
        ingest.number_stream(
            spark, f"{folder}/in", folder, f"{folder}/checkpoint"
        ).awaitTermination()
    got = spark.read.parquet(f"{folder}/numbered").select("id", "bill_num")
    expected = numbering.number_bills(headers).select("id", "bill_num")
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
