"""Registrations and stored updates, batch by batch, into the ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import overlay, registry
from ledgerloom.plans.runs import materialise
from ledgerloom.session import shared_dir
from ledgerloom.sources import ledger
from ledgerloom.sources.schema import LONG, STRING

# Folders per unique field of the values that registrations hold.
BUCKETS = 64
HELD = [
    T.StructField("value", STRING),
    T.StructField("id", LONG),
    T.StructField("field", STRING),
    T.StructField("bucket", T.IntegerType()),
]
KINDS = {
    "company": ("companies", registry.COMPANY_UNIQUE, registry.clean_companies, registry.company_rules),
    "account": ("users", registry.ACCOUNT_UNIQUE, registry.clean_accounts, registry.account_rules),
}
REJECT = "kind string, arrival long, error_message string, error_status int, document string"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("value"), F.lit(BUCKETS)).cast("int")


def _write_held(rows: DataFrame, fields: tuple[str, ...], folder: str, kind: str, batch_id: int) -> None:
    """Values that rows with an id hold from now on, by field and bucket."""
    values = registry.unique_values(rows.select(F.col("id").alias("arrival"), *fields), fields)
    held = values.withColumnRenamed("arrival", "id").withColumn("bucket", _bucket())
    (
        held.repartition("field", "bucket")
        .write.mode("overwrite")
        .partitionBy("field", "bucket")
        .parquet(f"{folder}/held_{kind}/{ledger.BATCH}={batch_id}")
    )


def held_values(
    spark: SparkSession, folder: str, kind: str, values: DataFrame, batch_id: int
) -> DataFrame:
    """Values (field, value) held after the batches before ``batch_id``.

    Only the buckets that ``values`` fall into are read; they are at most ``BUCKETS`` a field.
    """
    stored = ledger.read_before(spark, folder, f"held_{kind}", HELD, batch_id)
    asked = values.select("field", _bucket().alias("bucket")).distinct().collect()
    buckets: dict[str, list[int]] = {}
    for row in asked:
        buckets.setdefault(row["field"], []).append(row["bucket"])
    wanted = [
        (F.col("field") == field) & F.col("bucket").isin(sorted(numbers))
        for field, numbers in sorted(buckets.items())
    ]
    return stored.where(reduce(Column.__or__, wanted, F.lit(False))).select("field", "value").distinct()


def store_registry(rows: DataFrame, kind: str, folder: str, batch_id: int = 0) -> None:
    """Put existing companies or accounts, with their ids, into a ledger."""
    table, fields, *_ = KINDS[kind]
    ledger.append_table(rows, folder, table, batch_id)
    _write_held(rows, fields, folder, kind, batch_id)


def register_batch(posted: DataFrame, kind: str, folder: str, batch_id: int) -> None:
    """Accept or refuse a batch of registrations as if posted one by one, and store it.

    Accepted ones get the next ids, an account is linked to the company it registered, and
    refused ones go to the rejects with what was posted.  The batch sees what earlier batches
    stored, becomes visible at once by its marker, and can be repeated.
    """
    spark = posted.sparkSession
    table, fields, clean, rules = KINDS[kind]
    scratch = shared_dir(spark, "registration-run")
    cleaned = materialise(clean(posted), scratch, "cleaned")
    values = registry.unique_values(cleaned, fields)
    held = held_values(spark, folder, kind, values, batch_id)
    registered = registry.register_against(cleaned, held, fields, rules())
    registered = materialise(registered, scratch, "registered")
    stored = ledger.read_before(spark, folder, table, ledger.LEDGER_TABLES[table].fields, batch_id)
    make = registry.company_rows if kind == "company" else registry.account_rows
    accepted = materialise(make(registered, stored), scratch, "accepted")

    ledger.begin_batch(spark, folder, batch_id)
    ledger.append_table(accepted, folder, table, batch_id)
    _write_held(accepted, fields, folder, kind, batch_id)
    if kind == "company":
        links = accepted.select(
            F.lit("users").alias("entity"),
            F.col("created_by").alias("key"),
            F.lit("company_id").alias("field"),
            F.col("id").cast("string").alias("value"),
            F.col("id").alias("seq"),
        )
        ledger.append_updates(links, folder, batch_id)
    refused = registered.where(F.col("error_message").isNotNull()).select(
        F.lit(kind).alias("kind"),
        "arrival",
        "error_message",
        F.col("error_status").cast("int").alias("error_status"),
        F.to_json(F.struct(*[c for c in posted.columns if c != "arrival"])).alias("document"),
    )
    path = f"{folder}/registration_rejects/{ledger.BATCH}={batch_id}"
    refused.write.mode("overwrite").parquet(path)
    ledger.publish_batch(spark, folder, batch_id)
    ledger.delete_path(spark, scratch)


def set_terms(changes: DataFrame, folder: str, batch_id: int) -> None:
    """Store new terms of companies: ``id``, ``custTerms`` and their order ``seq``."""
    spark = changes.sparkSession
    ledger.begin_batch(spark, folder, batch_id)
    ledger.append_updates(
        changes.select(
            F.lit("companies").alias("entity"),
            F.col("id").alias("key"),
            F.lit("custTerms").alias("field"),
            F.col("custTerms").alias("value"),
            "seq",
        ),
        folder,
        batch_id,
    )
    ledger.publish_batch(spark, folder, batch_id)


def rejects(spark: SparkSession, folder: str) -> DataFrame:
    fields = T.StructType.fromDDL(REJECT).fields
    return ledger.read_rows(spark, folder, "registration_rejects", fields)


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts with the company each one registered last."""
    updates = ledger.read_updates(spark, folder)
    users = ledger.read_table(spark, folder, "users")
    return overlay.stored_updates(users, updates, "users", "company_id")


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with the terms set last."""
    updates = ledger.read_updates(spark, folder)
    stored = ledger.read_table(spark, folder, "companies")
    return overlay.stored_updates(stored, updates, "companies", "custTerms")
