"""Ledger tables on disk: load, read submissions, append."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.schema import (
    ACCOUNT_REGISTRATION,
    COMPANY_REGISTRATION,
    DOCUMENT_INDEX,
    INVOICE_SUBMISSION,
    LEDGER_TABLES,
    QUOTATION_SUBMISSION,
    RESCUED,
    UPDATE,
)

# Every appended table carries the batch that wrote it, so a repeated batch replaces
# its own files only.
BATCH = "batch_id"


@dataclass(frozen=True)
class Ledger:
    users: DataFrame
    companies: DataFrame
    defaults: DataFrame
    beneficiaries: DataFrame
    goods: DataFrame
    history: DataFrame
    history_goods: DataFrame


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    files, hadoop_path = _file_system(spark, path)
    return files.exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> None:
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """Batches that wrote to a table, from the names of its folders."""
    files, hadoop_path = _file_system(spark, path)
    if not files.exists(hadoop_path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(hadoop_path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}="))


# --- publication ------------------------------------------------------------------


def _marker(folder: str, batch_id: int, state: str) -> str:
    return f"{folder}/_batches/{batch_id}.{state}"


def begin_batch(spark: SparkSession, folder: str, batch_id: int) -> None:
    """From here until it is published, readers leave the batch out."""
    files, begun = _file_system(spark, _marker(folder, batch_id, "begun"))
    files.create(begun, True).close()
    delete_path(spark, _marker(folder, batch_id, "published"))


def publish_batch(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Make a whole batch visible, by one empty file."""
    files, published = _file_system(spark, _marker(folder, batch_id, "published"))
    files.create(published, True).close()


def published(df: DataFrame, folder: str, path: str) -> DataFrame:
    """Rows of a table below ``path`` whose batches are whole.

    The table's batches are listed before the markers, and no others are read: a batch that
    begins in between is either not listed or has its first marker.  Batches that were never
    begun, written table by table, are visible.
    """
    spark = df.sparkSession
    if not path_exists(spark, f"{folder}/_batches"):
        return df
    listed = batch_ids(spark, path)
    files, markers = _file_system(spark, f"{folder}/_batches")
    names = {status.getPath().getName() for status in files.listStatus(markers)}
    whole = [k for k in listed if f"{k}.begun" not in names or f"{k}.published" in names]
    return df.where(F.col(BATCH).isin(whole))


def read_rows(
    spark: SparkSession, folder: str, name: str, fields: list[T.StructField]
) -> DataFrame:
    """Published rows of a table of the ledger's folder, with their batch."""
    schema = T.StructType([*fields, T.StructField(BATCH, T.LongType())])
    path = f"{folder}/{name}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return published(spark.read.schema(schema).parquet(path), folder, path)


def read_before(
    spark: SparkSession, folder: str, name: str, fields: list[T.StructField], batch_id: int
) -> DataFrame:
    """What batches before this one stored; a repeated batch does not see itself."""
    return read_rows(spark, folder, name, fields).where(F.col(BATCH) < batch_id)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Published rows of a ledger table with its batch column; empty while there are none."""
    return read_rows(spark, folder, name, LEDGER_TABLES[name].fields)


def load_model(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(**{name: read_table(spark, folder, name) for name in LEDGER_TABLES})


def submission_schema(kind: str) -> T.StructType:
    return INVOICE_SUBMISSION if kind == "Invoice" else QUOTATION_SUBMISSION


def json_submissions(reader, kind: str):
    """Set up a batch or stream reader: records that cannot be read whole keep their text."""
    schema = T.StructType(
        [*submission_schema(kind).fields, T.StructField(RESCUED, T.StringType())]
    )
    return reader.format("json").schema(schema).option("columnNameOfCorruptRecord", RESCUED)


def read_submissions(spark: SparkSession, path: str, kind: str, fmt: str = "json") -> DataFrame:
    """Posted documents, from JSON records, url-encoded forms (``form``), or a table format."""
    if fmt == "json":
        return json_submissions(spark.read, kind).load(path)
    if fmt == "form":
        return form_submissions(spark.read.text(path), kind)
    return spark.read.schema(submission_schema(kind)).format(fmt).load(path)


def form_submissions(posts: DataFrame, kind: str, body: str = "value") -> DataFrame:
    """Documents from url-encoded form bodies, one a row.

    A repeated field is an array in the order posted; of a field that is read once the first
    value counts, and a field that is not posted is NULL.  A ticked box is posted, whatever its
    value.  A body that cannot be decoded, or whose keys are not of their type, is kept in
    ``rescued``.
    """
    def decoded(part: Column) -> Column:
        coded = F.contains(part, F.lit("%")) | F.contains(part, F.lit("+"))
        return F.when(coded, F.try_url_decode(part)).otherwise(part)

    def pair(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        value = F.substr(p, F.length(name) + 2)
        return F.struct(decoded(name).alias("name"), decoded(value).alias("value"))

    pairs = F.transform(F.filter(F.split(body, "&"), lambda p: p != ""), pair)

    def posted(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            named = F.filter("_pairs", lambda p: p["name"] == f.name)
            return F.transform(named, lambda p: p["value"])
        place = F.array_position("_names", f.name)
        if isinstance(f.dataType, T.BooleanType):
            return place > 0
        return F.get("_values", place.cast("int") - 1)

    def field(f: T.StructField) -> Column:
        value = F.col(f"_{f.name}")
        if isinstance(f.dataType, T.ArrayType):
            return F.when(F.size(value) > 0, value)
        if isinstance(f.dataType, T.BooleanType):
            return value
        return value.try_cast(f.dataType)

    fields = submission_schema(kind).fields
    torn = F.exists("_pairs", lambda p: p["name"].isNull() | p["value"].isNull())
    for f in fields:
        if isinstance(f.dataType, (T.LongType, T.DateType)):
            first = F.col(f"_{f.name}")
            torn = torn | (first.isNotNull() & first.try_cast(f.dataType).isNull())
    return (
        posts.withColumn("_pairs", pairs)
        .withColumns({"_names": F.col("_pairs.name"), "_values": F.col("_pairs.value")})
        .withColumns({f"_{f.name}": posted(f) for f in fields})
        .select(
            *[field(f).alias(f.name) for f in fields],
            F.when(F.coalesce(torn, F.lit(True)), F.col(body)).alias(RESCUED),
        )
    )


def read_registrations(spark: SparkSession, path: str, kind: str, fmt: str = "json") -> DataFrame:
    """Posted registrations: ``kind`` is ``company`` or ``account``."""
    schema = {"company": COMPANY_REGISTRATION, "account": ACCOUNT_REGISTRATION}[kind]
    return spark.read.schema(schema).format(fmt).load(path)


def append_table(df: DataFrame, folder: str, name: str, batch_id: int) -> None:
    """Write the rows of one batch.  Doing it again replaces the same rows."""
    schema = LEDGER_TABLES[name]
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    writer = df.select(*columns).write.mode("overwrite")
    if name == "history":
        writer = writer.partitionBy("type")
    writer.parquet(f"{folder}/{name}/{BATCH}={batch_id}")


def append_documents(df: DataFrame, folder: str, batch_id: int) -> None:
    """Printed documents as packed JSON; their texts repeat, so unpacked they would be by far the
    largest part of the ledger."""
    writer = df.write.mode("overwrite").option("compression", "gzip")
    writer.json(f"{folder}/documents/{BATCH}={batch_id}")


def append_rejects(df: DataFrame, folder: str, batch_id: int) -> None:
    text = F.col(RESCUED) if RESCUED in df.columns else F.lit(None).cast("string")
    df.withColumn(RESCUED, text).write.mode("overwrite").parquet(
        f"{folder}/rejects/{BATCH}={batch_id}"
    )


# --- documents by id ----------------------------------------------------------------

# Ids in a folder of the index, and the most folders that are named to the scan.
STRETCH = 1 << 20
NAMED_STRETCHES = 1000


def _stretch(stretch: int) -> Column:
    return F.call_function("div", F.col("id"), F.lit(stretch).cast("long"))


def append_document_index(
    bills: DataFrame, folder: str, batch_id: int, stretch: int = STRETCH
) -> None:
    """Labels of bills for lookups by id.

    A folder holds a stretch of ids, sorted, so that a lookup opens the folders of the ids it
    asks for and reads the row groups that may hold them.
    """
    (
        bills.select("id", "company_id", "bill_label", _stretch(stretch).alias("stretch"))
        .repartitionByRange("id")
        .sortWithinPartitions("stretch", "id")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy("stretch")
        .parquet(f"{folder}/document_index/{BATCH}={batch_id}")
    )


def indexed_documents(
    requests: DataFrame, folder: str, stretch: int = STRETCH
) -> DataFrame:
    """Index entries that requests (column ``id``) may ask for.

    The folders asked for are named to the scan while they are few; beyond that the whole
    index is read, with the same answers.
    """
    spark = requests.sparkSession
    index = read_rows(spark, folder, "document_index", DOCUMENT_INDEX.fields)
    asked = (
        requests.where("id IS NOT NULL")
        .select(_stretch(stretch).alias("stretch"))
        .distinct()
        .limit(NAMED_STRETCHES + 1)
        .collect()
    )
    if len(asked) <= NAMED_STRETCHES:
        index = index.where(F.col("stretch").isin([r["stretch"] for r in asked]))
    return index.drop("stretch", BATCH)


def append_updates(df: DataFrame, folder: str, batch_id: int) -> None:
    """Log changes of single values: entity, key, field, value and their order in the batch."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in UPDATE]).write.mode("overwrite").parquet(
        f"{folder}/updates/{BATCH}={batch_id}"
    )


def read_updates(spark: SparkSession, folder: str) -> DataFrame:
    return read_rows(spark, folder, "updates", UPDATE.fields)


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Save a table bucketed and sorted by ``key``.

    History bucketed by bill id and lines bucketed alike meet without a shuffle, which
    pays off for a ledger that is read more often than it is written.
    """
    (
        df.write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)
