"""What the operators of this subpackage share: words, tables, work folders."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_dir
from ledgerloom.sources.ledger import delete_path

# A word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; a missing one is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to the shared work folder and read back: cuts the lineage, survives executors.

    ``by`` names a column with few values whose rows lie in folders of their own.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    result = spark.read.schema(df.schema).parquet(path)
    result.scratch_path = path
    return result


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that have ended, on all executors.

    It does so for what the driver's garbage collection finds unused, by itself every half hour.
    """
    spark._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that nothing is read from any more."""
    for one in tables:
        delete_path(one.sparkSession, one.scratch_path)


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which values of a hash, modulo ``bits``, occur; at most ``bits`` / 64 rows come back.

    A filter of fixed size: it lets through what occurs, and by chance a little more.
    """
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    found = (
        rows.select(F.shiftright(place, 6).alias("at"), one.alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    result = np.zeros(bits // 64, dtype=np.uint64)
    result[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return result


def hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether its place in the bitmap is set."""
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def packed(docs: DataFrame) -> DataFrame:
    """One column ``row`` that holds all columns, so that no added name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns], *more)
