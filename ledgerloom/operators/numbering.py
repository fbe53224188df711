"""Bill numbers: a sequence per company and type that restarts in April.

The restart rule only looks at months: a bill of April or later whose predecessor is of
January to March starts again at 1, whatever the years.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import IdRanges, id_ranges, match, numbered

SERIES = ["company_id", "type"]


def last_bill(bills: DataFrame) -> DataFrame:
    """Number and time of the newest bill per series (largest id)."""
    newest = F.max_by(F.struct("bill_num", "bill_timestamp"), "id")
    return bills.groupBy(*SERIES).agg(newest.alias("_last")).select(*SERIES, "_last.*")


def next_number(last_num: Column, last_month: Column, month: Column) -> Column:
    """Number of a bill issued in ``month`` after the given last bill, if any."""
    return (
        F.when(last_num.isNull(), F.lit(1))
        .when((month >= 4) & (last_month < 4), F.lit(1))
        .otherwise(last_num + 1)
        .cast("bigint")
    )


def next_bill_number(last: DataFrame, on: datetime.date) -> DataFrame:
    """Number the next bill of each series gets on a given day."""
    month = F.month(F.lit(on))
    return last.withColumn(
        "next_num", next_number(F.col("bill_num"), F.month("bill_timestamp"), month)
    )


def _month_index(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at) - 1


def _restarts(month: Column, previous: Column) -> Column:
    """Whether a bill of one month index starts again after one of another; a first one
    does not."""
    return F.coalesce((month % 12 >= 3) & (previous % 12 < 3), F.lit(False))


def _with_seeds(per_series: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Add number and month index of the last stored bill, NULL where there is none."""
    if seeds is None:
        return per_series.withColumn("_seed_num", F.lit(None).cast("bigint")).withColumn(
            "_seed_month", F.lit(None).cast("int")
        )
    start = seeds.select(
        *SERIES,
        F.col("bill_num").alias("_seed_num"),
        _month_index(F.col("bill_timestamp")).alias("_seed_month"),
    )
    start = start.withColumnsRenamed({k: f"_seed_{k}" for k in SERIES})
    same = F.lit(True)
    for k in SERIES:
        same = same & F.col(k).eqNullSafe(F.col(f"_seed_{k}"))
    return per_series.join(start, same, "left").drop(*[f"_seed_{k}" for k in SERIES])


def number_bills(
    bills: DataFrame,
    seeds: DataFrame | None = None,
    ranges: IdRanges | None = None,
    mode: str = "month_rule",
) -> DataFrame:
    """Add ``bill_num`` to bills taken in order of their ids.

    ``seeds`` (columns company_id, type, bill_num, bill_timestamp) holds the last stored
    bill of series that continue.  ``mode='fiscal_year'`` counts inside each fiscal year
    instead of following the month rule.

    Each sort covers one of the ``ranges`` of ids, which are cut by the rows they hold.
    What spans a series - restarts and running counts - is computed on one row per range,
    so a tenant with a third of all bills, or one day with most of them, is no hot key.
    Bills without a company, type or time are numbered too: NULL is a series of its own,
    and a missing time never restarts it.
    """
    rows = bills.withColumn("_month", _month_index(F.col("bill_timestamp"))).withColumn(
        "_bucket", (ranges or id_ranges(bills, "id")).of(F.col("id"))
    )
    if mode == "fiscal_year":
        numbers = _count_in_fiscal_years(rows, seeds)
    elif mode != "month_rule":
        raise ValueError(f"unknown mode {mode!r}")
    else:
        numbers = _number_by_id(rows, seeds)
    return numbers.select(*bills.columns, F.col("bill_num").cast("bigint").alias("bill_num"))


def _count_in_fiscal_years(rows: DataFrame, seeds: DataFrame | None) -> DataFrame:
    # Months counted from April: a fiscal year is a run of twelve.
    years = rows.withColumn("_year", F.floor((F.col("_month") - 3) / 12))
    ranked = numbered(years, [*SERIES, "_year"], ["id"], F.col("_bucket"), "_rank")
    same_year = F.floor((F.col("_seed_month") - 3) / 12) == F.col("_year")
    start = F.when(same_year, F.col("_seed_num")).otherwise(0)
    return _with_seeds(ranked, seeds).withColumn("bill_num", F.col("_rank") + start)


def _number_by_id(rows: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Numbers for any dates: restarts are found inside each bucket, then across buckets."""
    slot = [*SERIES, "_bucket"]
    inside = W.partitionBy(*slot).orderBy("id")
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    local = (
        rows.withColumn("_local", F.row_number().over(inside))
        .withColumn("_restart", _restarts(F.col("_month"), F.lag("_month").over(inside)))
        .withColumn("_since", F.max(F.when(F.col("_restart"), F.col("_local"))).over(so_far))
    )
    buckets = _with_seeds(
        local.groupBy(*slot).agg(
            F.count("*").alias("_rows"),
            F.min_by("_month", "id").alias("_first_month"),
            F.max_by("_month", "id").alias("_last_month"),
            F.max("_since").alias("_last_restart"),
        ),
        seeds,
    )
    series = W.partitionBy(*SERIES).orderBy("_bucket")
    previous = F.coalesce(F.lag("_last_month").over(series), F.col("_seed_month"))
    # Rows a bucket hands on to the next one, and whether they begin a new segment.
    handed_on = F.col("_rows") - F.coalesce(F.col("_last_restart") - 1, F.lit(0))
    segments = (
        buckets.withColumn("_starts", _restarts(F.col("_first_month"), previous))
        .withColumn("_handed", handed_on)
        .withColumn(
            "_segment",
            F.sum((F.col("_starts") | F.col("_last_restart").isNotNull()).cast("int")).over(
                series.rowsBetween(W.unboundedPreceding, 0)
            ),
        )
    )
    seed = F.coalesce("_seed_num", F.lit(0))
    in_segment = W.partitionBy(*SERIES, "_segment").orderBy("_bucket")
    reached = segments.withColumn(
        "_reached",
        F.sum("_handed").over(in_segment.rowsBetween(W.unboundedPreceding, 0))
        + F.when(F.col("_segment") == 0, seed).otherwise(0),
    )
    offsets = reached.select(
        *slot,
        F.when(F.col("_starts"), F.lit(0))
        .otherwise(F.coalesce(F.lag("_reached").over(series), seed))
        .alias("_offset"),
    )
    number = F.when(
        F.col("_since").isNull(), F.col("_offset") + F.col("_local")
    ).otherwise(F.col("_local") - F.col("_since") + 1)
    return match(local, offsets, slot).withColumn("bill_num", number)
