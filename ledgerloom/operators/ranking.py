"""Row numbers inside large groups.

A plain ``row_number() over (partition by tenant order by id)`` sorts a whole tenant in
one task.  Instead the ids are cut into ranges by how many rows they hold, each range is
ranked on its own, and the counts of the ranges, a table of at most a few thousand rows per
group, carry the offsets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows a range should hold at most, unless that made more than RANGES of them.
ROWS_PER_RANGE = 200_000
RANGE_BITS = 12
RANGES = 1 << RANGE_BITS


def bucket_of(key: Column, width: int) -> Column:
    return F.call_function("div", key, F.lit(width).cast("bigint"))


@dataclass(frozen=True)
class IdRanges:
    """Ranges of ids: 4096 equal stretches, some of them cut finer.

    ``of`` gives the first id of the range, counted from the lowest, so it grows with the id.
    The widths of the finer ones are one array literal with an entry per stretch, so the
    expression does not grow with their number.
    """

    lowest: int
    shift: int
    finer: dict[int, int] = field(default_factory=dict)

    def of(self, key: Column) -> Column:
        # Ids outside the counted ones stay in order: they only widen the outer ranges.
        offset = F.greatest(key - F.lit(self.lowest), F.lit(0))
        if not self.finer:
            return F.shiftleft(F.shiftright(offset, self.shift), self.shift)
        last = max(self.finer)
        listed = ",".join(str(self.finer.get(p, self.shift)) for p in range(last + 1))
        shifts = F.split(F.lit(listed), ",").cast("array<int>")
        stretch = F.least(F.shiftright(offset, self.shift), F.lit(last + 1)).cast("int")
        shift = F.coalesce(F.get(shifts, stretch), F.lit(self.shift))
        return F.call_function("shiftleft", F.call_function("shiftright", offset, shift), shift)


def id_ranges(df: DataFrame, column: str) -> IdRanges:
    """Ranges of an id column that hold about equal numbers of rows.

    Counts the rows per stretch and cuts the crowded ones again until none is left, or until
    a range is a single id.  Only crowded stretches, at most 2048, reach the driver.
    """
    ids = df.select(F.col(column).alias("id"))
    row = ids.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).first()
    if row["n"] <= ROWS_PER_RANGE:
        return IdRanges(row["lo"] or 0, 62)
    lowest, span = row["lo"], (row["hi"] - row["lo"]).bit_length()
    shift = max(0, span - RANGE_BITS)
    limit = 2 * max(ROWS_PER_RANGE, row["n"] // RANGES)
    finer: dict[int, int] = {}
    while True:
        ranges = IdRanges(lowest, shift, dict(finer))
        stretch = F.shiftright(F.col("id") - F.lit(lowest), shift)
        crowded = (
            ids.where(F.col("id").isNotNull())
            .groupBy(stretch.alias("p"), ranges.of(F.col("id")).alias("r"))
            .agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
            .where((F.col("n") > limit) & (F.col("lo") < F.col("hi")))
            .collect()
        )
        cut = {}
        for r in crowded:
            inside = (r["hi"] - r["lo"]).bit_length()
            parts = (r["n"] // limit).bit_length() + 1
            wanted = min(finer.get(r["p"], shift) - 1, max(0, inside - parts))
            cut[r["p"]] = min(cut.get(r["p"], wanted), wanted)
        cut = {p: s for p, s in cut.items() if s >= 0}
        if not cut:
            return ranges
        finer.update(cut)


def match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys where NULL equals NULL; ``right`` has one row per key."""
    renamed = right.withColumnsRenamed({k: f"_match_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_match_{k}"))
    return left.join(renamed, same).drop(*[f"_match_{k}" for k in keys])


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    out: str,
    descending: bool = False,
) -> DataFrame:
    """Add ``out``, the 1-based rank of each row inside its ``keys`` group.

    ``order`` must be unique inside a group and start with the column ``bucket`` is a
    growing function of.  With no ``keys`` the rank runs over all rows.  NULL keys are a
    group of their own.
    """
    def sort(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    earlier = (
        W.partitionBy(*keys)
        .orderBy(sort("_bucket"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    local = W.partitionBy(*keys, "_bucket").orderBy(*[sort(c) for c in order])
    return (
        match(rows.withColumn("_local", F.row_number().over(local)), offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .select(*df.columns, out)
    )
