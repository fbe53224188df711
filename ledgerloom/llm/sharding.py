"""Histogram sort: shards of near equal bytes, placed with one exchange.

Rows are ordered by (hash of the text, doc_id), so copies of a text lie together.  Splitters
are found by counting the exact bytes below candidate boundaries: a round takes the next
twelve bits of the key, only for the stretches that still hold a splitter, until every
splitter is within ``tolerance`` of its target.  A group of copies stays whole unless that
would cost more than ``group_tolerance`` of a shard; then the rounds go on over doc_id.

A null text has no bytes (size 1) and is a group of its own with the empty one; a null
doc_id comes first in its group.  Repeated rows are rows of their own.  An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerloom.llm.common import packed, unpacked, written

DIGIT = 12
SMALLEST = -(2**63)
# Rows that a slot-counting sort should have at most, unless there are too many of them.
ROWS_PER_BIN = 20_000
BINS = 4096


@dataclass(frozen=True)
class Stretch:
    """Keys that share the leading bits; ``below`` are the bytes before them."""

    level: int
    prefix: int
    text_hash: int | None
    below: int
    size: int


def _keys(docs: DataFrame) -> DataFrame:
    text = F.col("row.text")
    return packed(docs).select(
        "row",
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        F.coalesce(F.col("row.doc_id"), F.lit(SMALLEST)).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
    )


def _shift(level: int) -> int:
    return max(0, 64 - DIGIT * (level + 1))


LAST = (64 + DIGIT - 1) // DIGIT - 1


def _histogram(keys: DataFrame, open_ones: list[Stretch]) -> dict[Stretch, list[tuple[int, int]]]:
    """Bytes per next digit inside each open stretch; one job, at most 4096 rows each."""
    found: dict[Stretch, list[tuple[int, int]]] = {s: [] for s in open_ones}
    for level, by_id in {(s.level, s.text_hash is not None) for s in open_ones}:
        group = {
            (s.text_hash, s.prefix): s
            for s in open_ones
            if (s.level, s.text_hash is not None) == (level, by_id)
        }
        key = F.col("id") if by_id else F.col("h")
        before = F.lit(0).cast("long") if level < 0 else F.shiftright(key, _shift(level))
        rows = keys.select(
            (F.col("h") if by_id else F.lit(None).cast("long")).alias("text_hash"),
            before.alias("prefix"),
            F.shiftright(key, _shift(level + 1)).alias("next"),
            "size",
        )
        wanted = F.lit(False)
        for text_hash, prefix in group:
            one = F.col("prefix") == F.lit(prefix)
            if by_id:
                one = one & (F.col("text_hash") == F.lit(text_hash))
            wanted = wanted | one
        counted = (
            rows.where(wanted).groupBy("text_hash", "prefix", "next").agg(F.sum("size").alias("b"))
        )
        for r in counted.collect():
            found[group[(r["text_hash"], r["prefix"])]].append((r["next"], r["b"]))
    return {s: sorted(bins) for s, bins in found.items()}


def _low(level: int, prefix: int) -> int:
    """The smallest key with this prefix."""
    return prefix << _shift(level)


def splitters(
    keys: DataFrame,
    total: int,
    n_shards: int,
    tolerance: float = 0.01,
    group_tolerance: float = 0.05,
) -> list[tuple[int, int]]:
    """Smallest key (text hash, doc_id) of every shard but the first."""
    target = total / n_shards
    cut: dict[int, tuple[int, int]] = {}
    where = {k: Stretch(-1, 0, None, 0, total) for k in range(1, n_shards)}
    while where:
        bins = _histogram(keys, list(dict.fromkeys(where.values())))
        for k, stretch in list(where.items()):
            goal, below = total * k / n_shards, stretch.below
            level = stretch.level + 1
            by_id = stretch.text_hash is not None
            for i, (prefix, size) in enumerate(bins[stretch]):
                if below + size < goal and i + 1 < len(bins[stretch]):
                    below += size
                    continue
                whole = level == LAST and not by_id
                close = size <= target * (group_tolerance if whole else tolerance)
                if close or (level == LAST and by_id):
                    # The nearer edge; the upper one is the next key after this stretch.
                    high = goal - below > below + size - goal
                    edge = _low(level, prefix + 1) if high else _low(level, prefix)
                    cut[k] = (stretch.text_hash, edge) if by_id else (edge, SMALLEST)
                    del where[k]
                elif whole:
                    where[k] = Stretch(-1, 0, prefix, below, size)
                else:
                    where[k] = Stretch(level, prefix, stretch.text_hash, below, size)
                break
    return [cut[k] for k in sorted(cut)]


def _shard_of(cuts: list[tuple[int, int]]) -> Column:
    shard = F.lit(0)
    for h, i in cuts:
        if h >= 2**63:
            continue  # beyond the largest key: nothing follows
        if i >= 2**63:
            after = F.col("h") > F.lit(h)
        else:
            after = (F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("id") >= F.lit(i)))
        shard = shard + after.cast("int")
    return shard


def sharded(
    docs: DataFrame,
    n_shards: int = 16,
    tolerance: float = 0.01,
    group_tolerance: float = 0.05,
) -> DataFrame:
    """``row`` (all columns of ``docs``), size, shard and slot; one exchange of the rows."""
    return placed(_keys(docs), n_shards, tolerance, group_tolerance)


def placed(
    keyed: DataFrame, n_shards: int, tolerance: float = 0.01, group_tolerance: float = 0.05
) -> DataFrame:
    """Shard and slot of rows with ``h``, ``id`` and ``size``; their ``row`` travels along.

    Slots count inside bins of a shard: 4096 stretches of the hash, and parts by a hash of
    doc_id for a text with more than its share of rows, so no sort holds more than about a bin,
    but for rows that repeat both text and doc_id.
    """
    narrow = written(keyed.select("h", "id", "size"), "shard-keys")
    total, n_rows = narrow.agg(F.sum("size"), F.count("*")).first()
    cuts = splitters(narrow, total, n_shards, tolerance, group_tolerance) if n_rows else []
    most = max(ROWS_PER_BIN, (n_rows or 0) // BINS)
    # Rows of a text beyond its share are parted by a hash of their doc_id.  At most 4096
    # texts can have that many rows.
    counted = narrow.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = written(
        counted.select(F.col("h").alias("hot"), F.ceil(F.col("n") / most * 2).alias("parts")),
        "hot-texts",
    )

    def binned(rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        return rows.join(hot, F.col("h") == F.col("hot"), "left").withColumns(
            {
                "shard": _shard_of(cuts).cast("int"),
                "bin": F.shiftright("h", 64 - DIGIT),
                "part": F.coalesce(part, F.lit(0).cast("long")),
            }
        )

    bins = binned(narrow).groupBy("shard", "bin", "part").agg(F.count("*").alias("n"))
    first = Window.partitionBy("shard").orderBy("bin", "part")
    starts = bins.select(
        F.col("shard").alias("s_shard"),
        F.col("bin").alias("s_bin"),
        F.col("part").alias("s_part"),
        (F.sum("n").over(first) - F.col("n")).alias("start"),
    )
    inside = Window.partitionBy("shard", "bin", "part").orderBy("h", "id", "size")
    ranked = binned(keyed).withColumn("nth", F.row_number().over(inside))
    return ranked.join(
        starts,
        (F.col("shard") == F.col("s_shard"))
        & (F.col("bin") == F.col("s_bin"))
        & (F.col("part") == F.col("s_part")),
    ).select(
        "row",
        "size",
        "shard",
        (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The documents with ``shard`` and ``slot``; columns of these names are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return unpacked(sharded(docs, n_shards), keep, F.col("shard"), F.col("slot"))


def digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("row.text"), F.lit(""))
    keyed = _keys(docs.select("doc_id", "text")).withColumn(
        "row",
        F.struct(
            F.col("row.doc_id").alias("doc_id"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        ),
    )
    return placed(keyed, 16).select(
        "row.doc_id",
        "size",
        "row.text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
