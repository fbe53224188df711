"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the sources in code-point order, null last, weigh 1, 2, 3 and so on; they share the
size of all documents by weight, no target above ``most_epochs`` times its source's size, the
excess shared again.  Every source is cut into blocks by a hash of doc_id.  A source gives
each block as often as whole epochs fit into its target, and the first blocks of a random
permutation once more; the block where the target is reached gives single documents.  The
quotas of blocks are split over the output shards by a binary tree whose nodes draw
multivariate-hypergeometric, and each leaf takes the next blocks of the source's permutation,
so that the shards' draws are disjoint; rows are shuffled inside their shard by hash.

Nulls: a missing text has size 0, missing sources are one source, a missing doc_id is hashed
as such.  Documents without words are in every epoch and never count.  Repeated rows are
drawn each on its own.  An empty table gives an empty result.  The tables of sources and of
blocks are parameters of the mix, at most ``BLOCKS`` rows beyond one per source.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import packed, unpacked, whole_text, words, written

WEIGHTS = (1, 2, 3)
BLOCKS = 65_536
ROWS_PER_BLOCK = 64
# Up to so many sources their table is broadcast.
FEW_SOURCES = 10_000
# Documents among which the last ones of a source are chosen by their sizes.
LAST_CHOICE = 256


def targets(sizes: list[int], weights: list[int], most_epochs: int = 3) -> list[Fraction]:
    """Shares of the whole size by weight, capped, the excess shared again by weight."""
    left, result = Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    open_ones = list(range(len(sizes)))
    while open_ones:
        weight = sum(weights[i] for i in open_ones)
        full = [i for i in open_ones if left * weights[i] >= most_epochs * sizes[i] * weight]
        if not full:
            for i in open_ones:
                result[i] = left * weights[i] / weight
            break
        for i in full:
            result[i] = Fraction(most_epochs * sizes[i])
        left -= sum(result[i] for i in full)
        open_ones = [i for i in open_ones if i not in set(full)]
    return result


def splitting_tree(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas per shard and source; every node halves its shards and its blocks."""
    if n_shards == 1:
        return quotas[None, :]
    half = n_shards // 2
    n_left = int(quotas.sum()) * half // n_shards
    if n_left:
        left = rng.multivariate_hypergeometric(quotas, n_left, method="marginals")
    else:
        left = np.zeros_like(quotas)
    return np.vstack(
        [
            splitting_tree(left, half, rng),
            splitting_tree(quotas - left, n_shards - half, rng),
        ]
    )


def _plan(sources, blocks: pd.DataFrame, seed: int, n_shards: int, most_epochs: int):
    """Per block: how often it is taken, words wanted from it alone, shards of its copies."""
    order = list(range(len(sources)))
    sizes = [int(r["size"]) for r in sources]
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in order]
    goal = targets(sizes, weights, most_epochs)
    rows, draws = [], []
    by_source = {k: g for k, g in blocks.groupby("sid")}
    for i in order:
        mine = by_source.get(i)
        if mine is None:
            draws.append(0)
            continue
        rng = np.random.default_rng([seed, i])
        mine = mine.sort_values("block").iloc[rng.permutation(len(mine))]
        epochs = int(goal[i] // sizes[i]) if sizes[i] else 1
        rest = int(round(goal[i] - epochs * sizes[i]))
        ends = mine["size"].cumsum().to_numpy()
        n_whole = int(np.searchsorted(ends, rest, side="right"))
        before = int(ends[n_whole - 1]) if n_whole else 0
        n_drawn = epochs * len(mine) + n_whole + (1 if rest > before else 0)
        for k, block in enumerate(mine["block"].tolist()):
            part = rest - before if k == n_whole and rest > before else 0
            rows.append((i, block, epochs + (1 if k < n_whole else 0), part, k, len(mine)))
        draws.append(n_drawn)
    leaf = splitting_tree(np.array(draws, dtype=np.int64), n_shards, np.random.default_rng(seed))
    ends = leaf.cumsum(axis=0)  # shard by source
    planned = []
    for sid, block, copies, part, k, n in rows:
        drawn = [k + e * n for e in range(copies + (1 if part else 0))]
        shards = np.searchsorted(ends[:, sid], drawn, side="right").tolist()
        planned.append((sid, int(block), copies, part, shards))
    return goal, planned


def nearest_subset(sizes: list[int], wanted: int) -> list[int]:
    """Places of sizes whose sum comes nearest to ``wanted`` from below, by subset sums.

    Sums are kept as bits; large ones in units that cost less than a thousandth.
    """
    unit = max(1, wanted // 200_000)
    scaled = [-(-s // unit) for s in sizes]
    most = wanted // unit
    reached, steps = 1, []
    for s in scaled:
        steps.append(reached)
        reached |= (reached << s) & ((1 << (most + 1)) - 1)
    at, chosen = reached.bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        if not steps[i] >> at & 1:
            chosen.append(i)
            at -= scaled[i]
    return chosen


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    """In the block where the target is reached: documents in hashed order, the last few
    hundred chosen so that their sizes add up.  Only hashes and sizes come here."""
    frame = frame.sort_values(["lot", "size"], kind="stable").reset_index(drop=True)
    extra = np.zeros(len(frame), dtype=np.int32)
    left, sizes = int(frame["part"].iloc[0]) if len(frame) else 0, frame["size"].tolist()
    start = 0
    while len(sizes) - start > LAST_CHOICE and sum(sizes[start : start + LAST_CHOICE]) < left:
        extra[start] = 1
        left -= sizes[start]
        start += 1
    for i in nearest_subset(sizes[start : start + LAST_CHOICE], left):
        extra[start + i] = 1
    frame["extra"] = extra
    return frame


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return packed(docs).select(
        "row",
        F.col("row.source").alias("source"),
        F.size(words(whole_text("row.text"))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "row.doc_id").alias("lot"),
    )


def mixed(
    rows: DataFrame, seed: int = 17, n_shards: int = 16, most_epochs: int = 3
) -> DataFrame:
    """``rows`` (row, source, size, lot) with the copies of each and the shards they go to.

    Columns: row, size, source_size, target, copies, shards (array), lot.
    """
    spark = rows.sparkSession
    narrow = written(rows.select("source", "size", "lot"), "mix-sizes")
    sources = (
        narrow.groupBy("source")
        .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        .orderBy(F.col("source").asc_nulls_last())
        .collect()
    )
    n_rows = max(1, sum(r["n"] for r in sources))
    n_blocks = [
        max(1, min(-(-r["n"] // ROWS_PER_BLOCK), BLOCKS * r["n"] // n_rows)) for r in sources
    ]
    numbered = spark.createDataFrame(
        [
            (r["source"], i, int(r["size"]), n_blocks[i])
            for i, r in enumerate(sources)
        ],
        "m_source string, sid int, source_size long, n_blocks long",
    )
    # A source with a third of the rows should not be shuffled to one task for this.
    if len(sources) <= FEW_SOURCES:
        numbered = F.broadcast(numbered)

    def blocked(of: DataFrame) -> DataFrame:
        joined = of.join(numbered, F.col("source").eqNullSafe(F.col("m_source")))
        return joined.withColumn("block", F.pmod("lot", F.col("n_blocks"))).drop("m_source")

    blocks = blocked(narrow).groupBy("sid", "block").agg(F.sum("size").alias("size")).toPandas()
    goal, planned = _plan(sources, blocks, seed, n_shards, most_epochs)
    plan = spark.createDataFrame(
        [(s, b, c, p, w, float(goal[s])) for s, b, c, p, w in planned],
        "p_sid int, p_block long, copies int, part long, shards array<int>, target double",
    )
    here = (F.col("sid") == F.col("p_sid")) & (F.col("block") == F.col("p_block"))

    def planned_rows(of: DataFrame) -> DataFrame:
        return blocked(of).join(plan, here).drop("p_sid", "p_block", "source", "n_blocks")

    drawn = planned_rows(rows)
    last = planned_rows(narrow).where("part > 0").select("sid", "block", "lot", "size", "part")
    chosen = last.groupBy("sid", "block").applyInPandas(
        _fill, last.withColumn("extra", F.lit(0)).schema
    )
    # Rows of one doc_id and size are equal here: so many of them are taken once more.
    chosen = chosen.groupBy("sid", "lot", "size").agg(F.sum("extra").alias("more"))
    chosen = chosen.where("more > 0").withColumnsRenamed(
        {"sid": "c_sid", "lot": "c_lot", "size": "c_size"}
    )
    alike = Window.partitionBy("sid", "lot", "size").orderBy(F.xxhash64("row"))
    whole = drawn.where("part = 0").withColumn("extra", F.lit(0))
    partly = (
        drawn.where("part > 0")
        .withColumn("nth", F.row_number().over(alike))
        .join(
            chosen,
            (F.col("sid") == F.col("c_sid"))
            & (F.col("lot") == F.col("c_lot"))
            & (F.col("size") == F.col("c_size")),
            "left",
        )
        .withColumn("extra", F.when(F.col("nth") <= F.col("more"), 1).otherwise(0))
        .drop("nth", "c_sid", "c_lot", "c_size", "more")
    )
    return whole.unionByName(partly).select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("copies") + F.col("extra")).alias("copies"),
        "shards",
        "lot",
    )


def _place(copy: Column) -> Column:
    """What the copies inside a shard are ordered by."""
    return F.xxhash64("lot", "size", copy)


def mix_documents(docs: DataFrame, seed: int = 17, n_shards: int = 16) -> DataFrame:
    """Every document as often as it was drawn, with its columns, in order of shard and place."""
    drawn = mixed(_sized(docs, seed), seed, n_shards)
    repeated = drawn.withColumn(
        "copy",
        F.explode(
            F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(
                F.array().cast("array<int>")
            )
        ),
    )
    placed = repeated.select(
        "row", F.get("shards", F.col("copy") - 1).alias("shard"), _place(F.col("copy")).alias("place")
    )
    ordered = placed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return unpacked(ordered, docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    rows = _sized(docs.select("doc_id", "text", "source"), 17)
    drawn = mixed(rows.withColumn("row", F.struct("row.doc_id")))
    return drawn.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.col("copies").cast("int").alias("copies"),
        F.when(F.col("copies") > 0, F.slice("shards", 1, F.greatest(F.col("copies"), F.lit(1))))
        .otherwise(F.array().cast("array<int>"))
        .cast("array<int>")
        .alias("shards"),
        F.when(
            F.col("copies") > 0, F.transform(F.sequence(F.lit(1), F.col("copies")), _place)
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("places"),
    )
