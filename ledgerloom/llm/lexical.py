"""Ranked lexical search by pipelined term partitioning.

Every document is scored for every item, and each item keeps its best ones.  The terms of the
items are dealt to owners by how many documents hold them, rare terms first.  Documents lie in
blocks; the postings of a block (term, documents, contributions without the term's weight) are
kept by owner.  Items go in bundles.  For every bundle and block, a sparse accumulator (item,
document, score) travels from owner to owner: each stage is a cogroup of accumulators with the
owner's postings of the block, adds the integer contributions, and hands on what can still
reach the best.  Scores are exact: a document is left out only when its score and all that
the later owners could add are below the item's tenth best score so far.

A null text has no terms; it, and a text without terms, are never found and not counted.  Rows
that share an item_id, null included, are one item with the terms of all of them.  Document
rows are ranked each on its own, also repeated ones; equal scores go by doc_id, nulls last.
Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bitmap, hit, written
from ledgerloom.llm.vector import Words, chunks

TOP = 10
# An owner takes terms held by at most one document in so many; the last takes the others.
OWNERS = (64, 8, 1)
# Bits of the filter that finds the items' terms in the documents.
BITS = 1 << 24
# Terms get their owner by the documents counted for their bin of hashes.
BINS = 1 << 16
# Documents of a block and items of a bundle: an accumulator has 16 MB at most in a task.
DOCS = 4096
ITEMS = 512
# Copies of a bundle that blocks meet, so that no task joins all blocks.
SALTS = 32
# A contribution is below the weight times this.
UNIT = 1_000_000

# Terms are runs of ASCII letters, digits and anything beyond ASCII.
_ENDS = np.ones(256, dtype=bool)
_ENDS[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = False


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per term occurrence of an item, with the term's hash."""
    for batch in batches:
        for start, words in chunks(batch.column(1), lower=True, separators=_ENDS):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(words.doc + start)),
                    pa.array([words.word(i).decode() for i in range(len(words))], pa.string()),
                    pa.array(words.hash.view(np.int64)),
                ],
                names=["item_id", "term", "h"],
            )


def _found(words: Words, bits: np.ndarray):
    """Wanted terms of a block: first occurrence of each, then documents and counts by term.

    ``ends`` says where the documents of each term end.
    """
    at = np.flatnonzero(hit(bits, words.hash))
    at = at[np.lexsort((words.doc[at], words.hash[at]))]
    h, doc = words.hash[at], words.doc[at]
    new_term = np.ones(len(at), dtype=bool)
    new_term[1:] = h[1:] != h[:-1]
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(at)))
    ends = np.append(np.flatnonzero(new_term[first])[1:], len(first))
    if not len(first):
        ends = ends[:0]
    return at[new_term], doc[first], times, ends


def _strings(words: Words, at: np.ndarray) -> pa.Array:
    return pa.array([words.word(i).decode() for i in at], pa.string())


def _counts(bits: np.ndarray):
    """Documents per wanted term; a row without term has the documents and terms in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in chunks(batch.column(0), lower=True, separators=_ENDS):
                at, _, _, ends = _found(words, bits)
                docs = np.diff(ends, prepend=0)
                strings = _strings(words, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([strings, pa.array([None], pa.string())]),
                        pa.array(np.append(docs, np.count_nonzero(words.counts)).astype(np.int64)),
                        pa.array(np.append(np.zeros(len(at)), len(words)).astype(np.int64)),
                    ],
                    names=["term", "docs", "terms"],
                )

    return run


def _postings(bits: np.ndarray, owners: np.ndarray, n_docs: int, n_terms: int):
    """Blocks of documents: one row per term, and one with the doc_ids for every owner.

    A factor is what the term's weight is multiplied with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, DOCS):
                part = batch.slice(low, DOCS)
                for start, words in chunks(part.column(1), lower=True, separators=_ENDS):
                    at, doc, times, ends = _found(words, bits)
                    if not len(at):
                        continue
                    long = 25 + (75 * words.counts * n_docs) // n_terms
                    factor = (1_000_000_000 * times) // (1000 * times + 8 * long[doc])
                    offsets = np.append(0, ends).astype(np.int32)
                    owner = owners[words.hash[at] & np.uint64(BINS - 1)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), block)),
                            pa.array(owner),
                            _strings(words, at),
                            pa.ListArray.from_arrays(offsets, pa.array(doc.astype(np.int32))),
                            pa.ListArray.from_arrays(offsets, pa.array(factor.astype(np.int64))),
                        ],
                        names=["block", "owner", "term", "docs", "factors"],
                    )
                    ids = pa.array([part.column(0).slice(start, words.n_docs).to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block]),
                            pa.array([len(OWNERS)], pa.int32()),
                            pa.array([None], pa.string()),
                            pa.array([None], pa.list_(pa.int32())),
                            ids.cast(pa.list_(pa.int64())),
                        ],
                        names=["block", "owner", "term", "docs", "factors"],
                    )
                    block += 1

    return run


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """All elements of a column of lists, whose rows may be null."""
    column = table.column(name).drop_null().combine_chunks()
    return np.asarray(pc.list_flatten(column)) if len(column) else np.zeros(0, dtype=np.int64)


LEFT = (
    "bundle int, block long, q_item array<long>, q_term array<string>, q_weight array<long>, "
    "l_item array<long>, l_admit array<boolean>, l_best array<long>, l_after array<long>, "
    "a_item array<long>, a_doc array<int>, a_score array<long>"
)
CARRIED = (
    "bundle int, block long, a_item array<long>, a_doc array<int>, a_score array<long>, "
    "t_item array<long>, t_score array<long>"
)
CHOSEN = "item long, doc_id long, score long"


def _stage(top: int, last: bool):
    """Scores of a bundle in a block after one more owner."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        items = _flat(left, "l_item")
        order = np.argsort(items)
        items = items[order]
        postings = right.filter(pc.is_valid(right.column("term")))
        heads = right.filter(pc.is_null(right.column("term")))
        ends = np.cumsum(pc.list_value_length(postings.column("docs")).to_numpy())
        docs, factors = _flat(postings, "docs"), _flat(postings, "factors")
        old_doc = _flat(left, "a_doc").astype(np.int64)
        n_docs = 1 + max(docs.max(initial=0), old_doc.max(initial=0))
        score = np.zeros((len(items), n_docs), dtype=np.int64)
        old_item = np.searchsorted(items, _flat(left, "a_item"))
        score[old_item, old_doc] = _flat(left, "a_score")
        known = score > 0
        q_item = np.searchsorted(items, _flat(left, "q_item"))
        q_weight = _flat(left, "q_weight")
        q_term = left.column("q_term").drop_null().combine_chunks()
        q_term = pc.list_flatten(q_term) if len(q_term) else pa.array([], pa.string())
        if len(postings) and len(q_term):
            place = pc.index_in(q_term, postings.column("term").combine_chunks())
            place = np.asarray(pc.fill_null(place, -1))
            by_place = np.argsort(place, kind="stable")
            sorted_place = place[by_place]
            begins = np.flatnonzero(np.append(True, sorted_place[1:] != sorted_place[:-1]))
            for begin, end in zip(begins, np.append(begins[1:], len(place)), strict=True):
                row = sorted_place[begin]
                if row >= 0:
                    mine = by_place[begin:end]
                    held = slice(ends[row - 1] if row else 0, ends[row])
                    # An item has a term once, and a term has a document once.
                    score[np.ix_(q_item[mine], docs[held])] += np.outer(q_weight[mine], factors[held])
        admit = np.asarray(_flat(left, "l_admit"), dtype=bool)[order]
        best = _flat(left, "l_best")[order]
        keep = (score > 0) & (known | admit[:, None])
        score[~keep] = 0
        if n_docs > top:
            best = np.maximum(best, np.partition(score, n_docs - top, axis=1)[:, n_docs - top])
        floor = best - _flat(left, "l_after")[order]
        item, doc = np.nonzero(keep & (score >= floor[:, None]))
        value = score[item, doc]
        if last:
            ids = heads.column("factors").combine_chunks()[0].values
            return pa.table(
                {
                    "item": pa.array(items[item]),
                    "doc_id": ids.take(pa.array(doc)),
                    "score": pa.array(value),
                }
            )
        high = value >= best[item]

        def one(values, kind) -> pa.Array:
            return pa.array([values], pa.list_(kind))

        return pa.table(
            {
                "bundle": pa.array([key[0].as_py()], pa.int32()),
                "block": pa.array([key[1].as_py()], pa.int64()),
                "a_item": one(items[item], pa.int64()),
                "a_doc": one(doc.astype(np.int32), pa.int32()),
                "a_score": one(value, pa.int64()),
                "t_item": one(items[item[high]], pa.int64()),
                "t_score": one(value[high], pa.int64()),
            }
        )

    return run


def _tenth_best(carried: DataFrame, top: int) -> DataFrame:
    """Score of the tenth best document of each item so far; only items that have ten."""
    seen = carried.select(F.explode(F.arrays_zip("t_item", "t_score")).alias("t")).select(
        F.col("t.t_item").alias("item"), F.col("t.t_score").alias("score")
    )
    ranked = seen.withColumn(
        "nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    ).where(F.col("nth") <= top)
    best = ranked.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("best"))
    return best.where(F.col("n") == top).select("item", "best")


def _padded(df: DataFrame) -> DataFrame:
    """All columns of the left side; what ``df`` lacks is null."""
    fields = [f.strip().split(" ") for f in LEFT.split(",")]
    return df.select(
        *[
            (F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n)
            for n, kind in fields
        ]
    )


def search(items: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item."""
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _query_terms, "item_id long, term string, h long"
    )
    terms = terms.groupBy("item_id", "term", "h").agg(F.count("*").alias("times"))
    terms = written(terms, "item-terms")
    bits = bitmap(terms, "h", BITS)

    counted = docs.select("text").mapInArrow(_counts(bits), "term string, docs long, terms long")
    counted = written(
        counted.groupBy("term").agg(F.sum("docs").alias("df"), F.sum("terms").alias("terms")),
        "term-counts",
    )
    row = counted.where("term IS NULL").first()
    n_docs, n_terms = (row["df"], row["terms"]) if row else (0, 0)
    ratio = (2 * F.lit(n_docs).cast("double") + 2) / (2 * F.col("df") + 1)
    weighed = (
        terms.join(counted.where("term IS NOT NULL").select("term", "df"), "term")
        .withColumn("weight", F.floor(1000 * F.log(ratio)).cast("long"))
        .withColumn("bin", F.col("h").bitwiseAND(F.lit(BINS - 1)).cast("int"))
    )
    held = weighed.select("term", "bin", "df").distinct().groupBy("bin").agg(F.sum("df").alias("df"))
    owner_of_bin = F.lit(len(OWNERS) - 1)
    for k in range(len(OWNERS) - 2, -1, -1):
        owner_of_bin = F.when(F.col("df") * OWNERS[k] <= n_docs, k).otherwise(owner_of_bin)
    bins = held.select("bin", owner_of_bin.cast("int").alias("owner"))
    owners = np.zeros(BINS, dtype=np.int8)
    listed = bins.toArrow()  # at most BINS rows
    owners[listed["bin"].to_numpy()] = listed["owner"].to_numpy()

    known = written(terms.select("item_id").distinct(), "items").withColumn(
        "item", F.monotonically_increasing_id()
    )
    n_bundles = max(1, -(-known.count() // ITEMS))
    known = known.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(n_bundles)).cast("int"))
    known = written(known, "numbered-items")
    weighed = weighed.join(bins, "bin").join(
        known.withColumnRenamed("item_id", "known_id"),
        F.col("item_id").eqNullSafe(F.col("known_id")),
    )
    weighed = written(
        weighed.select(
            "bundle", "item", "term", "owner", (F.col("weight") * F.col("times")).alias("weight")
        ),
        "weighed-terms",
    )

    postings = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _postings(bits, owners, n_docs, n_terms),
            "block long, owner int, term string, docs array<int>, factors array<long>",
        ),
        "postings",
        by="owner",
    )
    heads = postings.where(F.col("owner") == len(OWNERS))
    every_bundle = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")
    places = heads.select(
        "block", every_bundle, F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")
    )
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))

    carried, best = None, None
    for stage in range(len(OWNERS)):
        last = stage == len(OWNERS) - 1
        bound = F.col("weight") * UNIT
        limits = weighed.groupBy("bundle", "item").agg(
            F.sum(F.when(F.col("owner") >= stage, bound).otherwise(0)).alias("before"),
            F.sum(F.when(F.col("owner") > stage, bound).otherwise(0)).alias("after"),
        )
        limits = (
            limits.withColumn("best", F.lit(0).cast("long"))
            if best is None
            else limits.join(best, "item", "left").withColumn("best", F.coalesce("best", F.lit(0)))
        )
        limits = limits.select(
            "bundle",
            F.struct(
                "item", (F.col("before") >= F.col("best")).alias("admit"), "best", "after"
            ).alias("l"),
        )
        own = weighed.where(F.col("owner") == stage).groupBy("bundle").agg(
            F.collect_list(F.struct("item", "term", "weight")).alias("q")
        )
        bundles = (
            limits.groupBy("bundle")
            .agg(F.collect_list("l").alias("l"))
            .join(own, "bundle", "left")
            .select(
                "bundle",
                every_salt.alias("salt"),
                *[F.col(f"q.{c}").alias(f"q_{c}") for c in ("item", "term", "weight")],
                *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("item", "admit", "best", "after")],
            )
        )
        left = _padded(places.join(bundles, ["bundle", "salt"]))
        if carried is not None:
            left = left.unionByName(_padded(carried))
        wanted = (F.col("owner") == stage) | ((F.col("owner") == len(OWNERS)) & F.lit(last))
        right = postings.where(wanted).select(every_bundle, "block", "term", "docs", "factors")
        joined = left.groupBy("bundle", "block").cogroup(right.groupBy("bundle", "block"))
        result = joined.applyInArrow(_stage(top, last), CHOSEN if last else CARRIED)
        if not last:
            carried = written(result, f"accumulators-{stage}")
            best = _tenth_best(carried, top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(known.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score"
    )


def digest(items: DataFrame, docs: DataFrame) -> DataFrame:
    return search(items, docs)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def oracle() -> str:
    """The same ranking in SQL."""
    def terms(table: str, key: str) -> str:
        return (
            f"SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), "
            f"'{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM {table}"
        )

    return f"""
    WITH d AS ({terms("documents", "doc_id")}),
    q AS (SELECT item_id, term, count(*) AS times
          FROM ({terms("benchmark", "item_id")}) GROUP BY ALL),
    size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM size),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d
           WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))
                            AS BIGINT) AS w
          FROM tf, total GROUP BY term),
    scored AS (
      SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) //
             (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM tf JOIN q USING (term) JOIN w USING (term) JOIN size USING (doc_id), total
      GROUP BY item_id, doc_id),
    ranked AS (
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id
             ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= {TOP}
    """
