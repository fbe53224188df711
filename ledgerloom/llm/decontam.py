"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lowered and parted at ASCII punctuation.  A seed is an n-gram of a test item that
chance would rarely make: the product of its words' frequencies in the whole corpus is at most
``RARE``.  Frequencies of single words hardly move when items leak, so a leaked item keeps its
seeds however often it was copied.  An item always has its rarest third as seeds, and the
rarest of every ``PASSAGE`` words in a row; an item shorter than a seed is looked up as a
whole.  Every place of a text where a seed occurs gives a region, in which the whole item is
aligned; a text holds an item if the best alignment reaches ``THRESHOLD`` of the score of the
item with itself, or the score of ``PASSAGE`` words in a row, however long the item is.  Of an
item under ``SHORT`` words more than that share is asked; one under ``SHORT_WORDS`` words is
found only in texts with at most twice its words.

Test items go to the tasks in slices of at most ``SLICE_WORDS`` words (one longer item is a
slice of its own); a larger benchmark takes several passes, so nothing unbounded is
broadcast.  Regions are aligned in blocks of bounded size in the task that read the text:
the texts are not shuffled.

Null or empty texts hold nothing, null or empty items are held by nothing.  Repeated rows
and items are reported each.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import whole_text, words
from ledgerloom.llm.vector import Words, chunks, grams, inside

SEED = 3
RARE = 1e-7
THRESHOLD = 0.5
# So many words of an item in a row are a leak by themselves.
PASSAGE = 13
SHORT, SHORT_THRESHOLD, SHORT_WORDS = 8, 0.75, 5
MATCH, MISMATCH, GAP = 2, -1, -1
SLICE_WORDS = 1_000_000
# Cells of the alignment tables a task holds at a time.
CELLS = 2_000_000


@dataclass(frozen=True)
class Items:
    """Test items of a slice as word hashes, and their seeds sorted by hash."""

    ids: list
    words: list
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row of ``a`` with the same row of ``b``, and its end in b.

    A linear gap lets a row of the table be finished by a running maximum.  Zero is padding
    and matches nothing.
    """
    n, width = b.shape
    slope = -GAP * np.arange(width, dtype=np.int32)
    last = np.zeros((n, width), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(a.shape[1]):
        word = a[:, i : i + 1]
        score = np.where((b == word) & (word != 0), MATCH, MISMATCH).astype(np.int32)
        score[:, 1:] += last[:, :-1]
        np.maximum(score, last + GAP, out=score)
        np.maximum(score, 0, out=score)
        score += slope
        np.maximum.accumulate(score, axis=1, out=score)
        score -= slope
        top = score.max(axis=1)
        better = top > best
        if better.any():
            end[better] = score[better].argmax(axis=1)
            best = np.maximum(best, top)
        last = score
    return best, end


def needed(length: int) -> float:
    """Score from which a text holds an item of so many words."""
    own = MATCH * length
    if length < SHORT:
        return max(SHORT_THRESHOLD * own, min(own, MATCH * SHORT_WORDS))
    return min(THRESHOLD * own, MATCH * PASSAGE)


def _seeds(of_items: list[np.ndarray], rate: dict[int, float]) -> tuple[np.ndarray, ...]:
    """Seed hash, item number and place in the item, sorted by hash."""
    hashes, items, places = [], [], []
    for i, w in enumerate(of_items):
        if not len(w):
            continue
        n = min(SEED, len(w))
        one = _as_words(w)
        chance = np.array([rate.get(int(h), 0.0) for h in w])
        together = np.ones(len(w) - n + 1)
        for k in range(n):
            together = together * chance[k : k + len(together)]
        # A shorter item is one seed; its hash is that of so many words.
        keep = together <= RARE
        keep[np.argsort(together, kind="stable")[: -(-len(together) // 3)]] = True
        wide = PASSAGE - n + 1
        if len(together) > wide:
            views = np.lib.stride_tricks.sliding_window_view(together, wide)
            keep[views.argmin(axis=1) + np.arange(len(views))] = True
        chosen = np.flatnonzero(keep)
        hashes.append(grams(one, n)[chosen] ^ np.uint64(n))
        items.append(np.full(len(chosen), i))
        places.append(chosen)
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    seed, item, place = map(np.concatenate, (hashes, items, places))
    order = np.argsort(seed, kind="stable")
    return seed[order], item[order], place[order]


def _as_words(hashes: np.ndarray) -> Words:
    one = Words.__new__(Words)
    one.hash = hashes
    one.starts = hashes
    one.doc = np.zeros(len(hashes), dtype=np.int64)
    return one


def _count(wanted: np.ndarray):
    """Occurrences of the benchmark's words in a task's texts, and of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(wanted), dtype=np.int64), 0
        for batch in batches:
            for _, w in chunks(batch.column(0), plain=True):
                total += len(w)
                if len(wanted):
                    at = np.searchsorted(wanted, w.hash)
                    at[at == len(wanted)] = 0
                    hit = at[wanted[at] == w.hash]
                    counts += np.bincount(hit, minlength=len(wanted))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(seen, -1)),
                pa.array(np.append(counts[seen], total)),
            ],
            names=["place", "n"],
        )

    return run


def _slice(frame: list, docs: DataFrame) -> Items:
    """Items of one slice with the seeds their words' corpus frequencies allow."""
    ids = [r["item_id"] for r in frame]
    of_items: list[np.ndarray] = []
    for _, w in chunks(pa.array([r["text"] for r in frame], pa.string()), plain=True):
        of_items += [w.hash[f : f + n] for f, n in zip(w.first, w.counts, strict=False)]
    wanted = np.unique(np.concatenate(of_items)) if of_items else np.zeros(0, dtype=np.uint64)
    counted = (
        docs.select(whole_text())
        .mapInArrow(_count(wanted), "place long, n long")
        .groupBy("place")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    n = {r["place"]: r["n"] for r in counted}
    total = max(1, n.pop(-1, 1))
    rate = {int(wanted[p]): c / total for p, c in n.items()}
    return Items(ids, of_items, *_seeds(of_items, rate))


def regions(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and number of the stretch in which the item would begin."""
    found = []
    lengths = np.array([max(1, len(x)) for x in items.words], dtype=np.int64)
    for n in range(1, SEED + 1):
        if len(w) < n or not len(items.seed):
            continue
        hashes = grams(w, n) ^ np.uint64(n)
        low = np.searchsorted(items.seed, hashes)
        low[low == len(items.seed)] = 0
        hits = np.flatnonzero((items.seed[low] == hashes) & inside(w, n))
        if not len(hits):
            continue
        first = low[hits]
        upto = np.searchsorted(items.seed, hashes[hits], side="right")
        many = upto - first
        at = np.repeat(hits, many)
        which = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
        item = items.item[which]
        begin = at - w.first[w.doc[at]] - items.place[which]
        found.append(np.stack([w.doc[at], item, begin // stretch(lengths[item])], axis=1))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    unique = np.unique(np.concatenate(found), axis=0)
    return unique[:, 0], unique[:, 1], unique[:, 2]


def stretch(length):
    return np.maximum(16, length // 2)


def matches(w: Words, items: Items) -> list[tuple[int, int, float, int, int]]:
    """Text, item, share of the item's own score, first and last word (end exclusive)."""
    doc, item, part = regions(w, items)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    order = np.argsort([len(items.words[i]) for i in item], kind="stable")
    at = 0
    while at < len(order):
        length = len(items.words[item[order[at]]])
        step = int(stretch(length))
        pad = length // 4 + 4
        width = length + step + 2 * pad
        room = max(1, CELLS // width)
        group = order[at : at + room]
        group = group[[len(items.words[i]) == length for i in item[group]]]
        at += len(group)
        a = np.stack([items.words[i] for i in item[group]])
        b = np.zeros((len(group), width), dtype=np.uint64)
        begin = np.maximum(0, part[group] * step - pad)
        for k, (d, s) in enumerate(zip(doc[group], begin, strict=True)):
            words_of = w.hash[w.first[d] + s : min(w.first[d] + s + width, w.first[d + 1])]
            b[k, : len(words_of)] = words_of
        score, end = align(a, b)
        share = score / (MATCH * length)
        enough = score >= needed(length)
        if length < SHORT_WORDS:
            # So few words stand in any text; only a text of about their length is the item.
            enough &= w.counts[doc[group]] <= 2 * length
        for k in np.flatnonzero(enough):
            back, left = align(a[k : k + 1, ::-1], b[k : k + 1, : end[k] + 1][:, ::-1])
            start = int(begin[k]) + int(end[k]) - int(left[0])
            key = (int(doc[group[k]]), int(item[group[k]]))
            value = (float(share[k]), -start, int(begin[k]) + int(end[k]) + 1)
            best[key] = max(best.get(key, value), value)
    return [(d, i, s, -f, e) for (d, i), (s, f, e) in sorted(best.items())]


def slices(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in bounded parts, each with its seeds."""
    counted = benchmark.select(
        "item_id", "text", F.size(words(whole_text())).alias("n_words")
    )
    total = counted.agg(F.sum("n_words")).first()[0] or 0
    parts = -(-total // SLICE_WORDS)
    for k in range(parts):
        mine = counted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield _slice(mine.select("item_id", "text").collect(), docs)


FOUND = "doc_id long, item_id long, similarity double, first_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item it holds: the best alignment."""
    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    result = docs.sparkSession.createDataFrame([], FOUND)
    for items in slices(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items):
            for batch in batches:
                for start, w in chunks(batch.column(1), plain=True):
                    rows = matches(w, items)
                    if rows:
                        doc, item, share, first, end = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array([start + d for d in doc])),
                                pa.array([items.ids[i] for i in item], pa.int64()),
                                pa.array(share),
                                pa.array(first, pa.int64()),
                                pa.array(end, pa.int64()),
                            ],
                            names=[f.split(" ")[0] for f in FOUND.split(", ")],
                        )

        result = result.unionByName(narrow.mapInArrow(run, FOUND))
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item; all columns, nothing is shuffled."""
    place = docs.columns.index("text")
    for items in slices(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for start, w in chunks(batch.column(place), plain=True):
                    for d, *_ in matches(w, items):
                        clean[start + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs.select("doc_id", "text"), benchmark)
