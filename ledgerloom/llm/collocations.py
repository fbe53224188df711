"""Frequent phrases and how far their parts hang together, by HAT-trie counting.

Texts are cut into pieces and words.  Each task counts phrases in a shallow trie over word
ids: a container is a hash table of phrases for a range of word ids; one that grows too large
bursts into two ranges, or, when it holds a single word, into a node whose containers go by the
next word.  When the trie is full, its largest subtrees leave it as sorted runs; at the end all
do.  Runs are dealt by the first two words of their phrases and merged there.  There are as
many tasks as run at a time, so that a trie is handed on once a core, not once a file.

All parts of a frequent phrase are frequent themselves.  So words, then pairs of frequent
words, then threes of frequent pairs are tallied by their hashes first, and only phrases
without a rare part of up to three words enter the tries.  Hashes that are frequent are kept
in bitmaps of fixed size; these, or two words with one hash, may let through a few others and
lose none.  Counts come from the tries and are those of the phrases.

Null texts are empty and null languages ``und``; empty texts add nothing; repeated rows count
again; doc_id and other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bitmap, hit, written
from ledgerloom.llm.vector import Words, chunks, mix

LEAST = 100
LONGEST = 5
TOP = 2000
BITS = 1 << 24
# Phrases in a container before it bursts, and in a trie before subtrees are spilled.
BURST = 1 << 14
FULL = 600_000
# Hashes a task tallies before it hands them on.
TALLIED = 1 << 21
# Lengths that are tallied by hash.
LEVELS = 3
# Parts of a language that are ranked before all of it is.
RANKED = 64
# Words of a phrase by which its run is dealt to a partition.
PREFIX = 2

_PIECE = np.zeros(256, dtype=bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_ENDS = _PIECE.copy()
_ENDS[[9, 32]] = True


def _joined(words: Words) -> np.ndarray:
    """For each word but the last: whether the next one is in the same piece."""
    breaks = np.concatenate([[0], np.cumsum(_PIECE[words.raw])])
    same = breaks[words.starts[1:]] == breaks[words.ends[:-1]]
    return same & (words.doc[1:] == words.doc[:-1])


class Pieces:
    """Words of some texts with one space between those of a piece, for slicing phrases."""

    def __init__(self, words: Words, joined: np.ndarray) -> None:
        raw = words.raw
        edges = np.zeros(len(raw) + 1, dtype=np.int8)
        edges[words.starts] += 1
        edges[words.ends] -= 1
        keep = np.cumsum(edges[:-1], dtype=np.int8) > 0
        gaps = words.starts[1:][joined] - 1
        keep[gaps] = True
        text = raw.copy()
        text[gaps] = 32
        place = np.concatenate([[0], np.cumsum(keep)])
        self.starts, self.ends = place[words.starts], place[words.ends]
        self.text = text[keep].tobytes()


def _word_ids(phrases: list[bytes], depth: int) -> np.ndarray:
    """Ids of the word at ``depth`` of each phrase."""
    words = [p.split(b" ", depth + 1)[depth] for p in phrases]
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    return Words(raw, np.array([0, len(raw)]), separators=_ENDS).hash


def _add(container: dict, phrases: np.ndarray, counts: np.ndarray) -> None:
    for phrase, count in zip(phrases.tolist(), counts.tolist(), strict=True):
        container[phrase] = container.get(phrase, 0) + count


class Trie:
    """Counts of phrases.

    A node has the count of what ends there, sorted lower ends of ranges of word ids, and for
    each range a container, or the node of a single word, whose ranges go by the next word.
    """

    def __init__(self, depth: int = 0) -> None:
        self.depth = depth
        self.own: dict[bytes, int] = {}
        self.lows = np.zeros(1, dtype=np.uint64)
        self.children: list = [{}]

    def add(self, ids: np.ndarray, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of phrases of one length; ``ids`` has a row of word ids for each."""
        if not len(phrases):
            return
        if ids.shape[1] == self.depth:
            _add(self.own, phrases, counts)
            return
        order = np.argsort(ids[:, self.depth], kind="stable")
        where = np.searchsorted(self.lows, ids[order, self.depth], side="right") - 1
        begins = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        full = []
        for begin, end in zip(begins, np.append(begins[1:], len(order)), strict=True):
            mine, at = order[begin:end], int(where[begin])
            child = self.children[at]
            if isinstance(child, Trie):
                child.add(ids[mine], phrases[mine], counts[mine])
            else:
                _add(child, phrases[mine], counts[mine])
                if len(child) > BURST:
                    full.append(at)
        for at in reversed(full):
            self._burst(at)

    def _burst(self, at: int) -> None:
        """Cut a range in two, or give the only word seen in it a node of its own."""
        child = self.children[at]
        phrases = list(child)
        ids = _word_ids(phrases, self.depth)
        seen = np.unique(ids)
        if len(seen) > 1:
            middle = seen[len(seen) // 2]
            low, high = {}, {}
            for phrase, right in zip(phrases, (ids >= middle).tolist(), strict=True):
                (high if right else low)[phrase] = child[phrase]
            lows, children = [self.lows[at], middle], [low, high]
        else:
            node = Trie(self.depth + 1)
            for phrase, count in child.items():
                ends = phrase.count(b" ") == self.depth
                (node.own if ends else node.children[0])[phrase] = count
            lows, children = [seen[0]], [node]
            if self.lows[at] < seen[0]:
                lows, children = [self.lows[at], *lows], [{}, *children]
            after = np.append(self.lows, np.uint64(2**64 - 1))[at + 1]
            if seen[0] < after - np.uint64(1):
                lows, children = [*lows, seen[0] + np.uint64(1)], [*children, {}]
        self.lows = np.concatenate(
            [self.lows[:at], np.array(lows, dtype=np.uint64), self.lows[at + 1 :]]
        )
        self.children[at : at + 1] = children

    def sizes(self) -> list[int]:
        return [sum(c.sizes()) + len(c.own) if isinstance(c, Trie) else len(c) for c in self.children]

    def rows(self) -> list[tuple[bytes, int]]:
        found = list(self.own.items())
        for child in self.children:
            found.extend(child.rows() if isinstance(child, Trie) else child.items())
        return found

    def cut(self, at: int) -> list[tuple[bytes, int]]:
        """A subtree's phrases in order; it is empty afterwards."""
        child = self.children[at]
        self.children[at] = {}
        return sorted(child.rows() if isinstance(child, Trie) else child.items())


def _run(lang: str, rows: list[tuple[bytes, int]]) -> pa.RecordBatch:
    phrases = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
    counts = pa.array([r[1] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(rows), pa.string()), phrases, counts], names=["lang", "phrase", "n"]
    )


def _spilled(tries: dict[str, Trie], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of the largest subtrees, until no more than ``most`` phrases are left."""
    subtrees = [(n, lang, at) for lang, t in tries.items() for at, n in enumerate(t.sizes())]
    left = sum(s[0] for s in subtrees)
    for n, lang, at in sorted(subtrees, reverse=True):
        if left <= most or not n:
            break
        yield _run(lang, tries[lang].cut(at))
        left -= n


_STEP = np.uint64(0xD6E8FEB86659FD93)


def _keys(words: Words, lang: str) -> np.ndarray:
    """Hash of every word together with the language."""
    seed = hashlib.blake2b(lang.encode(), digest_size=8).digest()
    return mix(words.hash ^ np.frombuffer(seed, dtype=np.uint64)[0])


def _levels(words: Words, lang: str, seen: list[np.ndarray], longest: int):
    """For 1 to ``longest`` words: hash of the phrase from each place on, and whether it is one
    whose parts, as far as there are bitmaps of their lengths, have all been seen."""
    keys, joined = _keys(words, lang), _joined(words)
    named, whole = keys, np.ones(len(words), dtype=bool)
    for n in range(1, longest + 1):
        if n > 1:
            size = max(0, len(words) - n + 1)
            whole = whole[:size] & whole[1 : size + 1]
            if n == 2:
                whole &= joined
            named = mix(named[:size] * _STEP + keys[n - 1 : n - 1 + size])
        if n <= len(seen):
            whole = whole & hit(seen[n - 1], named)
        yield n, named, whole


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    lang = pc.fill_null(batch.column(0), "und")
    for one in pc.unique(lang):
        yield one.as_py(), batch.column(1).filter(pc.equal(lang, one))


def _tallies(seen: list[np.ndarray]):
    """Hashes of phrases one word longer than those seen, and how often a task has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for lang, texts in _by_language(batch):
                for _, words in chunks(texts, lower=True, separators=_ENDS):
                    if len(words):
                        *_, (_, named, whole) = _levels(words, lang, seen, len(seen) + 1)
                        held.append(np.unique(named[whole], return_counts=True))
            if sum(len(k) for k, _ in held) > TALLIED:
                held = [_combined(held)]
                if len(held[0][0]) > TALLIED // 2:
                    yield _tally(*held.pop())
        if held:
            yield _tally(*_combined(held))

    return run


def _combined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(parts) for parts in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _tally(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"]
    )


def _runs(seen: list[np.ndarray]):
    """Runs of phrases without a rare part, and the words in all of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                trie = tries.setdefault(lang, Trie())
                for _, words in chunks(texts, lower=True, separators=_ENDS):
                    if len(words):
                        yield _run_total(lang, len(words))
                        _count(trie, words, lang, seen)
            if sum(sum(t.sizes()) for t in tries.values()) > FULL:
                yield from _spilled(tries, FULL // 2)
        yield from _spilled(tries, 0)

    return run


def _count(trie: Trie, words: Words, lang: str, seen: list[np.ndarray]) -> None:
    pieces = Pieces(words, _joined(words))
    for n, named, whole in _levels(words, lang, seen, LONGEST):
        at = np.flatnonzero(whole)
        _, first, counts = np.unique(named[at], return_index=True, return_counts=True)
        at = at[first]
        spots = zip(pieces.starts[at].tolist(), pieces.ends[at + n - 1].tolist(), strict=True)
        phrases = np.empty(len(at), dtype=object)
        phrases[:] = [pieces.text[s:e] for s, e in spots]
        trie.add(words.hash[at[:, None] + np.arange(n)], phrases, counts)


def _run_total(lang: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([None], pa.string()), pa.array([n], pa.int64())],
        names=["lang", "phrase", "n"],
    )


def _narrow(docs: DataFrame) -> DataFrame:
    """What is read of a table, in no more tasks than run at a time.

    Each task hands on every frequent phrase it has met, and there are more of these in more
    text: with a task for each stretch of input, rows would grow as the product of both.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    return rows.coalesce(docs.sparkSession.sparkContext.defaultParallelism)


def _seen(docs: DataFrame, tally, least: int) -> np.ndarray:
    """Bitmap of the hashes that occur often enough."""
    # A task names a hash once, so that nothing is gained by adding before the exchange.
    rows = _narrow(docs).mapInArrow(tally, "h long, n long").repartition("h")
    often = rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return bitmap(often, "h", BITS)


def _merged(runs: DataFrame) -> DataFrame:
    """Counts of all runs, merged where their prefix partitions are."""
    prefix = F.xxhash64("lang", F.substring_index("phrase", " ", PREFIX))
    dealt = runs.withColumn("prefix", prefix).repartition("prefix")
    return dealt.groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("n")).drop("prefix")


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("w", first, count), " ")


def score() -> Column:
    """floor(1000 a n / (l r)), exact: the products are decimals of 38 digits."""
    a, n, left, right = (F.col(c).cast("decimal(19,0)") for c in ("a", "total", "l", "r"))
    above = (a * F.lit(Decimal(1000))).cast("decimal(22,0)") * n
    return F.call_function("div", above.cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language."""
    seen: list[np.ndarray] = []
    for _ in range(LEVELS):
        seen.append(_seen(docs, _tallies(list(seen)), least))
    runs = _narrow(docs).mapInArrow(_runs(seen), "lang string, phrase string, n long")
    often = (F.col("n") >= least) | F.col("phrase").isNull()
    found = written(_merged(runs).where(often), "phrases")
    totals = found.where("phrase IS NULL").select("lang", F.col("n").alias("total"))
    counts = found.where("phrase IS NOT NULL")
    phrases = counts.withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " ", -1))
    size = F.size("w")
    phrases = phrases.where(size > 1)

    # Places inside a longer phrase: where they begin and how many words they have.
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m"))),
        )
    )
    inner = phrases.where(size > 2).select("lang", "a", "w", F.explode(spans).alias("s"))
    inner = inner.select("lang", _part(F.col("s.i"), F.col("s.m")).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    alone = phrases.join(inner, ["lang", "phrase"], "left").where(
        F.col("covered").isNull() | (F.col("covered") < F.col("a"))
    )

    cuts = alone.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        _part(F.lit(1), F.col("k")).alias("left"),
        _part(F.col("k") + 1, size - F.col("k")).alias("right"),
    )
    of_left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    of_right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))

    scored = (
        cuts.join(of_left, ["lang", "left"])
        .join(of_right, ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", score())
    )
    best = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = best.withColumn("part", part).withColumn("rank", in_part).where(F.col("rank") <= top)
    in_all = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (
        best.withColumn("rank", in_all)
        .where(F.col("rank") <= top)
        .select(
            "lang",
            F.col("rank").cast("long").alias("rank"),
            "phrase",
            "a",
            "cut.l",
            "cut.r",
            "n",
            F.col("cut.score").cast("long").alias("score"),
        )
    )


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """The same phrases in SQL."""
    return f"""
    WITH piece AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                    '[^.,;:!?\x0A-\x0D]+')) AS piece
      FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
    gram AS (
      SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
            FROM (SELECT lang, w, unnest(range(1, {LONGEST + 1})) AS m FROM w))),
    total AS (SELECT lang, count(*) AS n FROM gram WHERE m = 1 GROUP BY lang),
    f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w
          FROM gram GROUP BY lang, m, phrase HAVING count(*) >= {least}),
    inside AS (
      SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS covered
      FROM (SELECT lang, w, f, k, unnest(range(1, m - k + 2)) AS i
            FROM (SELECT lang, w, f, m, unnest(range(2, m)) AS k FROM f WHERE m > 2))
      GROUP BY ALL),
    alone AS (
      SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase)
      WHERE m > 1 AND (covered IS NULL OR covered < f)),
    cut AS (
      SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS part,
             array_to_string(w[k + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, m)) AS k FROM alone)),
    scored AS (
      SELECT lang, cut.phrase, a, k, x.f AS l, y.f AS r, n,
             CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM cut JOIN total USING (lang)
      JOIN (SELECT lang, phrase AS part, f FROM f) x USING (lang, part)
      JOIN (SELECT lang, phrase AS rest, f FROM f) y USING (lang, rest)),
    best AS (
      SELECT * FROM scored
      QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
             phrase, a, l, r, n, score
      FROM best)
    SELECT * FROM ranked WHERE rank <= {top}
    """
