"""Language-model scores by a hierarchical Pitman-Yor process over pairs of words.

A token follows the word before it.  Every word that occurs as a context is a restaurant; the
contexts whose words end alike share a parent restaurant, a class; all classes share the
restaurant of single words, whose base is uniform over the words seen in training and one unseen
word.  The customers of a word's restaurant are the training tokens after that word; each table
sends one customer to the parent.  Seatings are sampled by Gibbs sweeps: all customers of a word
in a restaurant stand up and are seated again one by one, given the other words and the parent.
From the 32nd customer of a word on they are seated in groups that grow by an eighth, with the
expected number of new tables rounded at random.  Random numbers are hashes of word, context,
customer and sweep, so a sweep can be repeated anywhere and gives the same result.  Scores
average the predictive probabilities of the sampled seatings.

How it runs: a task turns its texts into blocks of about ``BLOCK`` tokens, numbers in the
block's list of words.  A block asks the range of a pair's hash how often the pair occurs in
training; the first block that asks owns the pair, and only its owner counts the pair's tables.
Blocks send the tables of their pairs, added up by (word, class), to the range of the word's
hash, with the word's own customers and tables as a context.  The ranges sample the parents and
send each block the probabilities and totals it needs; blocks then seat the pairs again
(``PAIR_SWEEPS`` times) and score.  A pair in several blocks gets the same tables in each.  Only
totals per class reach the driver.  Words are told apart by 58 bits of their hash, pairs by
20 bits more than it takes to number the bytes of the corpus, 62 at most.

Null texts are empty texts: one end token.  A null doc_id belongs to the training part.
Repeated rows are texts of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_shuffles, release, whole_text, written
from ledgerloom.llm.vector import Words, chunks, mix

CLASSES = 64
BLOCK = 2_200_000
BYTES_PER_RANGE = 16 << 20
SWEEPS = 2  # in each of two rounds; the sweeps of the last round are averaged
PAIR_SWEEPS = 2  # of the restaurants of single words, all averaged
PARTS = 2  # of the blocks, scored one after the other
ONE_BY_ONE = 32
CONCENTRATION = 1.0
START = 0
LOW = np.uint64(CLASSES - 1)
END = np.uint64(0xE5D0000000000000) & ~LOW

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths binary, data binary"
# Messages between blocks and ranges; ``part`` is a range, or what a block keeps for itself.
MESSAGE = "block long, part int, sweep int, data binary"
PAIRS, TABLES = -1, -2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; the reader knows their types."""
    parts = []
    for a in arrays:
        parts += [np.int64(a.nbytes).tobytes(), np.ascontiguousarray(a).tobytes()]
    raw = b"".join(parts)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = pa.decompress(
        data[8:], decompressed_size=int(np.frombuffer(data[:8], np.int64)[0]), codec="zstd", asbytes=True
    )
    at, result = 0, []
    for t in types:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        result.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at + 8))
        at += 8 + size
    return result


def held_out(doc_id, modulus: int = 5) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 1


def planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all first bytes first; small numbers compress well that way."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.ravel()


def unplanes(raw: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def steps(a: np.ndarray) -> np.ndarray:
    """Numbers, most of them ascending, as planes of their differences."""
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def unsteps(raw: np.ndarray, kind) -> np.ndarray:
    return np.cumsum(unplanes(raw, kind), dtype=kind)


def tokens_of(words: Words) -> np.ndarray:
    """Every token, ends included, as the word's hash with the class of its own ending."""
    n, docs = len(words), words.n_docs
    last = words.raw[words.ends - 1].astype(np.uint64)
    before = words.raw[np.maximum(words.ends - 2, 0)].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, before, np.uint64(0))
    ending = mix(last * np.uint64(256) + before) % np.uint64(CLASSES - 1) + np.uint64(1)
    token = np.empty(n + docs, dtype=np.uint64)
    # Each text gets one place more, for its end.
    token[np.arange(n) + words.doc] = words.hash & ~LOW | ending
    token[words.first[1:] + np.arange(docs)] = END | np.uint64(START)
    return token


def _firsts(a: np.ndarray) -> np.ndarray:
    """Where each value of sorted numbers begins."""
    return np.flatnonzero(np.append(True, a[1:] != a[:-1]))


class Block:
    """The tokens of some texts and the pairs they form, by number of the word.

    The end of the text before stands for the start of a text.  Pairs are sorted by word and
    then context; ``place`` says which pair each token is, ``parent`` which key of the parent
    restaurants each pair has.
    """

    def __init__(self, docs: dict) -> None:
        ranked, words, frequent = unpack(docs["data"], np.uint8, np.uint8, np.uint8)
        self.token = unsteps(frequent, np.int32)[unplanes(ranked, np.int32)]
        self.words = unsteps(words, np.uint64)
        self.lengths = np.frombuffer(docs["lengths"], np.int64)
        n = len(self.words)
        train = np.repeat(~np.array(docs["held"], dtype=bool), self.lengths)
        self.seen = np.bincount(self.token[train], minlength=n).astype(np.int32)
        # Sorted with a last bit for training tokens; that is faster and smaller than an order.
        pair = self._pairs()
        pair *= 2
        pair += train
        pair.sort()
        first = _firsts(pair >> 1)
        self.count = np.add.reduceat(pair & 1, first).astype(np.int32)
        self.word, self.context = np.divmod(pair[first] >> 1, n)

    def _pairs(self) -> np.ndarray:
        """The number of each token's pair."""
        pair = self.token.astype(np.int64)
        pair *= len(self.words)
        pair[0] += np.searchsorted(self.words, END)
        pair[1:] += self.token[:-1]
        return pair

    @cached_property
    def place(self) -> np.ndarray:
        pair = self._pairs()
        order = np.argsort(pair)
        new = np.zeros(len(pair), dtype=np.int32)
        new[_firsts(pair[order])[1:]] = 1
        place = np.empty(len(pair), dtype=np.int32)
        place[order] = np.cumsum(new, dtype=np.int32)
        return place

    @cached_property
    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        key = self.words[self.word] & ~LOW | self.words[self.context] & LOW
        return np.unique(key, return_inverse=True)

    key = property(lambda self: self._keys[0])
    parent = property(lambda self: self._keys[1])

    def hashes(self) -> np.ndarray:
        words = self.words & ~LOW
        return mix(words[self.word] + mix(words)[self.context])

    def parts(self, hashes: np.ndarray, n_ranges: int) -> Iterator[tuple[int, int, int]]:
        """The ranges that sorted hashes fall into, with the stretch of each."""
        shift = np.uint64(64 - (n_ranges.bit_length() - 1))
        found, first = np.unique((hashes >> shift).astype(np.int64), return_index=True)
        yield from zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(hashes)], strict=True)

    def shares(self, tables: np.ndarray, own: np.ndarray, n_ranges: int) -> Iterator[tuple]:
        """To the parents: tables of the block's own pairs, by key and by context."""
        mine = np.where(own, tables, 0)
        by_key = np.bincount(self.parent, mine, len(self.key)).astype(np.int32)
        opened = np.bincount(self.context, mine, len(self.words)).astype(np.int32)
        words = {p: slice(a, b) for p, a, b in self.parts(self.words, n_ranges)}
        for p, a, b in self.parts(self.key, n_ranges):
            w = words[p]
            yield p, pack(
                steps(self.key[a:b]),
                planes(by_key[a:b]),
                planes(self.seen[w]),
                planes(opened[w]),
            )


def _messages(rows: list[tuple]) -> pa.Table:
    blocks, parts, sweeps, data = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table(
        {
            "block": pa.array(blocks, pa.int64()),
            "part": pa.array(parts, pa.int32()),
            "sweep": pa.array(sweeps, pa.int32()),
            "data": pa.array(data, pa.binary()),
        }
    )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks: texts to blocks."""
    block = TaskContext.get().partitionId() << 32
    ids, lengths, tokens, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        token = np.concatenate(tokens)
        _, first, inverse, count = np.unique(
            token & ~LOW, return_index=True, return_inverse=True, return_counts=True
        )
        # Tokens as ranks of their words by frequency: most are small numbers.
        frequent = np.argsort(-count, kind="stable").astype(np.int32)
        rank = np.empty_like(frequent)
        rank[frequent] = np.arange(len(frequent), dtype=np.int32)
        data = pack(planes(rank[inverse]), steps(token[first]), steps(frequent))
        columns = {
            "block": pa.array([block], pa.int64()),
            "doc_ids": pa.array([ids], pa.list_(pa.int64())),
            "held": pa.array([[held_out(i) for i in ids]], pa.list_(pa.bool_())),
            "lengths": pa.array([np.concatenate(lengths).astype(np.int64).tobytes()], pa.binary()),
            "data": pa.array([data], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        for start, words in chunks(batch.column(1), lower=True):
            ids += batch.column(0).slice(start, words.n_docs).to_pylist()
            lengths.append(words.counts + 1)
            tokens.append(tokens_of(words))
            size += len(tokens[-1])
            if size >= BLOCK:
                yield flush()
                block, ids, lengths, tokens, size = block + 1, [], [], [], 0
    if ids:
        yield flush()


def _ask(n_ranges: int, bits: int):
    """Blocks: the pairs they hold, with their counts, to the ranges of the pairs' hashes."""
    low = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                hashes = b.hashes()
                order = np.argsort(hashes, kind="stable")
                hashes, count = hashes[order], b.count[order]
                rows = [
                    (row["block"], p, 0, pack(steps(hashes[i:j] >> low), planes(count[i:j])))
                    for p, i, j in b.parts(hashes, n_ranges)
                ]
                yield from _messages(rows).to_batches()

    return run


def _merge(table: pa.Table) -> pa.Table:
    """A range of pairs: to each block that asked, the sums of its pairs and which it owns."""
    table = table.sort_by("block")
    keys, counts = [], []
    for cell in table.column("data"):
        k, c = unpack(cell.as_py(), np.uint8, np.uint8)
        keys.append(unsteps(k, np.uint64))
        counts.append(unplanes(c, np.int32))
    key, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)
    own = np.zeros(len(inverse), dtype=bool)
    own[first] = True
    at, rows = 0, []
    for block, part, k in zip(table["block"].to_pylist(), table["part"].to_pylist(), keys, strict=True):
        mine = slice(at, at + len(k))
        rows.append((block, part, 0, pack(planes(total[inverse[mine]]), np.packbits(own[mine]))))
        at += len(k)
    return _messages(rows)


def _parts(messages: list[dict], *types) -> list[np.ndarray]:
    """What the ranges sent, put together in their order."""
    cells = [
        [unplanes(a, t) for a, t in zip(unpack(m["data"], *[np.uint8] * len(types)), types, strict=True)]
        for m in sorted(messages, key=lambda m: m["part"])
    ]
    return [np.concatenate(arrays) for arrays in zip(*cells, strict=True)]


def _open(n_ranges: int):
    """Blocks: one table for every pair; keep its count and who owns it."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        row = docs.to_pylist()[0]
        b = Block(row)
        cells = []
        for m in sorted(answers.to_pylist(), key=lambda m: m["part"]):
            total, bits = unpack(m["data"], np.uint8, np.uint8)
            total = unplanes(total, np.int64)
            cells.append((total, np.unpackbits(bits, count=len(total)).astype(bool)))
        order = np.argsort(b.hashes(), kind="stable")
        count, own = np.empty(len(order), np.int64), np.empty(len(order), bool)
        count[order] = np.concatenate([c for c, _ in cells])
        own[order] = np.concatenate([o for _, o in cells])
        kept = pack(planes(count), np.packbits(own))
        shares = b.shares((count > 0).astype(np.float64), own, n_ranges)
        ones, twos = (int((own & (count == k)).sum()) for k in (1, 2))
        result = _messages([(row["block"], PAIRS, 0, kept), *((row["block"], p, 0, d) for p, d in shares)])
        # How many pairs occur once and twice, for the discount, in the block's own row.
        return result.append_column("ones", pa.array([ones] + [0] * (len(result) - 1))).append_column(
            "twos", pa.array([twos] + [0] * (len(result) - 1))
        )

    return run


def _kept(messages: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    (data,) = [m["data"] for m in messages if m["part"] == PAIRS]
    count, own = unpack(data, np.uint8, np.uint8)
    count = unplanes(count, np.int64)
    return count, np.unpackbits(own, count=len(count)).astype(bool)


def _from_parents(messages: list[dict], sweep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each key, and of each word the customers and tables as a context."""
    mine = [m for m in messages if m["sweep"] == sweep and m["part"] >= 0]
    base, seen, opened = _parts(mine, np.float32, np.int64, np.int64)
    return base.astype(np.float64), seen, opened


def _reseat(n_ranges: int, discount: float, sweep: int):
    """Blocks: seat the customers of every pair again; new shares to the parents."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        row, messages = docs.to_pylist()[0], answers.to_pylist()
        b = Block(row)
        count, own = _kept(messages)
        base, _, opened = _from_parents(messages, sweep - 1)
        weight = (CONCENTRATION + discount * opened[b.context]) * base[b.parent]
        key = mix(b.hashes() + np.uint64((1 << 40) + sweep))
        tables = seat(count, weight, discount, key)
        kept = pack(planes(tables.astype(np.int32)))
        shares = b.shares(tables, own, n_ranges)
        return _messages(
            [(row["block"], TABLES, sweep, kept), *((row["block"], p, sweep, d) for p, d in shares)]
        )

    return run


def pair_probability(count, tables, seen, opened, base, discount: float) -> np.ndarray:
    """Predictive probability of pairs; ``seen`` and ``opened`` are those of their contexts."""
    n = CONCENTRATION + seen
    return (np.maximum(count - discount * tables, 0) + (CONCENTRATION + discount * opened) * base) / n


def _count(table: pa.Table) -> pa.Table:
    """A range of words: add up the tables of its keys; keep which block asked for which."""
    table = table.sort_by("block")
    keys, counts, words, seen, opened = [], [], [], [], []
    for cell in table.column("data"):
        k, c, n, t = unpack(cell.as_py(), np.uint8, np.uint8, np.uint8, np.uint8)
        k = unsteps(k, np.uint64)
        keys.append(k)
        counts.append(unplanes(c, np.int32))
        words.append(np.unique(k & ~LOW))
        seen.append(unplanes(n, np.int32))
        opened.append(unplanes(t, np.int32))
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    word, place = np.unique(np.concatenate(words), return_inverse=True)

    def added(to: np.ndarray, values: list[np.ndarray], size: int) -> np.ndarray:
        return np.bincount(to, np.concatenate(values), size).astype(np.int64)

    data = pack(
        key,
        added(inverse, counts, len(key)),
        inverse.astype(np.int32),
        table.column("block").to_numpy(),
        np.array([len(k) for k in keys], np.int64),
        added(place, seen, len(word)),
        added(place, opened, len(word)),
    )
    part = table.column("part")[0].as_py()
    return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([data], pa.binary())})


@dataclass(frozen=True)
class Totals:
    """Sums over all words: per class customers and tables, and those of the parent."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float


@dataclass(frozen=True)
class Model:
    n_words: int
    n_tokens: int
    discount: float
    root_discount: float
    rounds: tuple[Totals, ...]  # what each round of sweeps starts from


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    salt = np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(key + salt) >> np.uint64(11)) * 2.0**-53


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables that the customers of each word take; ``weight`` is that of a new table."""
    result = (customers > 0).astype(np.float64)
    # The first customer takes a table; most words have no second one.
    more = np.flatnonzero(customers > 1)
    order = more[np.argsort(-customers[more], kind="stable")]
    c, a, k = customers[order], weight[order], key[order]
    tables = np.ones(len(order))
    done = 1
    while True:
        n = int(np.searchsorted(-c, -done, side="left"))  # words with more customers
        if not n:
            break
        p = a[:n] / (a[:n] + np.maximum(done - discount * tables[:n], 1e-12))
        draw = _uniform(k[:n], done)
        if done < ONE_BY_ONE:
            tables[:n] += draw < p
            done += 1
        else:
            group = np.minimum(done // 8, c[:n] - done)
            tables[:n] = np.minimum(tables[:n] + np.floor(group * p + draw), c[:n])
            done += done // 8
    result[order] = tables
    return result


class Range:
    """The keys (word, class) of one range of words, and the sampling of their tables.

    ``count`` is the customers of a key, ``total`` the training tokens of a word, ``opened``
    the tables of the restaurant whose context it is.
    """

    def __init__(self, data: bytes) -> None:
        self.key, self.count, self.asked, self.blocks, self.sizes, self.total, self.opened = unpack(
            data, np.uint64, np.int64, np.int32, np.int64, np.int64, np.int64, np.int64
        )
        new = np.ones(len(self.key), dtype=bool)
        new[1:] = (self.key[1:] & ~LOW) != (self.key[:-1] & ~LOW)
        self.word = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.context = (self.key & LOW).astype(np.int64)

    def parent(self, tables: np.ndarray) -> np.ndarray:
        return np.add.reduceat(tables, self.first)

    def sums(self, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        per_class = np.bincount(self.context, weights=tables, minlength=CLASSES)
        return np.concatenate([per_class, [self.parent(tables).sum(), root.sum()]])

    def sweeps(self, model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Round, tables of each pair and root tables of each word, after each sweep."""
        tables = (self.count > 0).astype(np.float64)
        root = (self.total > 0).astype(np.float64)
        words = self.key[self.first]
        for number, totals in enumerate(model.rounds):
            for turn in range(SWEEPS):
                step = (number * SWEEPS + turn + 1) << 24
                base = root_probability(self.parent(tables), root, model, totals)
                new = CONCENTRATION + model.discount * totals.tables
                weight = new[self.context] * base[self.word]
                tables = seat(self.count, weight, model.discount, mix(self.key + np.uint64(step)))
                fresh = (CONCENTRATION + model.root_discount * totals.root_tables) / (
                    model.n_words + 1
                )
                root = seat(
                    self.parent(tables),
                    np.full(len(words), fresh),
                    model.root_discount,
                    mix(words + np.uint64(step + 1)),
                )
                yield number, tables, root


def root_probability(
    customers: np.ndarray, tables: np.ndarray, model: Model, totals: Totals
) -> np.ndarray:
    d, n = model.root_discount, CONCENTRATION + totals.root_customers
    seated = np.maximum(customers - d * tables, 0) / n
    return seated + (CONCENTRATION + d * totals.root_tables) / n / (model.n_words + 1)


def probability(r: Range, tables: np.ndarray, root: np.ndarray, model: Model, totals: Totals):
    """Predictive probability of each pair's word in its context."""
    base = root_probability(r.parent(tables), root, model, totals)[r.word]
    d, n = model.discount, CONCENTRATION + totals.customers[r.context]
    seated = np.maximum(r.count - d * tables, 0) / n
    return seated + (CONCENTRATION + d * totals.tables[r.context]) / n * base


def _summed(ranges: DataFrame, of_range) -> np.ndarray:
    """Add up an array that each range gives; a few thousand numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                values = of_range(Range(cell.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values))), pa.array(values.astype(np.float64))],
                    names=["i", "v"],
                )

    rows = ranges.select("data").mapInArrow(run, "i long, v double")
    # Whole numbers below 2**53: the order of adding does not matter.
    collected = rows.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in collected])


def _first_sums(r: Range) -> np.ndarray:
    tables = (r.count > 0).astype(np.float64)
    root = (r.total > 0).astype(np.float64)
    customers = np.bincount(r.context, weights=r.count, minlength=CLASSES)
    parents = r.parent(tables)
    extra = [
        r.total.sum(),
        (r.count == 1).sum(),
        (r.count == 2).sum(),
        (parents == 1).sum(),
        (parents == 2).sum(),
    ]
    return np.concatenate([r.sums(tables, root), customers, extra])


def _totals(sums: np.ndarray, customers: np.ndarray) -> Totals:
    return Totals(customers, sums[:CLASSES], sums[CLASSES], sums[CLASSES + 1])


def _discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def train(ranges: DataFrame) -> tuple[Model, list[Totals]]:
    """The model and the totals of each averaged sweep."""
    sums = _summed(ranges, _first_sums)
    if not len(sums):
        sums = np.zeros(2 * CLASSES + 7)
    customers = sums[CLASSES + 2 : 2 * CLASSES + 2]
    n_tokens, one, two, root_one, root_two = sums[2 * CLASSES + 2 :]

    first = _totals(sums, customers)
    model = Model(
        int(first.root_tables), int(n_tokens), _discount(one, two), _discount(root_one, root_two), (first,)
    )

    def after(m: Model):
        def of_range(r: Range) -> np.ndarray:
            last = len(m.rounds) - 1
            return np.concatenate([r.sums(t, o) for n, t, o in r.sweeps(m) if n == last])

        sums = _summed(ranges, of_range)
        if not len(sums):
            sums = np.zeros(SWEEPS * (CLASSES + 2))
        return [_totals(s, customers) for s in sums.reshape(SWEEPS, -1)]

    model = Model(*list(vars(model).values())[:-1], (first, after(model)[-1]))
    return model, after(model)


def _answer(model: Model, samples: list[Totals], sweep: int):
    """Ranges: to each block the averaged probabilities of its keys, its words' totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cell in zip(batch.column(0), batch.column(1), strict=True):
                r = Range(cell.as_py())
                last, turn, mean = len(model.rounds) - 1, 0, np.zeros(len(r.key))
                for number, tables, root in r.sweeps(model):
                    if number == last:
                        mean += probability(r, tables, root, model, samples[turn]) / SWEEPS
                        turn += 1
                mean = mean.astype(np.float32)
                at = 0
                for block, size in zip(r.blocks.tolist(), r.sizes.tolist(), strict=True):
                    mine = r.asked[at : at + size]
                    at += size
                    word = np.unique(r.word[mine])
                    data = pack(*map(planes, (mean[mine], r.total[word], r.opened[word])))
                    yield from _messages([(block, part.as_py(), sweep, data)]).to_batches()

    return run


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def _score(model: Model, discount: float):
    denominator = model.n_tokens + 0.5 * (model.n_words + 1)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        row, messages = docs.to_pylist()[0], answers.to_pylist()
        b = Block(row)
        count, _ = _kept(messages)
        mean = np.zeros(len(count))
        for m in messages:
            if m["part"] == TABLES:
                tables = unplanes(*unpack(m["data"], np.uint8), np.int32)
                base, seen, opened = _from_parents(messages, m["sweep"])
                mean += pair_probability(
                    count, tables, seen[b.context], opened[b.context], base[b.parent], discount
                ) / PAIR_SWEEPS
        starts = np.cumsum(b.lengths) - b.lengths
        known = seen[b.token]
        ids = row["doc_ids"]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": pa.array(b.lengths),
                "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(ids), model.n_tokens)),
                "base_score": pa.array(
                    np.add.reduceat(np.log10((known + 0.5) / denominator), starts)
                ),
                "score": pa.array(np.add.reduceat(np.log10(mean)[b.place], starts)),
            }
        )

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    result = written(df, name)
    drop_shuffles(result.sparkSession)
    return result


def _to_blocks(blocks: DataFrame, messages: DataFrame, function, schema: str) -> DataFrame:
    """Bring each block together with what was sent to it."""
    return blocks.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(function, schema)


def _own_part(messages: DataFrame, part: int) -> DataFrame:
    """What blocks keep for themselves, in a table of its own, so that the rest can go."""
    return _stored(messages.where(F.col("part") == part), "lm-kept")


def _parents(shares: DataFrame, sweep: int) -> tuple[Model, DataFrame]:
    """Sample the parent restaurants given the tables of the blocks' pairs."""
    ranges = _stored(
        shares.groupBy("part").applyInArrow(_count, "part int, data binary"), "lm-ranges"
    )
    model, samples = train(ranges)
    answers = _stored(
        ranges.select("part", "data").mapInArrow(_answer(model, samples, sweep), MESSAGE), "lm-answers"
    )
    release(ranges)
    return model, answers


def scored(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    n_bytes = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = 1 << max(4, (n_bytes // BYTES_PER_RANGE).bit_length())
    bits = min(62, 20 + n_bytes.bit_length())
    blocks = _stored(narrow.mapInArrow(_split, BLOCKS), "lm-blocks")
    asked = blocks.mapInArrow(_ask(n_ranges, bits), MESSAGE)
    opened = _stored(
        _to_blocks(
            blocks,
            asked.groupBy("part").applyInArrow(_merge, MESSAGE),
            _open(n_ranges),
            f"{MESSAGE}, ones long, twos long",
        ),
        "lm-pairs",
    )
    once, twice = opened.where(F.col("part") == PAIRS).agg(F.sum("ones"), F.sum("twos")).first()
    discount = _discount(once or 0, twice or 0)
    model, answers = _parents(opened.where("part >= 0"), 0)
    kept = _own_part(opened.drop("ones", "twos"), PAIRS)
    release(opened)
    known = [kept]
    for sweep in range(1, PAIR_SWEEPS + 1):
        seated = _stored(
            _to_blocks(
                blocks, kept.unionAll(answers), _reseat(n_ranges, discount, sweep), MESSAGE
            ),
            "lm-tables",
        )
        if sweep == 1:
            release(answers)  # later ones are averaged
        model, answers = _parents(seated.where("part >= 0"), sweep)
        known += [_own_part(seated, TABLES), answers]
        release(seated)
    # Only a part of the blocks and of what was sent to them is in shuffle files at a time.
    part = F.pmod(F.xxhash64("block"), F.lit(PARTS))
    messages, score = reduce(DataFrame.unionAll, known), _score(model, discount)
    scores = [
        _stored(_to_blocks(blocks.where(part == i), messages.where(part == i), score, SCORED), "lm-scores")
        for i in range(PARTS)
    ]
    release(blocks, *known)
    return reduce(DataFrame.unionAll, scores)


def digest(docs: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"))
