"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

The input of a word has a word part and a character part: how much more often the word, and
its byte n-grams, occur in toxic than in clean texts of the training sample (logarithms of
smoothed ratios; largest, smallest and mean over the n-grams), and its length.  Two gated
recurrent layers read a window of words from either side, attention pools their states, and
a logistic unit scores the window.  All overlapping windows of a text are scored; the text
has the score of its highest window.  Network and tables are trained in numpy.

Training takes at most ``PER_CLASS`` labelled texts of each class, those with the smallest
hash of doc_id, copies once, never from the held-out part.  A toxic text teaches by its
highest window so far, a clean one by random windows and by its highest.  Only doc_id joins
labels to texts; neither it nor lang, source or label is an input.

Null or empty texts, and texts without words, score 0.01.  Without labels of both classes all
scores are that.  Repeated rows are scored each; a null doc_id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import whole_text
from ledgerloom.llm.vector import Words, chunks, mix

PER_CLASS = 1000
WINDOW, STRIDE = 64, 48
GRAMS = (4, 5)
HIDDEN, ATTENTION, INPUTS = 8, 8, 6
SLOTS = 1 << 20
SHRINK = 10.0
NO_WORDS = 0.01
THRESHOLD = 0.7
EPOCHS, BATCH, RATE = 8, 128, 0.01
# A small sample is gone through more often, so that the network is moved this many times.
LEAST_STEPS = 250


class Ratios:
    """Logarithms of smoothed ratios, by 64-bit hash, in a table of fixed size.

    A slot keeps half of the hash, so that others find nothing there; of two in one slot the
    one that tells more stays.
    """

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        self.check = np.zeros(SLOTS, dtype=np.uint32)
        self.value = np.zeros(SLOTS, dtype=np.float32)
        order = np.argsort(np.abs(value), kind="stable")
        slot = self.slot(key[order])
        self.check[slot] = key[order].astype(np.uint32)
        self.value[slot] = value[order]

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(44)).astype(np.int64)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        slot = self.slot(key)
        return np.where(self.check[slot] == key.astype(np.uint32), self.value[slot], np.float32(0))


def byte_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n bytes inside a word, and the number of the word."""
    sizes = np.maximum(words.ends - words.starts - n + 1, 0)
    word = np.repeat(np.arange(len(words)), sizes)
    at = words.starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        value = (value << np.uint64(8)) | words.raw[at + k].astype(np.uint64)
    return mix(value * np.uint64(0x9E3779B97F4A7C15)), word


@dataclass
class Model:
    words: Ratios
    grams: Ratios
    net: dict[str, np.ndarray]


def features(words: Words, of_words: Ratios, of_grams: Ratios) -> np.ndarray:
    """The inputs of every word; equal words are worked out once."""
    unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    some = Words.__new__(Words)
    some.raw, some.starts, some.ends = words.raw, words.starts[first], words.ends[first]
    low, high, mean = (np.zeros(len(unique), dtype=np.float32) for _ in range(3))
    count = np.zeros(len(unique), dtype=np.float32)
    for n in GRAMS:
        key, word = byte_grams(some, n)
        value = of_grams[key]
        new = np.flatnonzero(np.diff(word, prepend=-1))
        if len(new):
            at = word[new]
            high[at] = np.maximum(high[at], np.maximum.reduceat(value, new))
            low[at] = np.minimum(low[at], np.minimum.reduceat(value, new))
            mean[at] += np.add.reduceat(value, new)
        count += np.bincount(word, minlength=len(unique)).astype(np.float32)
    length = np.log1p((some.ends - some.starts).astype(np.float32))
    own = of_words[unique]
    table = np.stack(
        [own, high, low, mean / np.maximum(count, 1), length - 1.6, np.maximum(own, high) - 3],
        axis=1,
    )
    return (table.astype(np.float32) * np.float32(0.5))[inverse]


def windows(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and first word of all windows; the last ones reach each text's end."""
    many = np.where(
        counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0
    ).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return doc, first[doc] + nth * STRIDE


def gather(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (window, step, input) and which steps hold a word."""
    at = start[:, None] + np.arange(WINDOW)
    mask = at < end[:, None]
    return x[np.minimum(at, len(x) - 1)] * mask[:, :, None], mask.astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_net(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    net: dict[str, np.ndarray] = {}
    for side in "fb":
        net[f"{side}w"] = normal(INPUTS, 3 * HIDDEN)
        net[f"{side}u"] = normal(HIDDEN, 2 * HIDDEN)
        net[f"{side}n"] = normal(HIDDEN, HIDDEN)
        net[f"{side}b"] = np.zeros(3 * HIDDEN, dtype=np.float32)
    net["a"] = normal(2 * HIDDEN, ATTENTION)
    net["ab"] = np.zeros(ATTENTION, dtype=np.float32)
    net["v"] = normal(ATTENTION)
    net["o"] = normal(2 * HIDDEN)
    net["ob"] = np.zeros(1, dtype=np.float32)
    return net


def _gru(net: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """States after every step, from left (f) or right (b); padding leaves them as they are."""
    steps = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
    given = x @ net[f"{side}w"] + net[f"{side}b"]
    h = np.zeros((len(x), HIDDEN), dtype=x.dtype)
    states = np.zeros((len(x), x.shape[1], HIDDEN), dtype=x.dtype)
    saved = []
    for t in steps:
        gates = sigmoid(given[:, t, : 2 * HIDDEN] + h @ net[f"{side}u"])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        rh = r * h
        n = np.tanh(given[:, t, 2 * HIDDEN :] + rh @ net[f"{side}n"])
        m = mask[:, t, None]
        if keep:
            saved.append((t, h, z, r, n, rh))
        h = h + m * (1 - z) * (n - h)
        states[:, t] = h
    return states, saved


def forward(net: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows, and what the backward pass needs."""
    left, saved_l = _gru(net, "f", x, mask, keep)
    right, saved_r = _gru(net, "b", x, mask, keep)
    states = np.concatenate([left, right], axis=2)
    u = np.tanh(states @ net["a"] + net["ab"])
    e = u @ net["v"] + (mask - 1) * 1e4
    weight = np.exp(e - e.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", weight, states)
    logit = pooled @ net["o"] + net["ob"][0]
    return logit, (x, mask, saved_l, saved_r, states, u, weight, pooled)


def backward(net: dict, kept: tuple, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    x, mask, saved_l, saved_r, states, u, weight, pooled = kept
    grad = {"ob": np.array([d_logit.sum()]), "o": pooled.T @ d_logit}
    d_pooled = d_logit[:, None] * net["o"]
    d_states = weight[:, :, None] * d_pooled[:, None, :]
    d_weight = np.einsum("bth,bh->bt", states, d_pooled)
    d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    grad["v"] = np.einsum("bt,bta->a", d_e, u)
    d_u = d_e[:, :, None] * net["v"] * (1 - u * u)
    grad["ab"] = d_u.sum(axis=(0, 1))
    grad["a"] = np.einsum("bth,bta->ha", states, d_u)
    d_states = d_states + d_u @ net["a"].T
    for side, saved, part in (
        ("f", saved_l, d_states[:, :, :HIDDEN]),
        ("b", saved_r, d_states[:, :, HIDDEN:]),
    ):
        w, un, nn = net[f"{side}w"], net[f"{side}u"], net[f"{side}n"]
        d_given = np.zeros((*x.shape[:2], 3 * HIDDEN), dtype=x.dtype)
        g_u, g_n = np.zeros_like(un), np.zeros_like(nn)
        d_h = np.zeros((len(x), HIDDEN), dtype=x.dtype)
        for t, h, z, r, n, rh in reversed(saved):
            d_h = d_h + part[:, t]
            m = mask[:, t, None]
            d_n = d_h * m * (1 - z) * (1 - n * n)
            d_z = d_h * m * (h - n) * z * (1 - z)
            d_rh = d_n @ nn.T
            d_r = d_rh * h * r * (1 - r)
            g_n += rh.T @ d_n
            d_gates = np.concatenate([d_z, d_r], axis=1)
            g_u += h.T @ d_gates
            d_given[:, t] = np.concatenate([d_gates, d_n], axis=1)
            d_h = d_h * (1 - m * (1 - z)) + d_rh * r + d_gates @ un.T
        grad[f"{side}u"], grad[f"{side}n"] = g_u, g_n
        grad[f"{side}b"] = d_given.sum(axis=(0, 1))
        grad[f"{side}w"] = np.einsum("bti,btg->ig", x, d_given)
    return grad


def _scores(net: dict, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    result = np.zeros(len(start), dtype=np.float32)
    for at in range(0, len(start), 2048):
        part = slice(at, at + 2048)
        inputs, mask = gather(x, start[part], end[part])
        result[part] = forward(net, inputs, mask)[0]
    return result


def highest(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Place of the highest value of each text, in order of texts."""
    order = np.lexsort((-value, doc))
    return order[np.flatnonzero(np.diff(doc[order], prepend=-1))]


class Tally:
    """How many texts of a group hold each key; texts are added a chunk at a time."""

    def __init__(self) -> None:
        self.key, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, keys: list[np.ndarray]) -> None:
        if not keys:
            return
        fresh, n = np.unique(np.concatenate(keys), return_counts=True)
        both = np.concatenate([self.key, fresh])
        counts = np.concatenate([self.count, n])
        self.key, place = np.unique(both, return_inverse=True)
        self.count = np.bincount(place, weights=counts).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.count[at], 0)


def _ratios(tallies: dict[tuple[int, int], Tally], halves: tuple[int, ...], share: float) -> Ratios:
    """From the keys that two texts or more of these halves hold; ``share`` are toxic."""
    keys = np.unique(np.concatenate([tallies[y, h].key for y in (0, 1) for h in halves]))
    toxic = sum(tallies[1, h].of(keys) for h in halves)
    clean = sum(tallies[0, h].of(keys) for h in halves)
    # Shrunk towards the share of toxic texts: few occurrences tell little.
    value = np.log((toxic + SHRINK * share) / (clean + SHRINK * (1 - share)))
    value -= np.log(share / (1 - share))
    kept = toxic + clean >= 2
    return Ratios(keys[kept], value[kept].astype(np.float32))


def _parts(texts) -> Iterator[tuple[int, Words]]:
    """The words of a hundred texts or fewer at a time, which bounds the arrays of n-grams."""
    for low in range(0, len(texts), 100):
        for at, w in chunks(pa.array(texts[low : low + 100], pa.string()), lower=True):
            yield low + at, w


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model | None:
    """A model from labelled texts; nothing if a class is missing."""
    texts, labels = zip(*sorted(set(zip(texts, labels, strict=True))), strict=True) if texts else ((), ())
    label = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    half = rng.permutation(len(label)) % 2
    groups = [(y, h) for y in (0, 1) for h in (0, 1)]
    of_word = {g: Tally() for g in groups}
    of_gram = {g: Tally() for g in groups}
    parts = []
    for at, w in _parts(texts):
        parts.append(w)
        found = [byte_grams(w, n) for n in GRAMS]
        for y, h in groups:
            words_, grams_ = [], []
            for d in range(w.n_docs):
                if (label[at + d], half[at + d]) != (y, h):
                    continue
                a, b = w.first[d], w.first[d + 1]
                words_.append(np.unique(w.hash[a:b]))
                mine = [k[slice(*np.searchsorted(i, [a, b]))] for k, i in found]
                grams_.append(np.unique(np.concatenate(mine)))
            of_word[y, h].add(words_)
            of_gram[y, h].add(grams_)
    counts = np.concatenate([w.counts for w in parts])
    first = np.cumsum(counts) - counts
    # The network learns from inputs that a text had no part in: those of the other half.
    x = np.zeros((int(counts.sum()), INPUTS), dtype=np.float32)
    in_half = np.repeat(half, counts)
    share = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
    for h in (0, 1):
        ratios = [_ratios(t, (1 - h,), share) for t in (of_word, of_gram)]
        at = 0
        for w in parts:
            mine = in_half[at : at + len(w)] == h
            x[at : at + len(w)][mine] = features(w, *ratios)[mine]
            at += len(w)
    of_words, of_grams = (_ratios(t, (0, 1), share) for t in (of_word, of_gram))
    del parts, of_word, of_gram
    doc, start = windows(counts, first)
    end = (first + counts)[doc]
    net = new_net(rng)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    # Before there is a network, the largest ratio in a window tells how toxic it may be.
    strongest = np.maximum(x[:, 0], x[:, 1])
    value = np.array([strongest[s : min(s + WINDOW, e)].max() for s, e in zip(start, end, strict=True)])
    turn, epoch = 0, 0
    while epoch < EPOCHS or turn < LEAST_STEPS:
        epoch += 1
        top = highest(value, doc)
        clean = np.flatnonzero(label[doc] == 0)
        more = rng.choice(clean, size=min(len(clean), 2 * len(top)), replace=False)
        chosen = np.concatenate([top, more])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            mine = chosen[at : at + BATCH]
            inputs, mask = gather(x, start[mine], end[mine])
            logit, kept = forward(net, inputs, mask, keep=True)
            error = (sigmoid(logit) - label[doc[mine]]).astype(np.float32) / len(mine)
            turn += 1
            for k, g in backward(net, kept, error).items():
                g = np.clip(g, -1, 1)
                a, b = state[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                step = (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)
                net[k] -= (RATE * step).astype(np.float32)
        value = _scores(net, x, start, end)
    return Model(of_words, of_grams, net)


def _score(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w in chunks(batch.column(1), lower=True):
                result = np.full(w.n_docs, NO_WORDS)
                if len(w) and model.value is not None:
                    m = model.value
                    x = features(w, m.words, m.grams)
                    doc, start = windows(w.counts, w.first[:-1])
                    logit = _scores(m.net, x, start, w.first[1:][doc])
                    best = highest(logit, doc)
                    result[doc[best]] = sigmoid(logit[best].astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, w.n_docs),
                        pa.array(result),
                        pa.array((result >= THRESHOLD).astype(np.int32)),
                    ],
                    names=["doc_id", "score", "predicted"],
                )

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most ``PER_CLASS`` texts with their label of each class, training part only."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = []
    for label in (0, 1):
        rows = usable.where(F.col("toxic") == label).select("doc_id").distinct()
        picked += [
            (r["doc_id"], label)
            for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS).collect()
        ]
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    # At most two times PER_CLASS short rows.
    rows = docs.select("doc_id", whole_text().alias("t")).join(F.broadcast(chosen), "doc_id")
    return [(r["t"], r["toxic"]) for r in rows.select("t", "toxic").collect()]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    pairs = sample(docs, labels)
    model = train([t for t, _ in pairs], [y for _, y in pairs])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(
        _score(shared), "doc_id long, score double, predicted int"
    )
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
