"""Substring deduplication with compressed FM-indexes, one per shard of the content.

A window of ``WINDOW`` words belongs to the shard of its anchor, the smallest hash among its
five-word grams, so equal windows meet in one shard wherever they stand.  Neighbouring windows
with the same anchor form a segment.  Anchors that occur only once cannot belong to a repeated
window; the others' segments go to their shard once per block of texts and distinct content.
A shard indexes its distinct segments (BWT, wavelet matrix), streams them through the index
backwards and gets, for each window, the interval of all its occurrences; the window is
repeated if the earliest of them stands before it.  The answers go back as bit masks, and each
block removes the words that repeated windows cover.

Everything between the steps is packed per block and shard, so a text or passage that a third
of all documents share costs one entry per block.  Words are compared by 64-bit hashes.

Null texts have no words.  Rows with the same doc_id and text stand at the same place, so
neither is earlier; a null doc_id comes before all others.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import whole_text, written
from ledgerloom.llm.fmindex import FMIndex, matching_statistics
from ledgerloom.llm.pitmanyor import pack, unpack
from ledgerloom.llm.vector import CHUNK, Words, mix

WINDOW = 20
GRAM = 5
BLOCK_BYTES = 8 << 20
BYTES_PER_SHARD = 4 << 20
# Windows in a segment; a longer run of one anchor is cut, any cut will do.
LONGEST = 64
NO_ID = -(2**63)

BLOCKS = "block long, doc_ids array<long>, lengths binary, texts binary"
ASKED = "block long, part int, kind int, data binary"


class Block:
    """The words of a block of texts, its anchors and its segments."""

    def __init__(self, ids: list, lengths: np.ndarray, raw: np.ndarray) -> None:
        self.ids = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        at, words = 0, 0
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        hashes, docs, starts, ends, first = [], [], [], [], [np.zeros(1, np.int64)]
        while at < len(lengths):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            mine = offsets[at : upto + 1]
            w = Words(raw[mine[0] : mine[-1]], mine - mine[0])
            hashes.append(w.hash)
            docs.append(w.doc + at)
            starts.append(w.starts + mine[0])
            ends.append(w.ends + mine[0])
            first.append(w.first[1:] + words)
            words += len(w)
            at = upto
        self.raw = raw
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.first = np.concatenate(first).astype(np.int64)
        self._anchors()

    def _anchors(self) -> None:
        n = len(self.hash)
        size = max(0, n - WINDOW + 1)
        if size:
            gram = np.zeros(n - GRAM + 1, dtype=np.uint64)
            for k in range(GRAM):
                gram = gram * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : k + len(gram)]
            gram = mix(gram)
            low, width = gram, 1
            grams = WINDOW - GRAM + 1
            while width < grams:
                step = min(width, grams - width)
                low = np.minimum(low[: len(low) - step], low[step:])
                width += step
            whole = self.doc[:size] == self.doc[n - size :]
            at = np.flatnonzero(whole)
            anchor = low[at]
        else:
            at, anchor = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            gram = anchor
        # A segment: windows side by side in one text with one anchor.
        new = np.ones(len(at), dtype=bool)
        new[1:] = (
            (anchor[1:] != anchor[:-1])
            | (at[1:] != at[:-1] + 1)
            | (self.doc[at[1:]] != self.doc[at[:-1]])
        )
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(at)))
        pieces = -(-many // LONGEST)
        which = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.seg_at = at[begin[which]] + nth * LONGEST if len(at) else at
        self.seg_windows = np.minimum(LONGEST, many[which] - nth * LONGEST)
        self.seg_anchor = anchor[begin[which]] if len(at) else anchor
        self.anchors, self.seg_number = np.unique(self.seg_anchor, return_inverse=True)
        # How often the anchor stands in the segment: one segment can repeat itself.
        found = np.zeros(len(self.seg_at), dtype=np.int64)
        for k in range(int(self.seg_windows.max(initial=0)) + WINDOW - GRAM):
            some = np.flatnonzero(self.seg_windows + WINDOW - GRAM > k)
            found[some] += gram[self.seg_at[some] + k] == self.seg_anchor[some]
        self.counts = np.bincount(self.seg_number, weights=found, minlength=len(self.anchors))

    def choose(self, repeated: np.ndarray) -> None:
        """Keep segments of repeated anchors; group equal ones, in order of anchor."""
        kept = np.flatnonzero(repeated[self.seg_number])
        at, windows = self.seg_at[kept], self.seg_windows[kept]
        anchor = self.seg_anchor[kept]
        content = windows.astype(np.uint64)
        for k in range(LONGEST + WINDOW - 1):
            longer = np.flatnonzero(windows + WINDOW - 1 > k)
            if not len(longer):
                break
            content[longer] = mix(
                content[longer] * np.uint64(0x9E3779B97F4A7C15) + self.hash[at[longer] + k]
            )
        doc = self.ids[self.doc[at]]
        place = at - self.first[self.doc[at]]
        order = np.lexsort((place, doc, content, anchor))
        self.at, self.windows = at[order], windows[order]
        self.where = doc[order], place[order]
        a, c = anchor[order], content[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.leader = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.lead_anchor, self.lead_content = a[self.leader], c[self.leader]

    def covered(self, masks: np.ndarray) -> np.ndarray:
        """Words in repeated windows; ``masks`` has the windows of each distinct segment."""
        lead = self.leader[self.group]
        doc, place = self.where
        same = (doc == doc[lead]) & (place == place[lead])
        every = np.uint64(2**64 - 1)
        mask = np.where(same, masks[self.group], every)
        edge = np.zeros(len(self.hash) + 1, dtype=np.int32)
        for j in range(LONGEST):
            hit = (j < self.windows) & ((mask >> np.uint64(j)) & np.uint64(1)).astype(bool)
            if not (j < self.windows).any():
                break
            at = self.at[hit] + j
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
        return np.cumsum(edge[:-1]) > 0

    def kept_texts(self, removed: np.ndarray) -> Iterator[bytes]:
        """The words of each text that stay, joined by a space."""
        kept = np.flatnonzero(~removed)
        bounds = np.searchsorted(kept, self.first)
        for d in range(len(self.ids)):
            mine = kept[bounds[d] : bounds[d + 1]]
            starts, sizes = self.starts[mine], self.ends[mine] - self.starts[mine] + 1
            if not len(mine):
                yield b""
                continue
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            inside = at < np.repeat(sizes - 1, sizes)
            source = np.minimum(np.repeat(starts, sizes) + at, len(self.raw) - 1)
            out = np.where(inside, self.raw[source], np.uint8(32))
            yield out[:-1].tobytes()


def _rows(schema: pa.Schema, row: tuple) -> pa.RecordBatch:
    columns = [pa.array([v], t) for v, t in zip(row, schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks, one row each, the texts compressed."""
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.binary()),
            ("texts", pa.binary()),
        ]
    )
    number = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield _rows(schema, _block_row(number, ids, texts))
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield _rows(schema, _block_row(number, ids, texts))


def _block_row(number: int, ids: list, texts: list[bytes]) -> tuple:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    return number, ids, pack(lengths), pack(np.frombuffer(b"".join(texts), np.uint8))


def _opened(ids, lengths: bytes, texts: bytes) -> Block:
    return Block(ids, unpack(lengths, np.int64)[0], unpack(texts, np.uint8)[0])


def _bits(n_shards: int) -> np.uint64:
    return np.uint64(64 - (n_shards.bit_length() - 1))


def _edges(anchors: np.ndarray, n_shards: int) -> np.ndarray:
    return np.searchsorted((anchors >> _bits(n_shards)).astype(np.int64), np.arange(n_shards + 1))


ASKED_SCHEMA = pa.schema(
    [("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]
)


def _ask_anchors(n_shards: int):
    """Blocks: the distinct anchors with their counts, packed per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, lengths, texts in zip(*batch.columns, strict=True):
                b = _opened(ids.as_py(), lengths.as_py(), texts.as_py())
                edges = _edges(b.anchors, n_shards)
                for p in np.flatnonzero(np.diff(edges)):
                    mine = slice(edges[p], edges[p + 1])
                    many = np.minimum(b.counts[mine], 2).astype(np.uint8)
                    data = pack(b.anchors[mine], many)
                    yield _rows(ASKED_SCHEMA, (number.as_py(), int(p), 0, data))

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """A shard: which anchors occur twice or more, a bit for each one asked."""
    anchors, counts = [], []
    for cell in table.column("data"):
        a, c = unpack(cell.as_py(), np.uint64, np.uint8)
        anchors.append(a)
        counts.append(c)
    _, inverse = np.unique(np.concatenate(anchors), return_inverse=True)
    twice = np.bincount(inverse, weights=np.concatenate(counts))[inverse] >= 2
    data, at = [], 0
    for a in anchors:
        data.append(pack(np.packbits(twice[at : at + len(a)])))
        at += len(a)
    return pa.table(
        {
            "block": table.column("block"),
            "part": table.column("part"),
            "kind": table.column("kind"),
            "data": pa.array(data, pa.binary()),
        }
    )


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {
        part: data
        for part, k, data in zip(
            table.column("part").to_pylist(),
            table.column("kind").to_pylist(),
            table.column("data").to_pylist(),
            strict=True,
        )
        if k == kind
    }


def _with_anchors(blocks: pa.Table, answers: dict[int, bytes], n_shards: int) -> Block:
    b = _opened(*(blocks.column(c)[0].as_py() for c in ("doc_ids", "lengths", "texts")))
    edges = _edges(b.anchors, n_shards)
    repeated = np.zeros(len(b.anchors), dtype=bool)
    for p, data in answers.items():
        mine = slice(edges[p], edges[p + 1])
        count = int(edges[p + 1] - edges[p])
        repeated[mine] = np.unpackbits(unpack(data, np.uint8)[0], count=count).astype(bool)
    b.choose(repeated)
    return b


def _ask_segments(n_shards: int):
    """Blocks: distinct segments of repeated anchors, packed per shard."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        number = blocks.column("block")[0].as_py()
        b = _with_anchors(blocks, _answers(answers, 0), n_shards)
        edges = _edges(b.lead_anchor, n_shards)
        rows = []
        for p in np.flatnonzero(np.diff(edges)):
            mine = np.arange(edges[p], edges[p + 1])
            lead = b.leader[mine]
            sizes = b.windows[lead] + WINDOW - 1
            at = np.repeat(b.at[lead], sizes) + np.arange(sizes.sum())
            at -= np.repeat(np.cumsum(sizes) - sizes, sizes)
            known, local = np.unique(b.hash[at], return_inverse=True)
            data = pack(
                b.lead_content[mine],
                b.windows[lead].astype(np.uint8),
                b.where[0][lead],
                b.where[1][lead].astype(np.int32),
                known,
                local.astype(np.int32),
            )
            rows.append((number, int(p), 1, data))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, ASKED_SCHEMA.types, strict=True)],
            schema=ASKED_SCHEMA,
        )

    return run


def _search(table: pa.Table) -> pa.Table:
    """A shard: index the distinct segments, search all their windows, answer with masks."""
    content, windows, docs, places, words, counts = [], [], [], [], [], []
    for cell in table.column("data"):
        c, w, d, p, known, local = unpack(
            cell.as_py(), np.uint64, np.uint8, np.int64, np.int32, np.uint64, np.int32
        )
        content.append(c)
        windows.append(w.astype(np.int64))
        docs.append(d)
        places.append(p.astype(np.int64))
        words.append(known[local])
        counts.append(len(c))
    content, windows = np.concatenate(content), np.concatenate(windows)
    docs, places = np.concatenate(docs), np.concatenate(places)
    sizes = windows + WINDOW - 1
    starts = np.cumsum(sizes) - sizes
    # One owner for equal segments: the earliest.
    order = np.lexsort((places, docs, content))
    new = np.ones(len(order), dtype=bool)
    new[1:] = content[order][1:] != content[order][:-1]
    owner = order[new]
    owned = np.empty(len(order), dtype=np.int64)
    owned[order] = np.cumsum(new) - 1

    symbols, values = np.unique(np.concatenate(words), return_inverse=True)
    length = sizes[owner]
    begin = np.cumsum(length + 1) - length - 1
    text = np.zeros(int((length + 1).sum()), dtype=np.int64)
    spread = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(begin, length) + spread] = values[np.repeat(starts[owner], length) + spread] + 1
    index = FMIndex(text, len(symbols) + 1, WINDOW)

    # The place of every symbol of the index in the order of documents.
    rank = np.unique(docs, return_inverse=True)[1]
    here = (rank << 32) + places
    place = np.full(len(text), np.iinfo(np.int64).max)
    place[np.repeat(begin, length) + spread] = np.repeat(here[owner], length) + spread
    earliest = np.minimum.reduceat(place[index.suffixes], index.group_start)

    _, group = matching_statistics(index, text, begin, length, WINDOW)
    out = np.cumsum(length) - length
    masks = np.zeros(len(content), dtype=np.uint64)
    for j in range(int(windows.max())):
        some = np.flatnonzero(windows > j)
        before = earliest[group[out[owned[some]] + j]] < here[some] + j
        masks[some] |= before.astype(np.uint64) << np.uint64(j)
    data, at = [], 0
    for n in counts:
        data.append(pack(masks[at : at + n]))
        at += n
    return pa.table(
        {
            "block": table.column("block"),
            "part": table.column("part"),
            "kind": table.column("kind"),
            "data": pa.array(data, pa.binary()),
        }
    )


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remove(n_shards: int, with_text: bool):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        b = _with_anchors(blocks, _answers(answers, 0), n_shards)
        edges = _edges(b.lead_anchor, n_shards)
        masks = np.zeros(len(b.leader), dtype=np.uint64)
        for p, data in _answers(answers, 1).items():
            masks[edges[p] : edges[p + 1]] = unpack(data, np.uint64)[0]
        removed = b.covered(masks)
        sums = np.concatenate([[0], np.cumsum(removed)])
        texts = list(b.kept_texts(removed))
        last = (
            [t.decode() for t in texts]
            if with_text
            else [hashlib.sha256(t).hexdigest() for t in texts]
        )
        return pa.table(
            {
                "doc_id": pa.array(blocks.column("doc_ids")[0].as_py(), pa.int64()),
                "n_words": pa.array(np.diff(b.first)),
                "n_removed": pa.array(sums[b.first[1:]] - sums[b.first[:-1]]),
                "text" if with_text else "kept_sha256": pa.array(last, pa.string()),
            }
        )

    return run


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (or its digest), one row per row."""
    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    n_bytes = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = 1 << max(4, (n_bytes // BYTES_PER_SHARD).bit_length())
    blocks = written(narrow.mapInArrow(_collect, BLOCKS), "text-blocks")
    anchors = blocks.mapInArrow(_ask_anchors(n_shards), ASKED)
    repeated = written(anchors.groupBy("part").applyInArrow(_repeated, ASKED), "anchors")
    by_block = blocks.groupBy("block")
    segments = by_block.cogroup(repeated.groupBy("block")).applyInArrow(
        _ask_segments(n_shards), ASKED
    )
    masks = segments.groupBy("part").applyInArrow(_search, ASKED)
    schema = RESULT.replace("kept_sha256", "text") if with_text else RESULT
    return by_block.cogroup(repeated.unionByName(masks).groupBy("block")).applyInArrow(
        _remove(n_shards, with_text), schema
    )


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text"), with_text=False)
