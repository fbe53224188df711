"""Words of many texts at once, as arrays of hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 1 << 21

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
# For comparing prose: ASCII punctuation separates words as well.
_PLAIN = _SEPARATOR.copy()
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base and of its inverse, kept from call to call.

    Functions travel with what they use; these 32 MB stay behind and are made anew.
    """

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full((2, max(n, CHUNK + 1)), _BASE, dtype=np.uint64)
            steps[1] = pow(_BASE, -1, 2**64)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Words:
    """The words of some texts: place in the bytes, text number and hash.

    ``raw`` holds the bytes of all texts, ``starts`` and ``ends`` the words in it, ``doc``
    the number of each word's text; ``first`` says where the words of each text begin.
    ``lower`` lowers A to Z; ``plain`` does too and takes punctuation out of the words;
    ``separators`` says for each byte whether it separates words, in place of white space.
    """

    def __init__(
        self,
        raw: np.ndarray,
        offsets: np.ndarray,
        plain: bool = False,
        lower: bool = False,
        separators: np.ndarray | None = None,
    ) -> None:
        if plain or lower:
            raw = _LOWER[raw]
        if separators is None:
            separators = _PLAIN if plain else _SEPARATOR
        self.raw, self.n_docs = raw, len(offsets) - 1
        inside = ~separators[raw]
        # A new text ends a word without a separator.
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(raw), dtype=bool)
        if len(raw):
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(raw), dtype=bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        up, down = _powers.first(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * up[:-1], dtype=np.uint64, out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def chunks(
    texts: pa.Array,
    plain: bool = False,
    lower: bool = False,
    separators: np.ndarray | None = None,
) -> Iterator[tuple[int, Words]]:
    """Cut a column of texts (null: empty) into chunks of words with their first row."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
        upto = min(max(upto, at + 1), at + 60_000, len(texts))
        mine = offsets[at : upto + 1]
        yield at, Words(raw[mine[0] : mine[-1]], mine - mine[0], plain, lower, separators)
        at = upto


def grams(words: Words, n: int) -> np.ndarray:
    """Hash of the n words from each place on; only places with n words in their text count."""
    size = max(0, len(words) - n + 1)
    result = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        result = result * np.uint64(0xD6E8FEB86659FD93) + words.hash[k : k + size]
    return mix(result)


def inside(words: Words, n: int) -> np.ndarray:
    """For each place of ``grams``: whether the window lies in one text."""
    size = max(0, len(words) - n + 1)
    return words.doc[:size] == words.doc[len(words) - size :]
