"""Secret scan: base patterns, and Shannon entropy of sliding windows per character class.

Candidate strings are long runs of key characters with digits and letters in them.  Inside a
candidate a window of fixed width slides over each run of a character class; its entropy
follows from counts that change by one character in and one out.  Windows above the class
threshold are joined to spans; windows that touch a base span or an allowed string are left
out, and the rest of the candidate is still searched.

A null text is empty: no spans.  Rows are scanned one by one, so repeated rows give repeated
results and extra columns do no harm.  The work is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharacterClass:
    name: str
    run: re.Pattern
    window: int
    bits: float


CLASSES = (
    CharacterClass("hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0),
    CharacterClass("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.9),
)
# Strings that look random and are public: examples, alphabets, digests of nothing.
NAMED = re.compile(r"example|sample|dummy|placeholder|test[_-]?key", re.IGNORECASE)
ALLOWED = (
    re.compile(r"0123456789|abcdefghij|qwertyuiop", re.IGNORECASE),
    re.compile(r"d41d8cd98f00b204e9800998ecf8427e|e3b0c44298fc1c149afbf4c8996fb924"),
    re.compile(r"wJalrXUtnFEMI/K7MDENG[/+]bPxRfiCYEXAMPLEKEY"),
)


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that do not overlap, left to right."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def entropy_runs(
    text: str, window: int, bits: float, closed: list[tuple[int, int]] | None = None
) -> list[tuple[int, int]]:
    """Joined stretches of windows whose entropy reaches ``bits``; counts are incremental.

    Windows that touch a place in ``closed``, which is ordered and disjoint, do not count.
    """
    closed = closed or []
    k, free = 0, 0
    if len(text) < window:
        return []
    # For a moment the window has one character more.
    log = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]
    counts: dict[str, int] = {}
    weighted, found = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        weighted += log[n + 1] - log[n]
        if i >= window:
            out = text[i - window]
            n = counts[out]
            counts[out] = n - 1
            weighted += log[n - 1] - log[n]
        while k < len(closed) and closed[k][0] <= i:
            free = closed[k][1]
            k += 1
        if i - window + 1 < free:
            continue
        if i >= window - 1 and math.log2(window) - weighted / window >= bits - 1e-9:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _mixed(candidate: str) -> bool:
    return any(c.isdigit() for c in candidate) and any(c.isalpha() for c in candidate)


def allowed_spans(candidate: str) -> list[tuple[int, int]]:
    """Public strings; a name such as ``example`` covers what / and = do not part from it."""
    spans = [a.span() for allowed in ALLOWED for a in allowed.finditer(candidate)]
    upto = 0
    for m in NAMED.finditer(candidate):
        if m.start() < upto:
            continue
        start = max(candidate.rfind("/", 0, m.start()), candidate.rfind("=", 0, m.start())) + 1
        ends = [e for e in (candidate.find("/", m.end()), candidate.find("=", m.end())) if e >= 0]
        upto = min(ends, default=len(candidate))
        spans.append((start, upto))
    return spans


def entropy_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    spans: list[tuple[str, int, int]] = []
    # Both the base spans and the candidates run left to right.
    blocked, k = disjoint([(s, e) for _, s, e in taken]), 0
    for m in CANDIDATE.finditer(text):
        while k < len(blocked) and blocked[k][1] <= m.start():
            k += 1
        if not _mixed(m[0]):
            continue
        closed = allowed_spans(m[0])
        j = k
        while j < len(blocked) and blocked[j][0] < m.end():
            closed.append((blocked[j][0] - m.start(), blocked[j][1] - m.start()))
            j += 1
        closed = disjoint(closed)
        for kind in CLASSES:
            first = 0
            for run in kind.run.finditer(m[0]):
                while first < len(closed) and closed[first][1] <= run.start():
                    first += 1
                inside, j = [], first
                while j < len(closed) and closed[j][0] < run.end():
                    inside.append((closed[j][0] - run.start(), closed[j][1] - run.start()))
                    j += 1
                for start, end in entropy_runs(run[0], kind.window, kind.bits, inside):
                    spans.append(
                        ("entropy", m.start() + run.start() + start, m.start() + run.start() + end)
                    )
    found: list[tuple[str, int, int]] = []
    for span in sorted(set(spans), key=lambda s: (s[1], s[2])):
        if found and span[1] < found[-1][2]:
            found[-1] = ("entropy", found[-1][1], max(found[-1][2], span[2]))
        else:
            found.append(span)
    return found


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans of one text."""
    text = text or ""
    base = base_spans(text)
    return base, entropy_spans(text, base)


def joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind."""
    if text is None:
        return None
    base, added = scan(text)
    out, at = [], 0
    for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        out += [text[at : max(at, start)], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


DIGEST = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "spans string, n_entropy long, redacted_sha256 string"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for text in batch.column(1):
            text = text.as_py()
            base, added = scan(text)
            clean = redacted(text) if base or added else text
            kinds = [s[0] for s in base]
            rows.append(
                (
                    kinds.count("assign"),
                    kinds.count("access"),
                    kinds.count("hex"),
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined(base + added),
                    len(added),
                    hashlib.sha256((clean or "").encode("utf-8", "replace")).hexdigest(),
                )
            )
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=[f.split(" ")[0] for f in DIGEST.split(", ")],
        )


def digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_digests, DIGEST)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; all columns stay."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(t.as_py()) for t in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [texts if i == place else batch.column(i) for i in range(batch.num_columns)],
                names=batch.schema.names,
            )

    return docs.mapInArrow(run, docs.schema)
