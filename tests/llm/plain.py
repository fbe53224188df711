"""Brute-force versions of the operators, one row at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def crc(value):
    return zlib.crc32(str(value).encode())


def substrings(docs, window=20):
    """doc_id to (words, removed, digest); ``docs`` are (doc_id, text)."""
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (doc_id, k)), (doc_id, k))
    result = {}
    for doc_id, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (doc_id, k):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        result[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return result


def shingles(text, n=5):
    w = words(text)
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else []
    grams = grams or ([tuple(w)] if w else [])
    return Counter(grams)


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def classes(docs, threshold=0.8):
    """Smallest id of each document's class of near-duplicates."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            same = (docs[i][1] or "") == (docs[j][1] or "")
            near = bool(sets[i]) and bool(sets[j]) and similarity(sets[i], sets[j]) >= threshold
            if same or near:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return {doc_id: smallest[root(i)] for i, (doc_id, _) in enumerate(docs)}


def lower(text):
    return (text or "").translate({65 + k: 97 + k for k in range(26)})


def unigram(docs):
    """doc_id to (held out, tokens, known, base score), and the number of training tokens."""
    tokens = {i: [*words(lower(t)), None] for i, t in docs}
    counts = Counter(w for i, t in tokens.items() if crc(i) % 5 != 1 for w in t)
    total, kinds = sum(counts.values()), len(counts)
    result = {}
    for i, t in tokens.items():
        score = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        result[i] = (crc(i) % 5 == 1, len(t), sum(counts[w] > 0 for w in t), score)
    return result, total


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)


def secrets(text):
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text = text or ""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    found = [("email", *m.span()) for m in re.finditer(email, text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def water_filling(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    capped, goal = set(), [0.0] * len(sizes)
    while True:
        left = sum(sizes) - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        for i in range(len(sizes)):
            goal[i] = most * sizes[i] if i in capped else left * weights[i] / weight
        above = {i for i in range(len(sizes)) if goal[i] > most * sizes[i] + 1e-9}
        if not above:
            return goal
        capped |= above
