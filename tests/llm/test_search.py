"""Ranked search, URL rules and phrases against one-at-a-time versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, lexical, urlrules
from ledgerloom.llm.vector import Words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search ----------------------------------------------------------------------


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(items, docs, top=10):
    """(item, rank, doc_id, score); ``items`` and ``docs`` are (id, text)."""
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for item, text in items:
        wanted[item].update(terms(text))
    result = []
    for item, query in wanted.items():
        scores = []
        for doc_id, counts in held:
            m = 25 + (75 * sum(counts.values()) * big_n) // big_l
            score = sum(
                times
                * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m))
                for t, times in query.items()
                if t in counts
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores)[:top], 1):
            result.append((item, rank, doc_id, -score))
    return sorted(result, key=str)


def searched(items, docs, top=10):
    return sorted((tuple(r) for r in lexical.search(items, docs, top).collect()), key=str)


ITEM = "item_id long, text string"


def test_search_of_odd_rows(spark, odd, odd_rows):
    items = [(1, None), (2, ""), (3, "ALPHA beta beta w60, w7"), (None, "one \U0001f600 ünïcode"), (3, "the w1")]
    clash = odd.withColumns({c: F.lit("x") for c in ("block", "term", "item_id", "score", "rank")})
    got = searched(spark.createDataFrame(items, ITEM), clash)
    assert got == ranked(items, [(r[0], r[1]) for r in odd_rows])
    assert {r[0] for r in got} == {3, None}


def test_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "alpha")], ITEM)
    assert lexical.search(items, odd.limit(0)).collect() == []
    assert lexical.search(items.limit(0), odd).collect() == []


@pytest.mark.parametrize("top", [1, 10])
def test_search_in_many_blocks_and_bundles(spark, monkeypatch, top):
    """Rare and common terms, ties, and a third of all rows one text."""
    monkeypatch.setattr(lexical, "DOCS", 7)
    monkeypatch.setattr(lexical, "ITEMS", 4)
    rng = random.Random(5)
    vocabulary = [f"t{int(rng.paretovariate(0.5)) % 300}" for _ in range(500)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(200)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(15)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert searched(spark.createDataFrame(items, ITEM), frame, top) == ranked(items, docs, top)


# --- URL rules --------------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate(LOWER), path


def verdict(url, rules, default="allow"):
    host, path = parts(url)
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def judged(spark, pages, rules):
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted((tuple(r) for r in urlrules.judged(pages, rules).collect()), key=str)


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x", "http://a.example.org/en/12?q=/es/",
    "http://example.org", "http://example.org/", "http://notexample.org/es/", "x://org/es",
    "http://b.com/fr/#/de/", "http://com/de/1", "a://b://c/fr/", "http://é.com/fr/ü", "http://.com/fr/",
    "http://org./a", "http:///only/path", "http://x.com?/fr/", "http://a\nb.com/fr/\nz", "http://" + "a." * 300 + "org/",
]


def test_verdicts_of_odd_urls(spark):
    urls = list(enumerate(ODD_URLS)) + [(None, "http://x.org/"), (3, None), (3, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    pages = pages.withColumns({c: F.lit("x") for c in ("key", "p", "r", "range", "host", "n")})
    expected = sorted(((i, *verdict(u, urlrules.RULES)) for i, u in urls), key=str)
    assert judged(spark, pages, urlrules.RULES) == expected
    assert judged(spark, pages.limit(0), urlrules.RULES) == []


def test_pages_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = urlrules.judged(pages, rules, default="block").collect()
    assert [tuple(r) for r in got] == [(1, "a.org", "/x", None, "block")]


@pytest.mark.parametrize("seed", range(3))
def test_nested_rules(spark, seed):
    """Many nested hosts and paths; a third of the pages has one url, so ranges cut through it."""
    rng = random.Random(seed)
    labels = ["a", "b", "ab", "a-b", "c", ""]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))

    def path():
        return "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(5)))

    rules = sorted({(host(), path()[: rng.randrange(1, 6)]): rng.choice(["allow", "block"]) for _ in range(80)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [(i, f"http://{host()}{path()}") for i in range(400)] + [(1000 + i, "http://a.b.a/ab/") for i in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(4)
    assert judged(spark, pages, rules) == sorted(((i, *verdict(u, rules)) for i, u in urls), key=str)


# --- phrases ----------------------------------------------------------------------------


def phrases(docs, least, top):
    """Rows of the contract; ``docs`` are (lang, text)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    result = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least}
        covered = collections.Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if len(p) > 1 and covered[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


def mined(docs, least, top):
    return sorted(tuple(r) for r in collocations.collocations(docs, least, top).collect())


DOC = "lang string, text string"


@pytest.mark.parametrize("burst, full, tallied", [(1 << 14, 600_000, 1 << 21), (3, 40, 10)])
def test_phrases(spark, monkeypatch, burst, full, tallied):
    """Also with containers that burst at once and a trie that spills all the time."""
    monkeypatch.setattr(collocations, "BURST", burst)
    monkeypatch.setattr(collocations, "FULL", full)
    monkeypatch.setattr(collocations, "TALLIED", tallied)
    rng = random.Random(2)
    stock = ["New York City", "aa  aa\taa aa aa aa", "é ü é", "of the of the", "x.y,z", "in\r\nvein"]
    words = "of the in a é Ünd New york city w1 w2".split()
    docs = []
    for _ in range(300):
        bits = [rng.choice(stock) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(30))]
        docs.append((rng.choice(["en", "de", None, ""]), rng.choice([" ", "  ", " \t"]).join(bits)))
    frame = spark.createDataFrame(docs, DOC).repartition(3)
    for least, top in ((5, 2000), (20, 7)):
        assert mined(frame, least, top) == phrases(docs, least, top)


def test_phrases_of_odd_rows(spark, odd, odd_rows):
    clash = odd.withColumns({c: F.lit("x") for c in ("phrase", "n", "w", "a", "prefix", "k")})
    assert mined(clash, 3, 50) == phrases([(r[2], r[1]) for r in odd_rows], 3, 50)
    assert mined(odd.limit(0), 3, 50) == []


def test_phrases_are_handed_on_once_a_core(spark):
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(40 * cores).selectExpr("'en' AS lang", "'one two three' AS text")
    narrow = collocations._narrow(docs.repartition(10 * cores))
    runs = narrow.mapInArrow(collocations._runs([]), "lang string, phrase string, n long")
    rows = runs.where("phrase IS NOT NULL").groupBy("phrase").agg({"*": "count", "n": "sum"}).collect()
    assert len(rows) == 6
    assert all(r["sum(n)"] == 40 * cores and r["count(1)"] <= cores for r in rows)


def test_trie_counts_what_a_dictionary_counts(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 4)
    rng = random.Random(1)
    trie, expected = collocations.Trie(), collections.Counter()
    taken = collections.Counter()
    for _ in range(60):
        n = rng.randrange(1, 6)
        made = [b" ".join(rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(n)) for _ in range(rng.randrange(30))]
        ids = np.zeros((len(made), n), dtype=np.uint64)
        for row, phrase in enumerate(made):
            raw = np.frombuffer(phrase, dtype=np.uint8)
            ids[row] = Words(raw, np.array([0, len(raw)])).hash
        batch = np.empty(len(made), dtype=object)
        batch[:] = made
        trie.add(ids, batch, np.ones(len(made), dtype=np.int64))
        expected.update(made)
        if rng.random() < 0.1:
            rows = trie.cut(rng.randrange(len(trie.children)))
            assert rows == sorted(rows)
            taken.update(dict(rows))
    taken.update(dict(trie.rows()))
    assert taken == expected
    assert len(trie.children) > 1 and any(isinstance(c, collocations.Trie) for c in trie.children)


def test_scores_beyond_64_bits(spark):
    """1000 a n and l r pass 64 bits; the quotient is exact."""
    a, total, left, right = 9_000_000_000_000_001, 10**15 + 7, 9_100_000_000_000_003, 9_200_000_000_000_009
    row = spark.createDataFrame([(a, total, left, right)], "a long, total long, l long, r long")
    assert row.select(collocations.score().alias("s")).first()[0] == 1000 * a * total // (left * right)
