"""Substrings, near-duplicates and decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
from plain import classes as plain_classes
from plain import shingles, similarity, substrings, words

from ledgerloom.llm import decontam, fmindex, neardup, substring, vector


def test_words_are_those_of_the_pattern(pairs, odd_rows):
    texts = [t for _, t in pairs] + [r[1] for r in odd_rows]
    seen = {}
    for at, w in vector.chunks(pa.array(texts, pa.string())):
        for d in range(w.n_docs):
            mine = [w.word(i).decode() for i in range(w.first[d], w.first[d + 1])]
            assert mine == words(texts[at + d])
        for i in range(len(w)):
            assert seen.setdefault(w.word(i), w.hash[i]) == w.hash[i]
    assert len(set(seen.values())) == len(seen)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(1, 5, 300), [0], rng.integers(1, 5, 200), [0]])
    window = 6
    index = fmindex.FMIndex(text, 5, window)
    for _ in range(200):
        size = int(rng.integers(1, 12))
        pattern = rng.integers(1, 5, size)
        low, high = np.array([0]), np.array([len(text)])
        for symbol in pattern[::-1]:
            low, high = index.extend(low, high, np.array([symbol]))
            if high[0] <= low[0]:
                break
        wanted = {i for i in range(len(text) - size + 1) if (text[i : i + size] == pattern).all()}
        found = set(index.suffixes[low[0] : high[0]].tolist()) if high[0] > low[0] else set()
        assert found == wanted


def test_matching_statistics():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(1, 4, 150), [0]])
    window = 5
    index = fmindex.FMIndex(text, 4, window)
    query = rng.integers(1, 4, 80)
    length, _ = fmindex.matching_statistics(index, query, np.array([0]), np.array([80]), window)
    text_string = "".join(map(str, text))
    for i in range(80):
        best = max(
            k for k in range(window + 1) if i + k <= 80 and "".join(map(str, query[i : i + k])) in text_string
        )
        assert length[i] == best


def check_substrings(docs, rows):
    expected = substrings(rows)
    for r in substring.digest(docs).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[r["doc_id"]], r["doc_id"]


def test_substrings(documents, pairs):
    check_substrings(documents, pairs)


def test_substrings_over_blocks(spark, monkeypatch):
    """Small blocks: passages meet across blocks, overlap, and repeat inside a document."""
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for i in range(80):
        w = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            cut = rng.randrange(25)
            w[len(w) // 2 : len(w) // 2] = passage[cut:]
        if i % 7 == 0:
            w += ["la"] * rng.randrange(60)
        if i % 11 == 0:
            w += w
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_equal_rows_are_not_earlier(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_removed"]) for r in substring.digest(docs).collect())
    assert found == [(1, 0), (1, 0), (2, 30)]


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    errors = []
    for _ in range(30):
        a = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 800))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 4)):
            b[rng.randrange(len(b))] = "new"
        exact = similarity(shingles(" ".join(a)), shingles(" ".join(b)))
        left, right = pa.array([" ".join(a)]), pa.array([" ".join(b)])
        assert abs(neardup.similarities(left, right)[0] - exact) < 1e-9
        both = []
        for column in (left, right):
            for _, w in vector.chunks(column):
                both.append(neardup.signatures(*neardup.elements(w), 1)[0])
        errors.append((both[0] == both[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_classes(documents, pairs):
    expected = plain_classes(pairs)
    got = {r["doc_id"]: r["class_id"] for r in neardup.digest(documents).collect()}
    assert got == expected


def test_classes_of_chains_and_groups(spark):
    """A big group of near copies, chains whose ends are unlike, and single texts."""
    rng = random.Random(9)
    rows = []
    base = [f"b{i}" for i in range(200)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    chain = [f"c{i}" for i in range(150)]
    for step in range(8):
        rows.append(" ".join(chain))
        for k in range(2):
            chain[step * 17 + k] = f"y{step}{k}"
    rows += [" ".join(f"s{i}_{k}" for k in range(60)) for i in range(20)]
    rows += ["a b", "a b", "a c", "", None]
    rng.shuffle(rows)
    pairs = list(enumerate(rows))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    expected = plain_classes(pairs)
    got = {r["doc_id"]: r["class_id"] for r in neardup.digest(docs).collect()}
    assert got == expected
    kept = sorted(r["doc_id"] for r in neardup.keep_one(docs).collect())
    assert kept == sorted(set(expected.values()))


def test_pairs_within_boilerplate(spark):
    """Texts alike by 0.77 through boilerplate, each with one partner at 0.82."""
    boilerplate = [f"b{i}" for i in range(178)]
    rows = []
    for pair in range(250):
        common = [f"p{pair}_{k}" for k in range(6)]
        for one in range(2):
            own = [f"o{pair}_{one}_{k}" for k in range(20)]
            rows.append((2 * pair + one, " ".join(boilerplate + common + own)))
    first = pa.array([rows[0][1], rows[0][1]])
    alike, unlike = neardup.similarities(first, pa.array([rows[1][1], rows[2][1]]))
    assert unlike < 0.78 < neardup.THRESHOLD < alike
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.digest(docs).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    labels = {r["node"]: r["label"] for r in neardup.components(df).collect()}
    assert {labels[i] for i in range(41)} == {labels[0]}
    assert labels[100] == labels[90] == labels[95] != labels[0]


def plain_alignment(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH
            table[i][j] = max(
                0,
                table[i - 1][j - 1] + step,
                table[i - 1][j] + decontam.GAP,
                table[i][j - 1] + decontam.GAP,
            )
            best = max(best, table[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a = rng.integers(1, 5, (1, int(rng.integers(1, 14)))).astype(np.uint64)
        b = rng.integers(1, 5, (1, int(rng.integers(1, 30)))).astype(np.uint64)
        assert decontam.align(a, b)[0][0] == plain_alignment(a[0], b[0])


def test_leaks(spark, documents, pairs):
    """Whole, edited and partial copies of items; clean documents are left alone."""
    rng = random.Random(2)
    items = [(i, " ".join(f"i{i}w{rng.randrange(400)}" for _ in range(40))) for i in range(6)]
    rows, wanted = list(pairs), set()
    for i, text in items:
        w = text.split()
        edited = [x if k % 6 else "edit" for k, x in enumerate(w)]
        shorter = [x for k, x in enumerate(w) if k % 8]
        filler = ["some", "thing"] * 30
        for k, passage in enumerate(([x.upper() + "," for x in w], edited, shorter)):
            rows.append((10_000 + 10 * i + k, " ".join(filler + passage + filler)))
            wanted.add((10_000 + 10 * i + k, i))
        rows.append((10_000 + 10 * i + 5, " ".join(filler + w[:8] + filler)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.digest(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted
    for r in found:
        if r["similarity"] == 1.0:
            assert (r["first_word"], r["end_word"]) == (60, 100)


def test_passages_of_long_items(spark):
    """A verbatim passage counts however long its item is; a few words of a short item do not."""
    long = [f"q{k}" for k in range(500)]
    middle = [f"m{k}" for k in range(59)]
    short = [f"s{k}" for k in range(6)]
    benchmark = spark.createDataFrame(
        [(1, " ".join(long)), (2, " ".join(middle)), (3, " ".join(short))],
        "item_id long, text string",
    )
    filler = ["some", "thing"] * 30
    passages = [
        long[200:400], long[487:], middle[10:39], middle[:13], short, short[:5],
        long[300:312], middle[:9], short[:3],
    ]
    rows = [(i, " ".join(filler + p + filler)) for i, p in enumerate(passages)]
    rows.append((9, " ".join(long[250:263] + filler)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.digest(docs, benchmark).collect()}
    assert found == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (9, 1)}


def test_benchmark_in_slices(spark, documents, monkeypatch):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.digest(documents, benchmark).collect()}
    monkeypatch.setattr(decontam, "SLICE_WORDS", 200)
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.digest(documents, benchmark).collect()}
    assert parts == whole and whole


def test_items_of_a_few_words(spark):
    """One to four words leak only as a whole text; a common word is no leak."""
    docs = spark.createDataFrame(
        [(1, "well yes of course we do"), (2, "Yes!"), (3, "a b c d"), (4, "x a b c d y z w v u t"), (5, "yes no")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, "yes"), (2, "a b c d")], "item_id long, text string")
    clean = {r["doc_id"] for r in decontam.keep_clean(docs, items).collect()}
    assert clean == {1, 4}


def test_functions_travel_without_the_powers():
    """The driver hashes words too; what it keeps for that is not sent to the executors."""
    from pyspark import cloudpickle

    list(vector.chunks(pa.array(["some words"])))
    assert len(cloudpickle.dumps(vector.chunks)) < 100_000
