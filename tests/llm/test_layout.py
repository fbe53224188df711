"""Sharding, mixing and the pipeline."""

import collections
import sys

import numpy as np
import pytest
from plain import crc, water_filling, words

import corpus_pipeline
from ledgerloom.llm import mixing, quality, sharding

SF = "/root/testdata/sf0.001"


def check_shards(rows, n_shards=16):
    for r in rows:
        assert 0 <= r["shard"] < n_shards
    slots = collections.defaultdict(list)
    sizes = collections.Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return sizes


def test_shards(documents, pairs):
    rows = sharding.digest(documents).collect()
    sizes = check_shards(rows)
    texts = dict(pairs)
    largest = max(r["size"] for r in rows)
    mean = sum(sizes.values()) / 16
    assert all(abs(sizes[s] - mean) <= largest + 0.06 * mean for s in range(16))
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == crc(texts[r["doc_id"]])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    again = sharding.digest(documents.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_shards_with_a_hot_text(spark, monkeypatch):
    """A third of the rows are one text: it is split, everything else stays whole."""
    monkeypatch.setattr(sharding, "ROWS_PER_BIN", 100)
    monkeypatch.setattr(sharding, "BINS", 16)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 6 % 2000} {i % 3}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sharding.digest(docs).collect()
    sizes = check_shards(found)
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean
    texts = dict(rows)
    places = collections.defaultdict(set)
    for r in found:
        places[texts[r["doc_id"]]].add(r["shard"])
    split = [t for t, s in places.items() if len(s) > 1]
    assert "hot text" in split and len(split) == 1


def test_shards_with_hundreds_of_hot_texts(spark, monkeypatch):
    """Also a hot text with a null doc_id and with one far from the others."""
    monkeypatch.setattr(sharding, "ROWS_PER_BIN", 4)
    monkeypatch.setattr(sharding, "BINS", 100_000)
    rows = [(i, f"text {i % 700}") for i in range(7000)]
    rows += [(i, "hot") for i in range(8000, 11000)] + [(None, "hot"), (2**62, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sharding.digest(docs).collect()
    check_shards(found)
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1], [0, 5, 50], [7], [1, 1, 1, 1000]])
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert np.allclose([float(g) for g in got], water_filling(sizes, weights))


def test_splitting_tree():
    quotas = np.array([100, 7, 0, 31])
    leaves = mixing.splitting_tree(quotas, 5, np.random.default_rng(1))
    assert leaves.shape == (5, 4) and (leaves.sum(axis=0) == quotas).all() and (leaves >= 0).all()
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 3


def test_subset_sums():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 60, 12).tolist()
        wanted = int(rng.integers(0, sum(sizes)))
        chosen = mixing.nearest_subset(sizes, wanted)
        best = max(
            s
            for s in (
                sum(v for i, v in enumerate(sizes) if m >> i & 1) for m in range(1 << len(sizes))
            )
            if s <= wanted
        )
        assert len(set(chosen)) == len(chosen) and sum(sizes[i] for i in chosen) == best


def test_mix(documents, pairs):
    rows = mixing.digest(documents).collect()
    source = {r["doc_id"]: r["source"] for r in documents.select("doc_id", "source").collect()}
    texts = dict(pairs)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    each = collections.defaultdict(list)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == len(words(texts[r["doc_id"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["shards"]) == len(r["places"]) == r["copies"]
        sizes[s] += r["size"]
        each[s].append(r["size"])
        taken[s] += r["taken"]
        target[s] = r["target"]
    order = sorted(sizes)
    expected = water_filling([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))])
    for s, goal in zip(order, expected, strict=True):
        assert abs(target[s] - goal) < 1e-6
        # Whole epochs, and the sum of documents that comes nearest to the rest.
        epochs, rest = int(goal // sizes[s]), round(goal % sizes[s])
        sums = {0}
        for size in each[s]:
            sums |= {x + size for x in sums if x + size <= rest}
        assert taken[s] == epochs * sizes[s] + max(sums)
    again = mixing.digest(documents.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_mixed_documents_lie_in_order_of_their_places(spark, documents):
    rows = mixing.digest(documents).collect()
    places = sorted(
        (shard, place, r["doc_id"]) for r in rows for shard, place in zip(r["shards"], r["places"])
    )
    written = mixing.mix_documents(documents).select("doc_id").collect()
    assert [r["doc_id"] for r in written] == [p[2] for p in places]
    # Inside a shard the order says nothing about the source.
    source = {r["doc_id"]: r["source"] for r in documents.select("doc_id", "source").collect()}
    changes = sum(source[a[2]] != source[b[2]] for a, b in zip(places, places[1:]) if a[0] == b[0])
    sources = len({(p[0], source[p[2]]) for p in places})
    assert changes > 1.5 * sources


def test_pipeline(spark, documents, pairs):
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.digest(documents).collect() if r["kept"]}
            assert {r["doc_id"] for r in docs.collect()} == kept
        if name in ("near duplicates", "decontamination"):
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    final = corpus_pipeline.run(spark, SF).collect()
    check_shards([r.asDict() | {"size": len((r["text"] or "").encode()) + 1} for r in final])
    assert len(final) == docs.count()


def test_entry_registers_everything():
    import __spark_entry__ as entry

    names = set(entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
    assert "corpus_pipeline" in sys.modules
