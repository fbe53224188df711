"""The trained models: gradients, probabilities, held-out accuracy."""

import tracemalloc
from collections import Counter
from types import SimpleNamespace
from unittest import mock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from plain import crc, unigram

from ledgerloom.llm import pitmanyor, toxicity

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    net = {
        k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape)
        for k, v in toxicity.new_net(rng).items()
    }
    x = rng.standard_normal((3, 7, toxicity.INPUTS))
    mask = np.ones((3, 7))
    mask[1, 4:] = 0
    x *= mask[:, :, None]
    y = np.array([1.0, 0, 1])

    def loss():
        logit, _ = toxicity.forward(net, x, mask)
        return (np.log1p(np.exp(logit)) - y * logit).sum()

    logit, kept = toxicity.forward(net, x, mask, keep=True)
    grad = toxicity.backward(net, kept, toxicity.sigmoid(logit) - y)
    for k, v in net.items():
        for place in list(np.ndindex(v.shape))[:5]:
            old = v[place]
            v[place] = old + 1e-5
            up = loss()
            v[place] = old - 1e-5
            down = loss()
            v[place] = old
            assert abs((up - down) / 2e-5 - grad[k][place]) < 1e-7


def test_windows_cover_texts():
    counts = np.array([0, 1, 64, 65, 200])
    first = np.cumsum(counts) - counts
    doc, start = toxicity.windows(counts, first)
    for d, n in enumerate(counts):
        mine = start[doc == d] - first[d]
        covered = {i for s in mine for i in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n))


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.digest(docs, labels).collect() if r["doc_id"] in truth]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"]]
    toxic = [s for s, y in held if y]
    clean = [s for s, y in held if not y]
    above = np.mean([a > b for a in toxic for b in clean])
    assert above > 0.8


def test_toxicity_without_a_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.digest(docs, labels).collect()} == {toxicity.NO_WORDS}


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**6, None), (10**6 + 1, "ÀB aB AB")]
    frame = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    expected, total = unigram(pairs)
    rows = pitmanyor.digest(frame).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        held, tokens, known, base = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (held, tokens, known)
        assert r["train_tokens"] == total and abs(r["base_score"] - base) < 1e-6
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    """Over all words and the unseen one, in every context, for any seating."""
    rng = np.random.default_rng(3)
    words = (np.arange(1, 41, dtype=np.uint64) << np.uint64(32)) & ~pitmanyor.LOW
    key = np.sort((words[:, None] | np.arange(3, dtype=np.uint64)).ravel())
    count = rng.integers(0, 50, len(key)) * (rng.random(len(key)) < 0.6)
    nothing = np.zeros(0, np.int64)
    total = count.reshape(-1, 3).sum(axis=1)
    data = pitmanyor.pack(key, count, nothing.astype(np.int32), nothing, nothing, total, total)
    r = pitmanyor.Range(data)
    sums = pitmanyor._first_sums(r)
    customers = sums[pitmanyor.CLASSES + 2 : 2 * pitmanyor.CLASSES + 2]
    first = pitmanyor._totals(sums, customers)
    n_words = int((r.total > 0).sum())
    model = pitmanyor.Model(n_words, int(r.total.sum()), 0.6, 0.4, (first,))
    for _, tables, root in r.sweeps(model):
        assert (tables <= r.count).all() and ((tables > 0) == (r.count > 0)).all()
        totals = pitmanyor._totals(r.sums(tables, root), customers)
        p = pitmanyor.probability(r, tables, root, model, totals)
        base = pitmanyor.root_probability(np.zeros(1), np.zeros(1), model, totals)[0]
        for c in range(3):
            n = 1 + totals.customers[c]
            unseen = (1 + 0.6 * totals.tables[c]) / n * base
            seen = p[(r.context == c) & (r.total[r.word] > 0)].sum()
            assert abs(seen + unseen - 1) < 1e-9


def test_sweeps_can_be_repeated():
    c = np.arange(200)
    key = np.arange(200, dtype=np.uint64)
    a = pitmanyor.seat(c, np.full(200, 0.5), 0.5, key)
    order = np.random.default_rng(0).permutation(200)
    b = pitmanyor.seat(c[order], np.full(200, 0.5), 0.5, key[order])
    assert (a[order] == b).all()
    assert (a <= c).all() and a[1:].min() >= 1 and a[0] == 0


def one_by_one(customers, weight, discount, draws):
    """Seat the customers of a word singly; a draw below a new table's share opens one."""
    tables = 1
    for seated in range(1, customers):
        old = seated - discount * tables
        tables += next(draws) < weight / (weight + old)
    return tables


def test_seating_one_by_one():
    customers = np.arange(1, pitmanyor.ONE_BY_ONE + 1)
    key = np.arange(len(customers), dtype=np.uint64)
    got = pitmanyor.seat(customers, np.full(len(key), 0.8), 0.6, key)
    for c, k, tables in zip(customers, key, got, strict=True):
        draws = (pitmanyor._uniform(np.array([k]), step)[0] for step in range(1, 99))
        assert tables == one_by_one(c, 0.8, 0.6, draws)


def test_seating_in_groups_keeps_the_mean():
    rng = np.random.default_rng(5)
    n = 400
    got = pitmanyor.seat(np.full(n, 500), np.full(n, 3.0), 0.5, np.arange(n, dtype=np.uint64))
    exact = [one_by_one(500, 3.0, 0.5, iter(rng.random(500))) for _ in range(n)]
    assert abs(got.mean() / np.mean(exact) - 1) < 0.05


def block_rows(texts, start=0):
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(range(start, start + len(texts)), pa.int64()), "text": pa.array(texts)}
    )
    context = SimpleNamespace(partitionId=lambda: start)
    with mock.patch.object(pitmanyor.TaskContext, "get", return_value=context):
        return [row for b in pitmanyor._split(iter([batch])) for row in b.to_pylist()]


TEXTS = [
    ["the cat sat", "the cat ran", "", "a dog ran", "the Dog sat down"],
    ["THE cat sat down", "a cat a cat a cat", "dog", "the end"],
]


def test_a_block_takes_few_bytes_a_token():
    rng = np.random.default_rng(0)
    text = " ".join(f"w{x}" for x in rng.zipf(1.3, 200_000).clip(max=50_000))
    (row,) = block_rows([text], next(i for i in range(9) if crc(i) % 5 != 1))
    tracemalloc.start()
    block = pitmanyor.Block(row)
    most = tracemalloc.get_traced_memory()[1] / 200_001
    tracemalloc.stop()
    assert len(block.token) == block.count.sum() == 200_001
    pair = block.token.astype(np.int64) * len(block.words)
    pair += np.append(np.searchsorted(block.words, pitmanyor.END), block.token[:-1])
    at = block.word * len(block.words) + block.context
    assert np.array_equal(at[block.place], pair) and (np.diff(at) > 0).all()
    assert most < 45


def test_pairs_are_counted_once():
    """Counts of pairs over blocks against a plain count; every pair has one owner."""
    rows = block_rows(TEXTS[0]) + block_rows(TEXTS[1], 50)
    plain = Counter()
    for texts, start in zip(TEXTS, (0, 50), strict=True):
        for i, text in enumerate(texts, start):
            if crc(i) % 5 != 1:
                words = [None, *text.lower().split(), None]
                plain.update(zip(words, words[1:]))
    schema = [pa.field("block", pa.int64()), pa.field("data", pa.binary())]
    fields = {"lengths": pa.binary(), "held": pa.list_(pa.bool_()), "doc_ids": pa.list_(pa.int64())}
    schema = pa.schema([*schema, *[pa.field(k, t) for k, t in fields.items()]])
    asked = pa.Table.from_batches(
        pitmanyor._ask(4, 40)(pa.RecordBatch.from_pylist([r], schema=schema) for r in rows)
    )
    parts = sorted(set(asked["part"].to_pylist()))
    answers = pa.concat_tables(
        pitmanyor._merge(asked.filter(pc.equal(asked["part"], p))) for p in parts
    )
    counts, total = [], 0
    for row in rows:
        mine = answers.filter(pc.equal(answers["block"], row["block"]))
        opened = pitmanyor._open(4)(pa.Table.from_pylist([row], schema=schema), mine).to_pylist()
        count, own = pitmanyor._kept(opened)
        counts += count[own & (count > 0)].tolist()
        block = pitmanyor.Block(row)
        names = {}
        tokens = [t for text in TEXTS[row["block"] > 0] for t in [*text.lower().split(), None]]
        names.update(zip(block.token.tolist(), tokens, strict=True))
        for w, c, k in zip(block.word.tolist(), block.context.tolist(), count.tolist(), strict=True):
            assert plain[names[c], names[w]] == k
    assert sorted(counts) == sorted(plain.values())


def test_pair_probabilities_sum_to_one():
    """Over all words, seen after the context or not, for any seating."""
    rng = np.random.default_rng(7)
    base = rng.random(30)
    base /= base.sum()
    count = rng.integers(0, 9, 30) * (rng.random(30) < 0.4)
    tables = np.ceil(count * rng.random(30))
    p = pitmanyor.pair_probability(count, tables, count.sum(), tables.sum(), base, 0.7)
    assert abs(p.sum() - 1) < 1e-12
    assert (pitmanyor.pair_probability(0, 0, 0, 0, base, 0.7) == base).all()


def test_blocks_and_partitions_do_not_matter(spark, monkeypatch):
    texts = [t for some in TEXTS for t in some] * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r for r in pitmanyor.digest(docs.coalesce(1)).collect()}
    monkeypatch.setattr(pitmanyor, "BLOCK", 40)
    for r in pitmanyor.digest(docs.repartition(3)).collect():
        for name in ("score", "base_score"):
            assert abs(r[name] - whole[r["doc_id"]][name]) < 1e-5
        assert r["n_known"] == whole[r["doc_id"]]["n_known"]


def test_a_word_follows_its_own_context(spark):
    """Words of one ending class: what was seen after a word counts more after that word."""
    texts = ["bat cow", "cat sow"] * 200 + ["bat cow", "bat sow"]
    ids = [i for i in range(2000) if crc(i) % 5 != 1][:400] + [
        i for i in range(5000, 9000) if crc(i) % 5 == 1
    ][:2]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in pitmanyor.digest(docs).collect()}
    assert score[ids[-2]] > score[ids[-1]] + 0.5
