"""Near-duplicates of word shingles by DartMinHash signatures.

A text is a weighted set: its shingles of five words with the number of times each occurs
(texts of one to four words have one shingle, empty texts none).  Every unit of weight of a
shingle is a strip of the plane (weight, rank); darts hit unit cells of it as a Poisson
process that depends on the hash of shingle and cell only, and each dart falls on one of k
coordinates.  A text keeps the earliest dart per coordinate among those in its own area,
which is high enough for k ln k + 2k darts; while a coordinate is empty the height doubles.
Two texts agree in a coordinate with a probability that is their weighted Jaccard similarity.

Bands of signatures give buckets.  Members of a bucket are compared with its centre, the one
that shares most buckets, by their whole shingle sets.  Members that fail, and those that the
triangle inequality lets be like one of them, are compared with another centre of the bucket,
unless the two are in one class already, and so on as long as such rounds settle a fair part.
What is in different classes even then is compared pair by pair, as far as a prefix filter
leaves it possible:
two texts at the threshold share one of their rarest shingles, at a place that leaves enough
others.  Classes are the connected components of pairs with a similarity of at least
``threshold``.

Exact copies (equal texts, null as empty) are one node from the start.  Rows without doc_id
take part; a class is named after its smallest doc_id.  Repeated rows and ties fall into one
class; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import packed, release, unpacked, whole_text, written
from ledgerloom.llm.vector import Words, chunks, grams, inside, mix

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
# Rounds of other centres go on while one settles this share of the open texts.
SETTLING = 0.05
# Shingles are ordered by the number of texts in their bin; any order gives the same pairs.
BINS = 2**16
# Members of one shingle that a task pairs with as many others.
BLOCK = 500

LOW48 = np.uint64(2**48 - 1)
# Poisson(1): the number of darts in a cell of area one, by its distribution function.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])


def elements(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 48-bit hash of every unit of weight, sorted by text."""
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    ok = inside(words, SHINGLE)
    doc = words.doc[: len(ok)][ok]
    hashed = grams(words, SHINGLE)[ok]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        own = [
            mix(np.uint64(len_) + words.hash[f : f + len_] * np.uint64(2 * SHINGLE + 1))
            for f, len_ in zip(words.first[short], words.counts[short], strict=True)
        ]
        folded = []
        for h in own:
            value = np.zeros(1, dtype=np.uint64)
            for x in h:
                value = mix(value * np.uint64(3) + x)
            folded.append(value[0])
        doc = np.concatenate([doc, short])
        hashed = np.concatenate([hashed, np.array(folded, dtype=np.uint64)])
    keys = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (hashed >> np.uint64(16)))
    # The second occurrence of a shingle is a unit of its own, and so on.
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.arange(len(keys))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    unit = mix((keys & LOW48) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64))
    return (keys >> np.uint64(48)).astype(np.int64), unit >> np.uint64(16)


def signatures(doc: np.ndarray, unit: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """Earliest dart per text and coordinate; all ones for texts without elements."""
    empty = np.uint64(2**64 - 1)
    signature = np.full(n_docs * k, empty, dtype=np.uint64)
    weight = np.bincount(doc, minlength=n_docs)
    wanted = k * math.log(k) + 2 * k
    height = wanted / np.maximum(weight, 1)
    done = np.zeros(n_docs)  # ranks below are thrown already
    active = weight > 0
    while active.any():
        mine = active[doc]
        d, u = doc[mine], unit[mine]
        low, high = done[d], height[d]
        first = np.floor(low).astype(np.int64)
        n_cells = np.ceil(high).astype(np.int64) - first
        at = np.repeat(np.arange(len(d)), n_cells)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)
        cell = first[at] + nth
        seed = mix(u[at] + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        n_darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)) * 2.0**-53)
        which = np.repeat(np.arange(len(at)), n_darts)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(n_darts) - n_darts, n_darts)
        dart = mix(seed[which] + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7))
        rank = cell[which] + (dart >> np.uint64(40)) * 2.0**-24
        owner = at[which]
        hit = (rank >= low[owner]) & (rank < high[owner])
        dart, rank, owner = dart[hit], rank[hit], d[owner[hit]]
        place = owner * k + ((dart & np.uint64(0xFFFFFFF)) % np.uint64(k)).astype(np.int64)
        # The bits of a positive float grow with it.
        order = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        np.minimum.at(signature, place, order | (mix(dart) >> np.uint64(32)))
        missing = (signature.reshape(n_docs, k) == empty).any(axis=1)
        done = np.where(active, height, done)
        active = active & missing
        height = np.where(active, height * 2, height)
    return signature.reshape(n_docs, k)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band, with the band's number in it."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return value


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        nodes = [hashlib.md5((t.as_py() or "").encode()).digest() for t in texts]
        for start, words in chunks(texts):
            doc, unit = elements(words)
            signature = signatures(doc, unit, words.n_docs)
            some = np.bincount(doc, minlength=words.n_docs) > 0
            flat = bands(signature)[some].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, words.n_docs),
                    pa.array(nodes[start : start + words.n_docs], pa.binary()),
                    lists,
                ],
                names=["doc_id", "node", "bands"],
            )


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in two columns, row by row."""
    size = len(left)
    keys, total = [], np.zeros(size)
    for column in (left, right):
        for start, words in chunks(column):
            doc, unit = elements(words)
            total[start : start + words.n_docs] += np.bincount(doc, minlength=words.n_docs)
            keys.append(((doc + start).astype(np.uint64) << np.uint64(48)) | unit)
    both = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64)
    twice = both[1:][both[1:] == both[:-1]]
    common = np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=size)
    union = total - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            value = similarities(part.column(2), part.column(3))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(value)], names=["a", "b", "similarity"]
            )


def _compared(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Similarity of each pair of nodes (a, b); ``texts`` has node and t."""
    left = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    result = joined.mapInArrow(_verify, "a binary, b binary, similarity double")
    return written(result, name)


def components(links: DataFrame, name: str = "classes") -> DataFrame:
    """Connected components of links (a, b): node and the name of its component.

    Each round joins every node to its smallest neighbour, follows those steps twice, and
    goes on with the links between the joined nodes, which are far fewer; it ends when none
    are left.  Rounds are written, so that lineage stays short, and replace the ones before.
    """
    different = links.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    edges = written(different, f"{name}-links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("a"), F.min("b")).alias("to")
        )
        near = written(near, f"{name}-steps")
        steps = near
        for _ in range(2):
            after = steps.select(F.col("node").alias("to"), F.col("to").alias("then"))
            steps = steps.join(after, "to").select("node", F.col("then").alias("to"))
        steps = written(steps, f"{name}-steps")
        before, old = edges, labels
        if labels is None:
            labels = steps.select("node", F.col("to").alias("label"))
        else:
            moved = steps.select(F.col("node").alias("label"), F.col("to"))
            labels = labels.join(moved, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            )
        labels = written(labels, f"{name}-labels")
        to_a = steps.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        to_b = steps.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(to_a, "a").join(to_b, "b")
        edges = edges.where(F.col("ta") != F.col("tb")).select(
            F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")
        )
        edges = written(edges.distinct(), f"{name}-links")
        release(before, near, steps, *([old] if old is not None else []))
    if labels is None:
        empty = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        labels = written(empty, f"{name}-labels")
    release(edges)
    return labels


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links (a, b); the old ones are released.

    A node without label is its own.
    """
    def side(name: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("label").alias(f"of_{name}"))

    between = (
        links.select("a", "b")
        .join(side("a"), "a", "left")
        .join(side("b"), "b", "left")
        .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    )
    moved = components(between, "relabelled")
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    kept = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    # Names of classes that had one node and so no label.
    new = moved.join(labels.select("node"), "node", "left_anti")
    result = written(kept.unionByName(new), "labels")
    release(moved, labels)
    return result


def _unresolved(spots: DataFrame, labels: DataFrame, radius: float) -> DataFrame:
    """Members, with labels, of buckets whose members may be alike and are in several classes.

    ``d`` is the distance from the centre.  Those outside the radius take part, and those
    inside it where somebody is so near outside that the two could be alike.
    """
    known = spots.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = written(known, "distances")
    far = F.when((F.col("d") > radius) & (F.col("d") <= 2 * radius), F.col("d"))
    nearest = known.groupBy("bucket").agg(F.min(far).alias("nearest"))
    taking_part = known.join(nearest, "bucket").where(
        (F.col("d") > radius) | (F.col("d") >= F.col("nearest") - radius - 1e-9)
    )
    several = taking_part.groupBy("bucket").agg(
        F.min("label").alias("lowest"), F.max("label").alias("highest")
    )
    mixed = taking_part.join(several.where("lowest != highest"), "bucket")
    result = written(mixed.select("bucket", "node", "label"), "unresolved")
    release(known)
    return result


def _other_stars(unresolved: DataFrame, turn: int) -> DataFrame:
    """Members (a) of buckets with another centre (b) of the bucket, where classes differ."""
    drawn = F.struct(F.xxhash64(F.lit(turn), "node").alias("draw"), "node", "label")
    tops = unresolved.groupBy("bucket").agg(F.max(drawn).alias("top"))
    return (
        unresolved.join(tops, "bucket")
        .where(F.col("label") != F.col("top.label"))
        .select(F.col("node").alias("a"), F.col("top.node").alias("b"))
        .distinct()
    )


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts with a shingle of the bin, for the bins that occur."""
    counts = np.zeros(BINS, dtype=np.int64)
    for batch in batches:
        for _, words in chunks(batch.column(0)):
            counts += np.bincount((elements(words)[1] % BINS).astype(np.int64), minlength=BINS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bin", "n"])


def _prefixes(counts: np.ndarray, threshold: float):
    """The rarest shingles of a text, so many that one at least is common to any two alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words in chunks(batch.column(2)):
                doc, unit = elements(words)
                order = np.lexsort((unit, counts[(unit % BINS).astype(np.int64)], doc))
                doc, unit = doc[order], unit[order]
                size = np.bincount(doc, minlength=words.n_docs)
                place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
                prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
                # What is alone in its bin is in no other text.
                rare = counts[(unit % BINS).astype(np.int64)]
                keep = np.flatnonzero((place < prefix[doc]) & (rare > 1))
                at = pa.array(doc[keep] + start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(unit[keep].astype(np.int64)),
                        pa.array(size[doc[keep]].astype(np.int64)),
                        pa.array(place[keep].astype(np.int64)),
                    ],
                    names=["node", "label", "unit", "size", "place"],
                )

    return run


def _possible(rest: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes in different classes that may be alike; none alike is left out.

    The second table is what the pairs are read from, to be released after them.

    The members of a frequent shingle are dealt to blocks, and each pair of blocks is a
    group of its own.
    """
    mine = texts.join(rest, "node").select("node", "label", "t")
    counts = np.zeros(BINS, dtype=np.int64)
    counted = mine.select("t").mapInArrow(_bins, "bin long, n long").groupBy("bin")
    for r in counted.agg(F.sum("n").alias("n")).collect():  # at most BINS rows
        counts[r["bin"]] = r["n"]
    prefixes = written(
        mine.select("node", "label", "t").mapInArrow(
            _prefixes(counts, threshold),
            "node binary, label binary, unit long, size long, place long",
        ),
        "prefixes",
    )
    groups = prefixes.groupBy("unit").agg(
        F.count("*").alias("n"), F.min("label").alias("lowest"), F.max("label").alias("highest")
    )
    groups = groups.where("lowest != highest").select(
        "unit", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    )
    dealt = prefixes.join(groups, "unit").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(name: str, own: str, other: str) -> DataFrame:
        return dealt.select(
            "unit",
            F.col("block").alias(own),
            every.alias(other),
            F.col("node").alias(name),
            F.col("label").alias(f"label_{name}"),
            F.col("size").alias(f"size_{name}"),
            (F.col("size") - F.col("place")).alias(f"left_{name}"),
        )

    # At the first common shingle no more than the shorter rest can be common.
    needed = (F.col("size_a") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6
    possible = (
        (F.col("a") < F.col("b"))
        & (F.col("label_a") != F.col("label_b"))
        & (F.least("left_a", "left_b") >= needed)
    )
    paired = side("a", "i", "j").join(side("b", "j", "i"), ["unit", "i", "j"])
    return paired.where(possible).select("a", "b").distinct(), prefixes


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node (digest of the text), class_id, class_size and keeper per row.

    ``keeper`` marks the rows of the one (doc_id, text) that stays for its class.
    """
    narrow = docs.select("doc_id", whole_text().alias("t"))
    sketches = written(
        narrow.mapInArrow(_sketch, "doc_id long, node binary, bands array<long>"), "sketches"
    )
    nodes = sketches.select("node", "bands").dropDuplicates(["node"])
    in_bands = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = in_bands.join(shared, "bucket")
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    members = written(members.join(fame, "node").select("bucket", "node", "fame"), "buckets")
    centres = members.groupBy("bucket").agg(F.max(F.struct("fame", "node")).alias("top"))
    starred = members.join(centres, "bucket").select(
        "bucket", "node", "fame", F.col("top.node").alias("centre")
    )
    stars = (
        starred.where(F.col("node") != F.col("centre"))
        .select(F.col("node").alias("a"), F.col("centre").alias("b"))
        .distinct()
    )
    # Texts that share a bucket; the rest of the texts is not needed again.
    keyed = narrow.withColumn("node", F.md5(F.encode("t", "utf-8"))).withColumn(
        "node", F.unhex("node")
    )
    wanted = members.select("node").distinct()
    shared_texts = keyed.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    texts = written(shared_texts.select("node", "t"), "bucket-texts")
    first = _compared(stars, texts, "star-similarities")
    close = F.col("similarity") >= threshold
    labels = components(first.where(close), "stars")

    # Members that are not like their centre may be like another member of the bucket.
    spots = (
        starred.where(F.col("node") != F.col("centre"))
        .join(first, (F.col("node") == F.col("a")) & (F.col("centre") == F.col("b")))
        .select("bucket", "node", (1 - F.col("similarity")).alias("d"))
    )
    rest = _unresolved(spots, labels, 1 - threshold)
    turn = 0
    while not rest.isEmpty():
        turn += 1
        compared = _compared(_other_stars(rest, turn), texts, "more-similarities")
        alike = compared.where(close)
        settled, open_nodes = alike.count(), rest.select("node").distinct().count()
        before = rest
        if settled:
            labels = _relabelled(labels, alike)
            rest = _unresolved(spots, labels, 1 - threshold)
            release(before)
        release(compared)
        if settled <= SETTLING * open_nodes:
            break
    if not rest.isEmpty():
        # What no centre has settled is compared pair by pair.
        nodes_left = rest.select("node", "label").distinct()
        possible, prefixes = _possible(nodes_left, texts, threshold)
        last_pairs = _compared(possible, texts, "third-similarities")
        labels = _relabelled(labels, last_pairs.where(close))
        release(last_pairs, prefixes)
    release(rest, first, texts, members)

    by_node = sketches.groupBy("node").agg(
        F.min("doc_id").alias("smallest"), F.count("*").alias("copies")
    )
    named = by_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named, "named")
    last = F.lit(2**63 - 1)
    summed = named.groupBy("label").agg(
        F.min("smallest").alias("class_id"),
        F.sum("copies").alias("class_size"),
        F.min(F.struct(F.coalesce("smallest", last).alias("smallest"), "node")).alias("first"),
    )
    of_node = named.join(summed, "label").select(
        F.col("node").alias("n_node"), "class_id", "class_size", "first"
    )
    result = sketches.join(of_node, F.col("node") == F.col("n_node")).select(
        "doc_id",
        "node",
        "class_id",
        "class_size",
        (
            (F.col("node") == F.col("first.node"))
            & (F.coalesce("doc_id", last) == F.col("first.smallest"))
        ).alias("keeper"),
    )
    result = written(result, "classes")
    release(sketches, labels, named)
    return result


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; all its columns."""
    last = F.lit(2**63 - 1)
    kept = classes(docs, threshold).where("keeper")
    kept = kept.select(F.coalesce("doc_id", last).alias("id"), "node").distinct()
    rows = packed(docs).select(
        "row",
        F.coalesce("row.doc_id", last).alias("id"),
        F.unhex(F.md5(F.encode(whole_text("row.text"), "utf-8"))).alias("node"),
    )
    one = rows.join(kept, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    return unpacked(one, docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "class_size", "keeper")
