"""Near-duplicates by DartMinHash: weighted signatures, banded joins, an exact check.

A text is a weighted set of shingles of five words: a shingle weighs as much as it has
occurrences. Each unit of a shingle's weight is a region into which darts are thrown by hash:
their ranks are the arrivals of a Poisson process, and each lands in one of ``K`` coordinates. A text throws only until about
``K * (ln K + 3)`` darts have landed, whatever its length, and keeps the earliest dart per
coordinate; texts with an empty coordinate throw on. Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.

Texts with equal words are one node from the start. Nodes that agree in a whole band are
candidates. In each band's bucket every node is compared with the first one only, exactly: that
of the smallest doc_id, which copies mostly come after.
Components of the links found so far then leave few buckets with nodes of several components;
among those, pairs that could still be similar are compared as well. Two bounds rule the
others out: the distances to the first node (the triangle inequality holds for this
distance), and the weight that two nodes can have in common at most, within the first node
and outside it, where what a node shares with no other at all doesn't count. For the second
bound each node has two marks of ``MARKS`` bits, of the shingles that it has less often than the
first node and of those that it has more often: a bit that only one of two nodes has is a shingle
that they can't have in common. One node of the largest component of each such bucket is compared with the other components
first; what that joins isn't compared again. So no link inside a bucket is lost, and a bucket of
copies costs a row per node, not per pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm import blocks as packing
from rollcall.llm.components import components
from rollcall.llm.shared import give_back, materialised

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
THROWN = K * (np.log(K) + 3)
ODD = np.uint64(0x9E3779B97F4A7C15)
MARKS = 512


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle; a text of fewer than five words is one shingle."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = [w for t in texts for w in t]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(flat)}
    base = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    n = len(flat)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    left = np.repeat(begins + sizes, sizes) - np.arange(n)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        part = np.zeros(n, np.uint64)
        part[:max(0, n - k)] = base[k:]
        total = total * ODD + np.where(left > k, part, np.uint64(k))
    whole = (left >= SHINGLE) | ((left == sizes[owner]) if n else np.zeros(0, bool))
    return mixed(total[whole]), owner[whole]


def signatures(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """K values for each text, and its weight; texts without words get zeros."""
    out = np.zeros((len(texts), K), np.uint64)
    found, owner = shingles(texts)
    if not len(found):
        return out, np.zeros(len(texts), np.int64)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
    units = np.diff(np.append(new, len(found)))
    # A shingle's units are told apart by their number.
    number = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    regions, owner = np.repeat(found[new], units) + number.astype(np.uint64) * ODD, np.repeat(owner[new], units)
    regions = mixed(regions)
    weight = np.bincount(owner, minlength=len(texts))
    open_texts, limit = np.flatnonzero(weight), THROWN
    while len(open_texts):
        ours = np.isin(owner, open_texts)
        best = np.full(len(texts) * K, np.inf)
        darts = []
        region, text = regions[ours], owner[ours]
        rank, throw, reach = np.zeros(len(region)), 0, limit / np.maximum(weight, 1)
        while len(region):
            throw += 1
            value = mixed(region + np.array([throw], np.uint64) * ODD)
            rank = rank - np.log(((value >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            alive = rank < reach[text]
            region, text, rank, value = region[alive], text[alive], rank[alive], mixed(value[alive] + ODD)
            cell = text * K + (value % np.uint64(K)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            darts.append((cell, rank, value))
        for cell, rank, value in darts:
            first = rank == best[cell]
            out.reshape(-1)[cell[first]] = value[first]
        short = np.isinf(best.reshape(len(texts), K)[open_texts]).any(axis=1)
        open_texts, limit = open_texts[short], limit * 2
    return out, weight


def bands(signature: np.ndarray) -> np.ndarray:
    total = np.zeros((len(signature), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        total = mixed(total * ODD + signature.reshape(-1, BANDS, ROWS)[:, :, row])
    return total


def weights_of(text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles([text])[0], return_counts=True)


def mark(found: np.ndarray) -> list[int]:
    """Bits of shingles, as longs."""
    bits = np.zeros(MARKS, np.uint8)
    bits[(found >> np.uint64(40)) % np.uint64(MARKS)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], list[int]]:
    """Marks of the shingles that weigh more in a than in b, and of those that weigh more in b."""
    both, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    more_a, more_b = np.ones(len(a[0]), bool), np.ones(len(b[0]), bool)
    more_a[in_a], more_b[in_b] = a[1][in_a] > b[1][in_b], b[1][in_b] > a[1][in_a]
    return mark(a[0][more_a]), mark(b[0][more_b])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, int]:
    """Weighted Jaccard similarity of two texts, each its distinct shingles and their weights, and the common weight."""
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][in_a], b[1][in_b]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)), int(both)


SIGNED = "block long, place int, doc_id long, node binary, size long, bands array<long>"


def signed(blocks: DataFrame, at_id: int, at_text: int) -> DataFrame:
    """A row per document: where it is, its node (a digest of its words), and band hashes.

    Documents without words have no node and no bands.
    """
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    names = [f.split()[0] for f in SIGNED.split(", ")]

    def work(number, rows):
        split = [words(t) for t in rows.column(at_text).to_pylist()]
        ids = rows.column(at_id).to_pylist()
        for start in range(0, len(split), 500):
            part = split[start:start + 500]
            nodes = [hashlib.md5(b" ".join(t)).digest() if t else None for t in part]
            first = {}
            for i, node in enumerate(nodes):
                first.setdefault(node, i)
            signature, weight = signatures([part[i] for i in first.values()])
            hashed = dict(zip(first, zip(bands(signature).view(np.int64).tolist(), weight.tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((
                [number] * len(part), range(start, start + len(part)), ids[start:start + 500], nodes,
                [hashed[n][1] for n in nodes], [hashed[n][0] if n else None for n in nodes]), kinds)], names)

    return packing.each(blocks, work, SIGNED)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds the exact ``similarity``, the weight of ``both`` and marks of what is more in a and in b to pairs of nodes."""
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b") \
        .join(texts.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").select("a", "b", "wa", "wb")

    def run(batches):
        known: dict[bytes, tuple] = {}

        def counted(node, squeezed):
            if node not in known:
                if len(known) > 300:
                    known.clear()
                text = zstandard.ZstdDecompressor().decompress(squeezed).split(b" ")
                known[node] = weights_of(text)
            return known[node]

        for batch in batches:
            a, b, wa, wb = (c.to_pylist() for c in batch.columns)
            found = []
            for w, y, x, z in zip(a, b, wa, wb):
                one, other = counted(w, x), counted(y, z)
                found.append((*similarity(one, other), *differing(one, other)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))],
                ["a", "b", "similarity", "both", "more_a", "more_b"])
        known.clear()
        give_back()

    kinds = [pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return joined.mapInArrow(
        run, "a binary, b binary, similarity double, both long, more_a array<long>, more_b array<long>")


def node_texts(blocks: DataFrame, documents: DataFrame, nodes: DataFrame, at_text: int) -> DataFrame:
    """The words (compressed) of the given nodes, fetched from one document of each."""
    place = documents.where("node is not null").groupBy("node").agg(F.min(F.struct("block", "place")).alias("at"))
    wanted = place.join(nodes, "node").groupBy(F.col("at.block").alias("block")).agg(
        F.collect_list(F.struct("node", F.col("at.place").alias("place"))).alias("wanted"))

    def work(number, rows, wanted):
        texts, squeeze = rows.column(at_text), zstandard.ZstdCompressor(level=1)
        for start in range(0, len(wanted), 500):
            part = wanted[start:start + 500]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["node"] for w in part], pa.binary()),
                 pa.array([squeeze.compress(b" ".join(words(texts[w["place"]].as_py()))) for w in part], pa.binary())],
                ["node", "words"])

    return materialised(packing.each(blocks.join(wanted, "block"), work, "node binary, words binary", "wanted"), "texts")


def unshared(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The weight of those shingles of each of the given nodes that no other one of them has; nodes without are left out."""
    names = ["shingle", "node", "weight"]

    def run(batches):
        for batch in batches:
            for node, squeezed in zip(*(c.to_pylist() for c in batch.columns)):
                found, weight = weights_of(zstandard.ZstdDecompressor().decompress(squeezed).split(b" "))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array([node] * len(found), pa.binary()),
                                                  pa.array(weight)], names)
        give_back()

    rows = texts.join(nodes, "node").select("node", "words").mapInArrow(run, "shingle long, node binary, weight long")
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min(F.struct("node", "weight")).alias("x")).where("n = 1")
    return once.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.weight").alias("unshared"))


def only(x: str, y: str, marks: str) -> Column:
    """How many bits of ``marks`` x has and y has not."""
    own, other = (lambda i, side=side: F.col(f"{side}.{marks}")[i] for side in (x, y))
    return sum((F.bit_count(own(i).bitwiseAND(F.bitwise_not(other(i)))) for i in range(MARKS // 64)), F.lit(0))


def open_pairs(x: DataFrame, y: DataFrame, once: Column) -> DataFrame:
    """Nodes a and b, x's and y's in a bucket, of different components and with no bound against their being similar."""
    x, y = x.alias("x"), y.alias("y")
    near = F.abs(F.col("x.far") - F.col("y.far")) <= 1 - SIMILAR + 1e-9
    rough = F.least("x.both", "y.both") + F.least("x.rest", "y.rest")
    inside = F.least(F.col("x.both") - only("y", "x", "less"), F.col("y.both") - only("x", "y", "less"))
    outside = [F.col(f"{i}.size") - F.col(f"{i}.both") - only(i, j, "more") for i, j in ("xy", "yx")]
    most = inside + F.least("x.rest", "y.rest", *outside)

    def enough(both):
        return both >= SIMILAR * (F.col("x.size") + F.col("y.size") - both) - 1e-9

    met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & near & enough(rough) & enough(most)
    return x.join(y, met & once).select(
        F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """``grouped`` (node, label) after further links between nodes a and b, by components of labels."""
    of = {c: grouped.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"}
    met = links.join(of["a"], "a", "left").join(of["b"], "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()
    new = components(met).withColumnRenamed("label", "lower")
    nodes = grouped.unionByName(new.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    return nodes.join(new.withColumnRenamed("node", "label"), "label", "left").select(
        "node", F.coalesce("lower", "label").alias("label"))


def classes(blocks: DataFrame, at_id: int, at_text: int) -> DataFrame:
    """block, place and doc_id of every document with its node and ``label``, equal within a class."""
    documents = materialised(signed(blocks, at_id, at_text), "signed")
    in_bands = documents.where("node is not null").select("node", "doc_id", "size", F.explode("bands").alias("bucket"))
    tops = in_bands.groupBy("bucket").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.min("node").alias("low"), F.max("node").alias("high"))
    tops = tops.where("low < high").select("bucket", F.col("first.node").alias("top"))
    in_bands = in_bands.drop("doc_id")
    members = materialised(in_bands.join(tops, "bucket").distinct(), "members")
    pair = F.greatest("node", "top").alias("a"), F.least("node", "top").alias("b")
    starred = members.where("node <> top").select(*pair).distinct()
    starred = materialised(starred, "starred")
    nodes = starred.select(F.col("a").alias("node")).unionByName(starred.select(F.col("b").alias("node"))).distinct()
    texts = node_texts(blocks, documents, nodes, at_text)
    measured = materialised(compared(starred, texts), "compared")
    links = measured.where(F.col("similarity") >= SIMILAR).select("a", "b")
    grouped = components(links)

    label = F.coalesce("label", "node").alias("label")
    placed = members.join(grouped, "node", "left").select("bucket", "node", "size", "top", label)
    mixed_up = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    placed = placed.join(mixed_up.select("bucket"), "bucket")
    placed = placed.where("node <> top").select("*", *pair).join(measured, ["a", "b"])
    placed = materialised(placed.select(
        "bucket", "node", "top", "size", "label", (1 - F.col("similarity")).alias("far"), "both",
        F.when(F.col("top") == F.col("a"), F.col("more_a")).otherwise(F.col("more_b")).alias("less"),
        F.when(F.col("top") == F.col("a"), F.col("more_b")).otherwise(F.col("more_a")).alias("more")), "mixed")
    alone = unshared(texts, placed.select(F.explode(F.array("node", "top")).alias("node")).distinct())
    placed = materialised(placed.join(alone, "node", "left").withColumn(
        "rest", F.col("size") - F.col("both") - F.coalesce("unshared", F.lit(0))).drop("unshared", "top"), "bounded")
    # One node of the largest component of a bucket meets the others first.
    largest = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min("node").alias("node")).groupBy("bucket").agg(
        F.max(F.struct("n", "node")).alias("at")).select("bucket", F.col("at.node").alias("node"))
    more = open_pairs(placed.join(largest, ["bucket", "node"]), placed, F.lit(True))
    more = compared(more, texts).where(F.col("similarity") >= SIMILAR).select("a", "b")
    grouped = materialised(merged(grouped, more), "grouped")
    placed = materialised(placed.drop("label").join(grouped, "node", "left").withColumn("label", label), "regrouped")
    # A node linked to the first needs comparing with those that are not.
    once = (F.col("y.far") <= 1 - SIMILAR) | (F.col("x.node") < F.col("y.node"))
    more = open_pairs(placed.where(F.col("far") > 1 - SIMILAR), placed, once)
    grouped = merged(grouped, compared(more, texts).where(F.col("similarity") >= SIMILAR).select("a", "b"))
    own = F.concat(F.lit("row").cast("binary"), F.encode(F.concat_ws(":", "block", "place"), "UTF-8"))
    return documents.join(grouped, "node", "left").select(
        "block", "place", "doc_id", "node", F.coalesce("label", "node", own).alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, ``class_id`` (the smallest doc_id of its class) and ``class_size``.

    Documents without words, null texts among them, are classes of their own. Repeated rows
    belong to one class. Where every id of a class is null, so is class_id.
    """
    found = materialised(classes(packing.packed(docs.select("doc_id", "text")), 0, 1), "classes")
    sizes = found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(sizes, "label").select("doc_id", "class_id", "class_size")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each class, with its columns as they came."""
    blocks = packing.packed(docs)
    found = materialised(classes(blocks, docs.columns.index("doc_id"), docs.columns.index("text")), "classes")
    firsts = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "block", "place")).alias("at"))
    kept = firsts.groupBy(F.col("at.block").alias("block")).agg(F.collect_list("at.place").alias("places"))
    names = docs.columns

    def work(number, rows, places):
        chosen = rows.take(pa.array(sorted(places)))
        for start in range(0, chosen.num_rows, 1000):
            yield pa.RecordBatch.from_arrays(chosen.slice(start, 1000).columns, names)

    return packing.each(blocks.join(kept, "block"), work, docs.schema, "places")
