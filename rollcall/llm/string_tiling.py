"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as lower-case words. Seeds, runs of ``LEAST``
words that both have, name the pairs worth comparing; for such a pair the longest common run
of words that no tile holds yet is found by Karp-Rabin hashes and marked, again and again,
until none of ``LEAST`` words is left. The tiles may stand in any order, so passages that were
rearranged are caught too. A document is contaminated by an item whose words are covered to
``COVERAGE`` or more.

The benchmark is a stated query set: it goes to the tasks in blocks of at most
``BLOCK_TOKENS`` words, and each block is held against all documents in one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import give_back

LEAST = 5
COVERAGE = 0.5
BLOCK_TOKENS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TILES = "doc_id {id}, item_id {item}, coverage double, matched int, words int, " \
        "tiles array<struct<doc_start:int,item_start:int,length:int>>"

find_words = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def words(text: str | None) -> list[str]:
    return find_words((text or "").lower())


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def scattered(ids: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each word id."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Karp-Rabin hashes of all windows of a sequence of word ids, of any length."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(scattered(ids) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n)

    def hashes(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n] if n > 0 else np.empty(0, np.uint64)


def free_starts(taken: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows in which nothing is taken."""
    total = np.concatenate([[0], np.cumsum(taken)])
    return np.flatnonzero(total[length:] == total[:-length])


def tiling(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length), longest first; negative ids match nothing."""
    a, b = Windows(doc), Windows(item)
    taken_a, taken_b, tiles = doc < 0, np.zeros(len(item), bool), []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at_a, at_b = free_starts(taken_a, length), free_starts(taken_b, length)
        in_a, in_b = a.hashes(length)[at_a], b.hashes(length)[at_b]
        hit = np.isin(in_a, in_b)
        return at_a[hit], in_a[hit], at_b, in_b

    longest = min(len(doc), len(item))
    while longest >= least:
        low, high = least - 1, longest  # a common run of low words is known, or none is asked for
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        at_a, in_a, at_b, in_b = common(low)
        places: dict[int, list[int]] = {}
        for start, value in zip(at_b[::-1].tolist(), in_b[::-1].tolist()):
            places.setdefault(value, []).append(start)
        for start, value in zip(at_a.tolist(), in_a.tolist()):
            if taken_a[start:start + low].any():
                continue
            left = places[value]
            while left and taken_b[left[-1]:left[-1] + low].any():
                left.pop()
            if left and np.array_equal(doc[start:start + low], item[left[-1]:left[-1] + low]):
                other = left.pop()
                taken_a[start:start + low] = taken_b[other:other + low] = True
                tiles.append((start, other, low))
        longest = low - 1
    return tiles


class Block:
    """A block of benchmark items with its seeds, and the comparison of documents with it."""

    def __init__(self, items: list[tuple[object, list[str]]], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        self.names = [name for name, _ in items]
        self.known: dict[str, int] = {}
        ids = [np.array([self.known.setdefault(w, len(self.known)) for w in ws], np.int64) for _, ws in items]
        self.items = ids
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        spots = [np.arange(self.first[i], self.first[i] + max(0, len(x) - least + 1)) for i, x in enumerate(ids)]
        self.spots = np.concatenate(spots) if spots else np.empty(0, np.int64)
        hashes = np.concatenate([Windows(x).hashes(least) for x in ids]) if ids else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.counts = np.unique(hashes, return_counts=True)
        self.spots, self.ends = self.spots[order], np.cumsum(self.counts)

    def candidates(self, seeds: np.ndarray) -> np.ndarray:
        """Items that the given seeds could cover far enough."""
        spots = np.sort(np.concatenate([self.spots[self.ends[s] - self.counts[s]:self.ends[s]] for s in seeds.tolist()]))
        item = np.searchsorted(self.first, spots, "right") - 1
        gap = np.full(len(spots), self.least)
        same = item[1:] == item[:-1]
        gap[:-1][same] = np.minimum(self.least, np.diff(spots)[same])
        covered = np.bincount(item, gap, len(self.items))
        return np.flatnonzero((covered > 0) & (covered >= self.coverage * self.sizes))

    def against(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(text number, item number, coverage, tiles) of every contaminated text."""
        split = [words(t) for t in texts]
        known = self.known
        flat = np.array([known.get(w, -1) for ws in split for w in [*ws, ""]], np.int64)
        starts = free_starts(flat < 0, self.least)
        if not len(starts) or not len(self.seeds):
            return
        hashes = Windows(flat).hashes(self.least)[starts]
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = self.seeds[at] == hashes
        starts, at = starts[hit], at[hit]
        begins = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in split])])
        owner = np.searchsorted(begins, starts, "right") - 1
        for text in np.unique(owner).tolist():
            mine = slice(*np.searchsorted(owner, [text, text + 1]))
            places, seeds = starts[mine], at[mine]
            for item in self.candidates(np.unique(seeds)).tolist():
                spread = np.unique((places[:, None] + np.arange(self.least)).ravel())
                cut = np.flatnonzero(np.diff(spread) > 1) + 1
                # The text's words in seeds; -1 keeps tiles from reaching over what was left out.
                place = np.insert(spread, cut, -1)
                part = np.where(place < 0, -1, flat[np.maximum(place, 0)])
                tiles = tiling(part, self.items[item], self.least)
                covered = sum(n for _, _, n in tiles) / self.sizes[item]
                if covered >= self.coverage:
                    yield text, item, float(covered), [(int(place[a] - begins[text]), b, n) for a, b, n in tiles]


def blocks(benchmark: DataFrame, least: int, coverage: float) -> Iterator[Block]:
    """The items, ``BLOCK_TOKENS`` words at a time; one longer item is a block of its own.

    Items of fewer than ``least`` words, or without any, can't be told from chance and match nothing.
    """
    held, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ws = words(text)
        if len(ws) < least:
            continue
        if held and size + len(ws) > BLOCK_TOKENS:
            yield Block(held, least, coverage)
            held, size = [], 0
        held.append((item_id, ws))
        size += len(ws)
    if held:
        yield Block(held, least, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item that it gives away: coverage, words and tiles.

    Documents with null or empty texts give none; repeated rows give repeated rows. An empty
    benchmark or document table gives an empty result.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.select("doc_id").schema[0].dataType, benchmark.select("item_id").schema[0].dataType
    schema = TILES.format(id=doc_kind.simpleString(), item=item_kind.simpleString())
    names = [f.split()[0] for f in schema.split(", ")]
    tile = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
    found = spark.createDataFrame([], schema)

    def compare(sent):
        def run(batches):
            block = sent.value
            for batch in batches:
                hits = list(block.against(batch.column(1).to_pylist()))
                if hits:
                    rows, items, covered, tiles = zip(*hits)
                    item_names = pa.array([block.names[i] for i in items])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(rows)), item_names, pa.array(covered, pa.float64()),
                        pa.array([sum(n for _, _, n in t) for t in tiles], pa.int32()),
                        pa.array([int(block.sizes[i]) for i in items], pa.int32()),
                        pa.array([[dict(zip(("doc_start", "item_start", "length"), x)) for x in t] for t in tiles], tile),
                    ], names)
        return run

    for block in blocks(benchmark, least, coverage):
        sent = spark.sparkContext.broadcast(block)
        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(compare(sent), schema))
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The documents that give no item away, with their columns as they came."""
    spark, at = docs.sparkSession, docs.columns.index("text")

    def keep(sent):
        def run(batches):
            for batch in batches:
                bad = {hit[0] for hit in sent.value.against(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))
            give_back()
        return run

    for block in blocks(benchmark, least, coverage):
        docs = docs.mapInArrow(keep(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
