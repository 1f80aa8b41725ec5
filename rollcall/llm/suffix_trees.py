"""Removal of repeated passages with prefix-partitioned suffix trees.

A suffix is the run of words from one position of a document to its end; a window, its first
``SPAN`` words. Suffixes are split into groups by a prefix of variable length: four words, or
eight or all of the window where the shorter prefix is so common that its group would not fit.
Within a group suffixes are put in the order of their windows, which lays the leaves below one
node of the suffix tree side by side; a node at depth ``SPAN`` with several leaves is a repeat,
its earliest leaf (smallest document, then position) stays and the others are marked. Marks
that follow one another make up the maximal repeat, and the words they cover are removed.

Steps, each a Spark job over blocks of a few megabytes of whole documents:

1. Documents are packed into blocks (compressed, written once).
2. Pruning: a window contains several runs of ``ANCHOR`` words, of which the one with the
   smallest hash is its anchor. Equal windows have equal anchors, so a window whose anchor is
   in no other block can repeat inside its own block only.
3. The other windows become suffixes, one per block and window: the block's earliest. Further
   ones in the block have an earlier leaf beside them. So a passage that a third of all
   documents share costs a row per block, and no group holds a row per document.
4. Marks go back to their blocks, which remove the words.

Words are compared by 64-bit hashes; prefix and window must both agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rollcall.llm import blocks as packing
from rollcall.llm.shared import materialised

SPAN, ANCHOR = 20, 8
PREFIXES = (4, 8, SPAN)
# A prefix of a larger share of all windows than this is lengthened; so at most 1/SHARE are.
SHARE = 1 / 2000
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Block:
    """A block's words and the hashes of the runs of words that start at each of them.

    Documents are in ascending order of id, nulls first; rows with one id stay as they came.
    A null text has no words.
    """

    def __init__(self, ids: list, texts: list):
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
        self.ids = [ids[i] for i in self.order]
        self.docs = [(texts[i] or "").encode().split() for i in self.order]
        self.sizes = np.array([len(d) for d in self.docs], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = [w for d in self.docs for w in d]
        hashed = {w: xxhash.xxh3_64_intdigest(w) for w in set(flat)}
        n = len(flat)
        runs = {1: np.fromiter(map(hashed.__getitem__, flat), np.uint64, n)}
        length = 1
        while 2 * length <= SPAN:
            runs[2 * length] = self.joined(runs[length], runs[length], length)
            length *= 2
        whole, rest = runs[length], SPAN - length
        while rest:  # 20 = 16 + 4
            step = 1 << (rest.bit_length() - 1)
            whole, length, rest = self.joined(whole, runs[step], length, step), length + step, rest - step
        runs[SPAN] = whole
        # The others were steps on the way.
        self.n, self.runs = n, {size: runs[size] for size in {ANCHOR, *PREFIXES}}
        # Windows start where their document has SPAN words left.
        left = np.repeat(self.begins[1:], self.sizes) - np.arange(n)
        self.starts = np.flatnonzero(left >= SPAN)

    @staticmethod
    def joined(a: np.ndarray, b: np.ndarray, length: int, step: int | None = None) -> np.ndarray:
        """Hash of a run of ``length`` words and the run of ``step`` words after it."""
        factor = np.uint64(pow(int(BASE), step or length, 1 << 64))
        n = max(0, len(b) - length)
        return a[:n] * factor + b[length:length + n]

    def windows(self) -> np.ndarray:
        return self.runs[SPAN][self.starts]

    def anchors(self) -> np.ndarray:
        """The smallest hash of ``ANCHOR`` words within each window."""
        least = mixed(self.runs[ANCHOR])
        width, reach = 1, SPAN - ANCHOR + 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[:max(0, len(least) - step)], least[step:])
            width += step
        return least[self.starts]

    def keys(self, common: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
        """For windows starting at ``at``, the hash of the shortest prefix that is not common."""
        key = mixed(self.runs[PREFIXES[0]][at])
        for shorter, longer in zip(PREFIXES, PREFIXES[1:]):
            hot = np.isin(key, common[shorter])
            key[hot] = mixed(self.runs[longer][at[hot]])
        return key


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


class Packed:
    """Documents in compressed blocks, and where in their rows id and text are."""

    def __init__(self, docs: DataFrame, block_bytes: int):
        self.rows = packing.packed(docs, block_bytes)
        self.at = docs.columns.index("doc_id"), docs.columns.index("text")


def new_values(x: np.ndarray) -> np.ndarray:
    """Where a sequence differs from the value before; neighbouring windows mostly share their anchor."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def opened(rows: pa.RecordBatch, at: tuple[int, int]) -> Block:
    return Block(*(rows.column(i).to_pylist() for i in at))


def each_block(blocks: DataFrame, at: tuple[int, int], work, schema: str, *columns: str) -> DataFrame:
    """``work(block number, Block, further columns)`` gives arrays."""
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(number, batch, *rest):
        arrays = work(number, opened(batch, at), *rest)
        for first in range(0, len(arrays[0]), 100_000):
            yield pa.RecordBatch.from_arrays([a[first:first + 100_000] for a in arrays], names)

    return packing.each(blocks, rows, schema, *columns)


def surveyed(packed: Packed) -> DataFrame:
    """A row per block: the prefixes frequent in it, and its anchors. Both come from one opening of the block.

    A prefix with more than ``SHARE`` of all windows has half of it in some block, so blocks
    name those only, and under length 0 how many windows they have.
    """
    names, at = ["lengths", "keys", "counts", "anchors"], packed.at

    def survey(number, rows):
        block = opened(rows, at)
        lengths, keys, counts = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)], [np.array([len(block.starts)])]
        for length in PREFIXES[:-1]:
            values, least = mixed(block.runs[length][block.starts]), len(block.starts) * SHARE / 2
            # Only values of full enough cells can be frequent ones.
            cells = (values & np.uint64(0xFFFF)).astype(np.int64)
            found, n = np.unique(values[(np.bincount(cells, minlength=1 << 16) > least)[cells]], return_counts=True)
            much = n > least
            lengths.append(np.full(much.sum(), length))
            keys.append(found[much])
            counts.append(n[much])
        anchors = block.anchors()
        anchors = np.unique(anchors[new_values(anchors)])
        columns = [np.concatenate(lengths), np.concatenate(keys).view(np.int64), np.concatenate(counts), anchors.view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(
            pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, pa.int64())) for c in columns)], ["block", *names])

    schema = ", ".join(["block long", *(f"{name} array<long>" for name in names)])
    return materialised(packing.each(packed.rows, survey, schema), "survey")


def common_prefixes(survey: DataFrame) -> dict[int, np.ndarray]:
    """Hashes of prefixes with more than ``SHARE`` of all windows, by length; at most 1/SHARE each."""
    named = survey.select(F.explode(F.arrays_zip("lengths", "keys", "counts")).alias("x"))
    counted = named.groupBy(F.col("x.lengths").alias("length"), F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("n"))
    counted = materialised(counted, "prefixes")
    every = counted.where("length = 0").agg(F.sum("n")).first()[0] or 0
    common = {length: np.empty(0, np.uint64) for length in PREFIXES}
    for length in PREFIXES[:-1]:
        rows = counted.where((F.col("length") == length) & (F.col("n") > every * SHARE)).select("key").collect()
        common[length] = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    return common


def shared_anchors(survey: DataFrame) -> DataFrame:
    """Per block, the anchors that are in another block too; at most as many as the block has."""
    found = survey.select(F.explode("anchors").alias("anchor"), "block")
    counted = found.withColumn("n", F.count("*").over(W.partitionBy("anchor")))
    return counted.where("n > 1").groupBy("block").agg(F.collect_list("anchor").alias("anchors"))


def repeated_leaves(packed: Packed) -> DataFrame:
    """Per block, the offsets of its first windows that start earlier in another block."""
    survey = surveyed(packed)
    sent = packed.rows.sparkSession.sparkContext.broadcast(common_prefixes(survey))
    schema = "key long, window long, doc long, block long, offset long"

    def suffixes(number, block, anchors):
        found = block.anchors()
        new = new_values(found)
        shared = np.isin(found[new], np.array(anchors, np.int64).view(np.uint64))
        at = block.starts[shared[np.cumsum(new) - 1]]
        windows, first = np.unique(block.runs[SPAN][at], return_index=True)
        at = at[first]
        doc = np.searchsorted(block.begins, at, "right") - 1
        return [signed(block.keys(sent.value, at)), signed(windows), pa.array([block.ids[d] for d in doc.tolist()], pa.int64()),
                pa.array(np.full(len(at), number), pa.int64()), pa.array(at, pa.int64())]

    leaves = each_block(packed.rows.join(shared_anchors(survey), "block"), packed.at, suffixes, schema, "anchors")
    # One exchange by prefix; below it, a sort puts the leaves of each node together.
    node = W.partitionBy("key", "window").orderBy(F.col("doc").asc_nulls_first(), "block", "offset")
    grouped = leaves.repartition("key").withColumn("leaf", F.row_number().over(node))
    return grouped.where("leaf > 1").groupBy("block").agg(F.collect_list("offset").alias("marks"))


def removed(docs: DataFrame, block_bytes: int = packing.BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` as they came, with three more columns: ``_kept``, the words that stay
    joined by one space, ``_n_words`` and ``_n_removed``.

    A null text has no words. Of rows with one doc_id, the order in which they are read
    decides which is earlier.
    """
    packed = Packed(docs, block_bytes)
    at, marked = packed.at, packed.rows.join(repeated_leaves(packed), "block", "left")
    added = [StructField("_kept", StringType()), StructField("_n_words", LongType()), StructField("_n_removed", LongType())]
    out = StructType([*docs.schema.fields, *added])

    def work(number, rows, marks):
        block = opened(rows, at)
        later = pd.Series(block.windows()).duplicated().to_numpy()
        hit = np.zeros(block.n + SPAN, np.int64)
        for places in (block.starts[later], np.array(marks or [], np.int64)):
            hit[places] = 1
        over = np.cumsum(hit)
        covered = over.copy()
        covered[SPAN:] -= over[:-SPAN]
        stays = covered == 0
        gone = np.concatenate([[0], np.cumsum(~stays)])
        touched = (gone[block.begins[1:]] > gone[block.begins[:-1]]).tolist()
        ordered = rows.take(pa.array(block.order))
        for first in range(0, len(block.docs), 1000):
            kept = [[w for w, s in zip(doc, stays[begin:begin + len(doc)].tolist()) if s] if cut else doc for doc, begin, cut in
                    zip(block.docs[first:first + 1000], block.begins[first:first + 1000].tolist(), touched[first:first + 1000])]
            sizes = block.sizes[first:first + 1000]
            yield pa.RecordBatch.from_arrays(
                [*ordered.slice(first, 1000).columns, pa.array([b" ".join(k).decode() for k in kept], pa.string()),
                 pa.array(sizes), pa.array(sizes - np.array([len(k) for k in kept], np.int64))], [f.name for f in out])

    return packing.each(marked, work, out, "marks")


def deduplicated(docs: DataFrame, block_bytes: int = packing.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every document."""
    return removed(docs.select("doc_id", "text"), block_bytes).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("text"))
