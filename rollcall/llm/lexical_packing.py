"""Training sequences filled with lexically related documents, by retrieval from a sharded BM25 index.

1. Every text becomes ids and an end id. Whole windows of a long document are sequences as they
   are; what is left of it, less than a window, is its remainder. A document shorter than a
   window is a remainder as a whole.
2. The terms of a remainder are its distinct token ids without the end id. Document frequencies
   and the mean length cover all remainders; the table is as long as the vocabulary.
3. Shards: a remainder goes to the term that weighs most in it. Terms that many remainders could
   go to are split by a hash of the row into as many groups as would fill shards, so a group
   of copies, or one common word, never makes a large shard. A shard is up to ``SHARD`` remainders
   that follow one another in the order of these groups.
4. A task takes its shards one after the other. For each it builds an inverted index (postings
   by term, BM25 weights as values). A window begins with a seed: what the window before had no
   room for, else the first unused remainder. The seed's terms look up the index; unused
   neighbours are appended, the best score first (ties, and those without a term in common, in
   the shard's order), until the window is full. The one that reaches over the edge is cut, and
   its rest is the next seed.
5. A task's last window is cut into sequences whose lengths are powers of two, which need no
   padding. So nothing is padded at all.

A null or empty text is the end id alone. Repeated rows are documents of their own; their order
among each other doesn't show. An empty table gives no pieces. The strings of special tokens in
a text are ordinary text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import shared_folder
from rollcall.llm.words import encoder

WINDOW = 2048
# Remainders in a shard: bounds what a task holds, and which neighbours a seed can meet.
SHARD = 1024
# Terms that one in so many remainders of a shard has are rows of a table.
DENSE = 8
K1, B = 1.2, 0.75
WHOLE, REST, TERMS = "whole", "rest", "terms"
ENCODED = "kind string, doc_id long, doc_tokens long, start long, sequence_id long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
ROUTED = "doc_id long, doc_tokens long, start long, ids binary, term int, part int, draw long"
# Sequence ids: which step made it, its task, a number within the task.
STEP_BITS, TASK_BITS = 61, 32


def _encode(docs: DataFrame, tokenizer_json, end_id: int, window: int, folder: str) -> None:
    """Whole windows, remainders, and per task the document frequencies of its remainders."""

    def run(batches):
        encode = encoder(tokenizer_json.value)
        task, made = TaskContext.get().partitionId(), 0
        found, n_rest, tokens = np.zeros(encode.tokenizer.get_vocab_size() + 2, np.int64), 0, 0
        kinds = [f.type for f in schema]
        for batch in batches:
            ids, at = encode(batch.column(1))
            rows, rests = [], []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[at[i]:at[i + 1]], ids.dtype.type(end_id))
                whole = len(own) // window * window
                for start in range(0, whole, window):
                    made += 1
                    rows.append((WHOLE, doc, len(own), start, task << TASK_BITS | made, own[start:start + window].tobytes()))
                if whole < len(own):
                    rest = own[whole:]
                    rows.append((REST, doc, len(own), whole, None, rest.tobytes()))
                    rests.append(rest)
            if rests:
                terms = distinct(rests)[0]
                found[:-2] += np.bincount(terms, minlength=len(found) - 2)
                n_rest, tokens = n_rest + len(rests), tokens + sum(map(len, rests))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
        found[-2:] = n_rest, tokens
        yield pa.RecordBatch.from_pylist([{"kind": TERMS, "ids": found.tobytes()}], schema)

    schema = pa.schema([("kind", pa.string()), *((c, pa.int64()) for c in ("doc_id", "doc_tokens", "start", "sequence_id")),
                        ("ids", pa.binary())])
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED).write.partitionBy("kind").parquet(folder)


def _kind(spark, folder: str, kind: str) -> DataFrame:
    """One kind of what :func:`_encode` wrote; none of it is no folder of its own."""
    return spark.read.schema(ENCODED).parquet(folder).where(F.col("kind") == kind).drop("kind")


def _statistics(terms: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency by id, remainders and their tokens in all: as many numbers as the vocabulary has ids."""

    def add(batches):
        total = 0
        for batch in batches:
            for raw in batch.column(0):
                total = total + np.frombuffer(raw.as_buffer(), np.int64)
        if not isinstance(total, int):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(at >= len(total) - 2, at - len(total), at), pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = terms.select("ids").mapInArrow(add, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(rows["id"].tolist(), rows["n"].tolist()))
    found = np.zeros(max(counts, default=0) + 1, np.int64)
    for i, n in counts.items():
        if i >= 0:
            found[i] = n
    return found, counts.get(-2, 0), counts.get(-1, 0)


def inverse_frequency(found: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - found + 0.5) / (found + 0.5))


def distinct(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each remainder in rising order, the remainder's number, and how often it has the id."""
    owner = np.repeat(np.arange(len(rests), dtype=np.int64) << 32, [len(r) for r in rests])
    keys, tf = np.unique(owner | np.concatenate(rests).astype(np.int64), return_counts=True)
    return keys & 0xFFFFFFFF, keys >> 32, tf


def term_weights(rests: list[np.ndarray], end_id: int, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of remainders and their BM25 weights in them, one remainder after the other, and where each one's begin."""
    terms, owner, tf = distinct(rests)
    inside = terms != end_id
    terms, owner, tf = terms[inside], owner[inside], tf[inside]
    length = np.fromiter(map(len, rests), np.int64, len(rests))[owner]
    weights = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    return terms, weights, np.searchsorted(owner, np.arange(len(rests) + 1))


def _routed(rest: DataFrame, width: int, end_id: int, statistics, shard: int) -> DataFrame:
    """Remainders with the group they go to."""

    def run(batches):
        found, n, tokens = statistics.value
        idf, mean = inverse_frequency(found, n), tokens / max(n, 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, parts = [], []
            held, weights, at = term_weights([np.frombuffer(x.as_buffer(), f"<u{width}") for x in batch.column("ids")], end_id, idf, mean)
            for a, b, draw in zip(at.tolist(), at[1:].tolist(), batch.column("draw").to_pylist()):
                term = int(held[a + np.argmax(weights[a:b])]) if a < b else -1
                terms.append(term)
                parts.append(draw % math.ceil((found[term] if term >= 0 else n) / shard))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "doc_tokens", "start", "ids")),
                 pa.array(terms, pa.int32()), pa.array(parts, pa.int32()), batch.column("draw")],
                ["doc_id", "doc_tokens", "start", "ids", "term", "part", "draw"])

    drawn = rest.select("doc_id", "doc_tokens", "start", "ids", F.xxhash64("doc_id", "ids").alias("draw"))
    return drawn.mapInArrow(run, ROUTED)


class Shard:
    """An inverted index over some remainders: postings by term, with weights.

    The postings of terms that a large part of the remainders have are rows of a table instead.
    """

    def __init__(self, rests: list[np.ndarray], end_id: int, idf: np.ndarray, mean: float):
        flat, weights, at = term_weights(rests, end_id, idf, mean)
        self.n = len(rests)
        self.terms, docs = np.split(flat, at[1:-1]), np.repeat(np.arange(self.n), np.diff(at))
        order = np.argsort(flat.astype(np.uint16) if len(idf) <= 1 << 16 else flat, kind="stable")
        flat, docs, values = flat[order], docs[order], weights[order]
        begins = np.flatnonzero(np.append(len(flat) > 0, flat[1:] != flat[:-1]))
        held, sizes = flat[begins], np.diff(np.append(begins, len(flat)))
        wide = sizes * DENSE >= self.n
        row = np.full(len(idf) + 1, -1, np.int64)  # by term: its row of the table
        row[held[wide]] = np.arange(wide.sum())
        self.row, self.table = row, np.zeros((int(wide.sum()), self.n))
        in_table = row[flat] >= 0
        self.table[row[flat[in_table]], docs[in_table]] = values[in_table]
        self.docs, self.weights = docs, values
        self.begins, self.sizes = np.zeros((2, len(idf) + 1), np.int64)
        self.begins[held[~wide]], self.sizes[held[~wide]] = begins[~wide], sizes[~wide]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every remainder for a query of distinct terms."""
        row, sizes = self.row[terms], self.sizes[terms]
        out = self.table[row[row >= 0]].sum(0)
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1]:
            at = np.repeat(self.begins[terms] - ends + sizes, sizes) + np.arange(ends[-1])
            out += np.bincount(self.docs[at], self.weights[at], self.n)
        return out


class Windows:
    """Fills windows, shard after shard; a piece is (doc_id, start, doc_tokens, sequence, offset, ids)."""

    def __init__(self, window: int, end_id: int, idf: np.ndarray, mean: float, first_id: int):
        self.window, self.end_id, self.idf, self.mean, self.sequence = window, end_id, idf, mean, first_id
        self.held: list[tuple] = []  # of the window that isn't full yet: doc_id, start, doc_tokens, ids
        self.room = window

    def _put(self, doc, start, total, ids: np.ndarray, out: list) -> np.ndarray:
        """Appends to the window what fits; gives what doesn't."""
        fits = ids[:self.room]
        self.held.append((doc, start, total, fits))
        self.room -= len(fits)
        if not self.room:
            offset = 0
            for d, s, t, x in self.held:
                out.append((d, s, t, self.sequence, offset, x))
                offset += len(x)
            self.held, self.room, self.sequence = [], self.window, self.sequence + 1
        return ids[len(fits):]

    def fill(self, rows: list[tuple]) -> list[tuple]:
        """Packs remainders (doc_id, doc_tokens, start, ids); the last window may stay open."""
        out: list[tuple] = []
        if not rows:
            return out
        index = Shard([r[3] for r in rows], self.end_id, self.idf, self.mean)
        unused, left, first = np.ones(len(rows), bool), len(rows), 0
        # The open window's first document is its seed.
        terms = term_weights([self.held[0][3]], self.end_id, self.idf, self.mean)[0] if self.held else None
        scores = None
        while left:
            if not self.held:  # a new window: the first unused remainder is the seed
                while not unused[first]:
                    first += 1
                at, scores, terms = first, None, index.terms[first]
            else:
                if scores is None:
                    scores = index.scores(terms)
                    scores[~unused] = -1
                at = int(scores.argmax())
            unused[at], left = False, left - 1
            if scores is not None:
                scores[at] = -1
            doc, total, start, ids = rows[at]
            rest = self._put(doc, start, total, ids, out)
            if len(rest):  # cut at the edge: the rest is the next seed
                self._put(doc, start + len(ids) - len(rest), total, rest, out)
                scores, terms = None, index.terms[at]
        return out

    def close(self) -> list[tuple]:
        """The open window as sequences whose lengths are powers of two, the longest first."""
        out, offset = [], 0
        size = 1 << ((self.window - self.room).bit_length() - 1) if self.held else 0
        length = self.window - self.room
        for doc, start, total, ids in self.held:
            while len(ids):
                part = ids[:size - offset]
                out.append((doc, start, total, self.sequence, offset, part))
                start, ids, offset = start + len(part), ids[len(part):], offset + len(part)
                if offset == size:
                    length -= size
                    self.sequence, offset, size = self.sequence + 1, 0, 1 << (length.bit_length() - 1) if length else 0
        self.held, self.room = [], self.window
        return out


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    doc, start, total, sequence, offset, ids = zip(*pieces)
    columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()),
               *(pa.array(c, pa.int64()) for c in (total, sequence, offset)),
               pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """All pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids
    (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "8")  # kinds of rows are written side by side, not sorted
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())
    width = encoder(tokenizer.value).width
    folder = shared_folder(spark, "encoded")
    _encode(docs, tokenizer, end_id, window, folder)
    statistics = spark.sparkContext.broadcast(_statistics(_kind(spark, folder, TERMS)))

    def whole(batches):
        for batch in batches:
            rows = [(d, s, t, q, 0, np.frombuffer(x, f"<u{width}")) for d, t, s, q, x in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield _rows(rows)

    def fill(batches):
        found, n, tokens = statistics.value
        windows = Windows(window, end_id, inverse_frequency(found, n), tokens / max(n, 1),
                          1 << STEP_BITS | TaskContext.get().partitionId() << TASK_BITS)
        held: list[tuple] = []
        for batch in batches:
            held += [(d, t, s, np.frombuffer(x, f"<u{width}")) for d, t, s, x in zip(*(c.to_pylist() for c in batch.columns))]
            while len(held) >= shard:
                pieces, held = windows.fill(held[:shard]), held[shard:]
                if pieces:
                    yield _rows(pieces)
        pieces = windows.fill(held) + windows.close()
        if pieces:
            yield _rows(pieces)

    routed = _routed(_kind(spark, folder, REST), width, end_id, statistics, shard)
    order = ["term", "part", "draw", "doc_id", "start"]
    filled = routed.repartition("term", "part").sortWithinPartitions(*order).select("doc_id", "doc_tokens", "start", "ids")
    return _kind(spark, folder, WHOLE).select("doc_id", "doc_tokens", "start", "sequence_id", "ids").mapInArrow(whole, PIECES) \
        .unionByName(filled.mapInArrow(fill, PIECES))
