"""Class-based bigram model: words to classes by exchange clustering, scores for whole texts.

The probability of a word is that of its class after the class before, times that of the word
within its class. The ``CLUSTERED`` most frequent words are put into ``CLASSES`` classes by
the exchange rule: a word moves to the class in which the likelihood of the training text is
highest. All words of one half decide at a time, from the counts of the round before; the best
round counts. All other words, unseen ones too, form one more class in which a word's share is
its count plus one. The end of a text is a token and a class of its own, and what a text's
first word follows.

Counts cover every training text. Frequent words (at most ``DICTIONARY``, none longer than
``LONGEST`` bytes) go to the scoring tasks; the counts of the others meet their texts in a
join on a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.shared import materialised

CLASSES, CLUSTERED, DICTIONARY, LONGEST = 64, 1 << 14, 1 << 17, 64
ROUNDS = 8
SMOOTH = 0.1
END = b"\n"
REST, STOP = CLASSES, CLASSES + 1
STATES = CLASSES + 2
COUNTER_WORDS, PAIRS = 300_000, 2_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, and the end; very long ones stand as their digest."""
    split = (text or "").encode().lower().split()
    if max(map(len, split), default=0) > LONGEST:
        split = [w if len(w) <= LONGEST else b" " + hashlib.sha256(w).hexdigest().encode() for w in split]
    split.append(END)
    return split


def with_fold(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``held_out``; a null id is not held out."""
    return docs.select("doc_id", "text", F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"))


def word_counts(train: DataFrame) -> DataFrame:
    def run(batches):
        def rows(counted):
            keys = list(counted)
            for at in range(0, len(keys), 50_000):
                part = keys[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([counted[k] for k in part], pa.int64())], ["word", "n"])

        counted = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counted.update(tokens(text))
                if len(counted) > COUNTER_WORDS:
                    yield from rows(counted)
                    counted = Counter()
        yield from rows(counted)

    counts = train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialised(counts.withColumn("hash", F.xxhash64("word")), "words")


def frequent(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int]:
    """Words that occur at least so often that there are no more than ``most`` of them, by frequency; and how often."""
    sizes = counts.where(F.length("word") <= LONGEST).groupBy("n").agg(F.count("*").alias("words"))
    above = W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, 0)
    least = sizes.withColumn("upto", F.sum("words").over(above)).where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    if least is None:
        return [], 1 << 62
    rows = counts.where((F.length("word") <= LONGEST) & (F.col("n") >= least)).select("word", "n").collect()
    return sorted(((bytes(w), n) for w, n in rows), key=lambda r: (-r[1], r[0])), least


def pair_counts(train: DataFrame, clustered: list[bytes]) -> DataFrame:
    """left, right and n for neighbours; number ``size`` stands for other words, ``size + 1`` for the end."""
    size = len(clustered)
    sent = train.sparkSession.sparkContext.broadcast({**{w: i for i, w in enumerate(clustered)}, END: size + 1})

    def run(batches):
        number, held, pairs = sent.value, 0, []

        def rows():
            codes = np.concatenate([c for c, _ in pairs])
            keys, at = np.unique(codes, return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in pairs])).astype(np.int64)
            for i in range(0, len(keys), 100_000):
                part = keys[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part // (size + 2), pa.int64()), pa.array(part % (size + 2), pa.int64()),
                                                  pa.array(n[i:i + 100_000])], ["left", "right", "n"])

        for batch in batches:
            flat = [size + 1]
            for text in batch.column(0).to_pylist():
                flat += map(number.get, tokens(text), repeat(size))
            line = np.array(flat, np.int64)
            pairs.append(np.unique(line[:-1] * (size + 2) + line[1:], return_counts=True))
            held += len(pairs[-1][0])
            if held > PAIRS:
                yield from rows()
                held, pairs = 0, []
        if pairs:
            yield from rows()

    counted = train.select("text").mapInArrow(run, "left long, right long, n long")
    return materialised(counted.groupBy("left", "right").agg(F.sum("n").alias("n")), "pairs")


def class_pairs(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each."""

    def run(batches):
        total = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            left, right, n = (c.to_numpy() for c in batch.columns)
            total += np.bincount(classes[left] * STATES + classes[right], n, len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["cell", "n"])

    out = np.zeros(STATES * STATES)
    for cell, n in pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[cell] = n
    return out.reshape(STATES, STATES)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def best_class(table: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, twice: float) -> int:
    """The class in which a word makes the text likeliest.

    ``before`` and ``after`` count the classes next to the word without the word itself, and
    ``twice`` how often it follows itself.
    """
    rest = table.copy()
    rest[:, own] -= before
    rest[own, :] -= after
    rest[own, own] -= twice
    np.maximum(rest, 0, out=rest)
    # Only cells next to a class that the word has beside it change.
    rows, columns = np.flatnonzero(before), np.flatnonzero(after)
    gain = (xlogx(rest[rows] + before[rows, None]) - xlogx(rest[rows])).sum(0)
    gain += (xlogx(rest[:, columns] + after[columns]) - xlogx(rest[:, columns])).sum(1)
    corner = np.diagonal(rest)
    gain += xlogx(corner + before + after + twice) - xlogx(corner + before) - xlogx(corner + after) + xlogx(corner)
    for margin, more in ((rest.sum(0), before.sum() + twice), (rest.sum(1), after.sum() + twice)):
        gain -= xlogx(margin + more) - xlogx(margin)
    return int(np.argmax(gain[:CLASSES]))


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column, as parts of its values."""
    values, offsets = column.values.to_numpy(), column.offsets.to_pylist()
    return (values[begin:end] for begin, end in pairwise(offsets))


def exchange(pairs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each clustered word (and of the two numbers after them), and the class pairs."""
    classes = np.concatenate([np.arange(size) % CLASSES, [REST, STOP]])
    sides = pairs.select(F.col("left").alias("word"), F.struct(F.lit(1).alias("side"), F.col("right").alias("other"), "n").alias("x"))
    sides = sides.unionByName(pairs.select(
        F.col("right").alias("word"), F.struct(F.lit(0).alias("side"), F.col("left").alias("other"), "n").alias("x")))
    # A word has at most two entries for each clustered word.
    near = materialised(sides.where(F.col("word") < size).groupBy("word").agg(F.collect_list("x").alias("near")).select(
        "word", "near.side", "near.other", "near.n"), "neighbours")
    best = (-np.inf, classes, None)
    for turn in range(ROUNDS + 1):
        table = class_pairs(pairs, classes)
        value = likelihood(table)
        if value > best[0]:
            best = (value, classes, table)
        if turn == ROUNDS:
            break

        def run(batches, classes=classes, table=table):
            for batch in batches:
                moved = []
                for word, side, other, n in zip(batch.column(0).to_pylist(), *map(lists, batch.columns[1:])):
                    self_pair = other == word
                    context = [np.bincount(classes[other[pick]], n[pick], STATES)
                               for pick in ((side == 0) & ~self_pair, (side == 1) & ~self_pair)]
                    moved.append((word, best_class(table, int(classes[word]), *context, n[self_pair & (side == 1)].sum())))
                if moved:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*moved)], ["word", "class"])

        classes = classes.copy()
        for word, chosen in near.where((F.col("word") + turn) % 2 == 0).mapInArrow(run, "word long, class long").collect():
            classes[word] = chosen
    return best[1], best[2]


SCORED = "row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, others array<long>"


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: its fold, counts, the unigram's and the model's log10 probability, perplexity.

    A null or empty text is the end alone. Without training texts all words are unseen.
    """
    folded = with_fold(docs)
    train = folded.where(~F.col("held_out"))
    counts = word_counts(train)
    total, distinct, ends = counts.agg(
        F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n")))).first()
    total, ends = total or 0, ends or 0
    dictionary, least = frequent(counts, DICTIONARY)
    words = [(w, n) for w, n in dictionary if w != END]
    clustered = words[:CLUSTERED]
    size = len(clustered)
    pairs = pair_counts(train, [w for w, _ in clustered])
    classes, table = exchange(pairs, size)

    within = np.bincount(classes[:size], [n for _, n in clustered], STATES) if size else np.zeros(STATES)
    rest = total - ends - int(within.sum())
    rest_words = distinct - (1 if ends else 0) - size
    rest_log = np.log10(rest + rest_words + 1.0)
    base_log = np.log10(total + distinct + 1.0)
    n_of = np.array([n for _, n in words] + [0, ends], float)  # ..., another word, the end
    at = np.concatenate([classes[:size], np.full(len(words) - size, REST), [REST, STOP]]).astype(np.int64)
    emit = np.log10(n_of + 1) - rest_log
    emit[:size] = np.log10(n_of[:size]) - np.log10(within[at[:size]])
    emit[-1] = 0.0
    base = np.log10(n_of + 1) - base_log
    follow = np.log10(table + SMOOTH) - np.log10(table.sum(1, keepdims=True) + SMOOTH * STATES)
    # Words outside the dictionary get their share from the join.
    emit[-2] = base[-2] = 0.0
    model = docs.sparkSession.sparkContext.broadcast(
        ({**{w: i for i, (w, _) in enumerate(words)}, END: len(words) + 1}, at, emit, base, follow))
    end_known = 1 if ends else 0

    def run(batches):
        number, at, emit, base, follow = model.value
        other, made, part = len(at) - 2, 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            flat, sizes, others = [other + 1], [], []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                ids = [*map(number.get, words, repeat(other))]
                others.append([xxhash.xxh64_intdigest(w, 42) for w, i in zip(words, ids) if i == other] if other in ids else [])
                flat += ids
                sizes.append(len(ids))
            ids = np.array(flat, np.int64)
            state = at[ids]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.bincount(owner, x, len(sizes)) for x in (base[ids[1:]], emit[ids[1:]] + follow[state[:-1], state[1:]])]
            missing = np.array([len(o) for o in others], np.int64)
            flat_others = np.array([h for o in others for h in o], np.uint64).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(missing)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(part + made + np.arange(len(sizes))), batch.column(0), batch.column(2), pa.array(np.array(sizes, np.int64)),
                pa.array(np.array(sizes, np.int64) - missing - (1 - end_known)), pa.array(sums[0]), pa.array(sums[1]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_others, pa.int64()))],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "others"])
            made += len(sizes)

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    part = materialised(folded.select("doc_id", "text", "held_out").mapInArrow(run, SCORED.format(kind=kind)), "scored")
    tail = counts.where((F.col("n") < least) | (F.length("word") > LONGEST)).select("hash", "n")
    found = part.select("row", F.explode("others").alias("hash")).join(tail, "hash").groupBy("row").agg(
        F.count("*").alias("found"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    missing = F.size("others")
    share = lambda log: F.coalesce(F.col("logs"), F.lit(0.0)) - missing * F.lit(float(log))
    full = part.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + share(base_log)).alias("base_score"),
        (F.col("score") + share(rest_log)).alias("score"))
    return full.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
