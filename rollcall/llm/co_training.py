"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other.

The text view is a logistic regression on hashed byte trigrams (square roots of their shares);
the metadata view is one on language, source and the magnitude of n_chars. Both start from
labelled documents: those ``SAMPLE`` with the smallest hash of their id, all if there are
fewer. A quarter of them, by a checksum of the id, is held out from the fits.

A round scores every document by both views in Spark. Of the texts without a label, each view
names up to ``ADDED`` per class that it is surest of, at least ``CONFIDENT``; they become
training rows of the other view. Copies of a text count once. After each round a logistic
regression on the two views' log-odds is fitted to the held-out labels, which also calibrates
the score. The round with the smallest held-out loss scores all rows.

The driver holds the vectors of the sample and of the added rows, a bounded number; all that
grows with the table stays in Spark.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import materialised

SAMPLE, HELD_OUT = 4096, 4
ROUNDS, ADDED, CONFIDENT = 3, 200, 0.9
CELLS_LOG2 = 11
CELLS = 1 << CELLS_LOG2
LANGS, SOURCES, SIZES = 64, 512, 66
PIECE = 1 << 20
RIDGE, ITERATIONS = 1e-4, 400


def text_vector(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, with two spaces around; zeros for no text."""
    counts = np.zeros(CELLS, np.int64)
    if not text:
        return counts.astype(np.float32)
    data = np.frombuffer(b"  " + text.encode() + b"  ", np.uint8)
    for at in range(0, len(data) - 2, PIECE):
        part = data[at:at + PIECE + 2].astype(np.uint32)
        codes = (part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]) * np.uint32(2654435761)
        counts += np.bincount(codes >> np.uint32(32 - CELLS_LOG2), minlength=CELLS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def metadata_cells(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """The three cells of a row that are one; null has its own language, source and magnitude."""
    hashed = lambda value, cells: 0 if value is None else 1 + crc32(value.encode()) % (cells - 1)
    size = 0 if n_chars is None else 1 + max(n_chars, 0).bit_length()
    return hashed(lang, LANGS), LANGS + hashed(source, SOURCES), LANGS + SOURCES + size


def metadata_vectors(cells: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cells), LANGS + SOURCES + SIZES), np.float32)
    out[np.arange(len(cells))[:, None], cells] = 1 / np.sqrt(3)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a logistic regression with a ridge, by accelerated gradient steps.

    Rows have a length of one at most, so with the intercept no curvature is over a half.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    ridge = np.full(x.shape[1], RIDGE)
    weights, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(ITERATIONS if len(x) else 0):
        slope = x.T @ (sigmoid(x @ ahead.astype(np.float32)) - y).astype(np.float32) / len(x) + ridge * ahead
        moved = ahead - slope / (0.5 + RIDGE)
        ahead = moved + step / (step + 3) * (moved - weights)
        weights = moved
    return weights


def combined(logits: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of both views' log-odds and intercept on the held-out labels, by Newton steps, and the mean loss.

    Without labels the log-odds are added as they are. The ridge pulls towards that sum.
    """
    start = np.array([1.0, 1.0, 0.0])
    if not len(y):
        return start, 0.0
    x = np.hstack([np.clip(logits, -30, 30), np.ones((len(y), 1))])

    def loss(w):
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + 0.5 * ((w - start) ** 2).sum())

    weights = start
    for _ in range(50):
        p = sigmoid(x @ weights)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (p - y) + (weights - start))
        length = 1.0
        while loss(weights - length * step) > loss(weights) and length > 1e-6:
            length /= 2
        weights = weights - length * step
    return weights, float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ weights)).mean())


def logits_of(batch: pa.RecordBatch, text_weights: np.ndarray, metadata_weights: np.ndarray) -> np.ndarray:
    """Both views' log-odds of the rows of a batch with text, lang, source and n_chars."""
    text, lang, source, n_chars = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
    out = np.empty((len(text), 2))
    light = text_weights[:-1].astype(np.float32)
    for i, row in enumerate(zip(lang, source, n_chars)):
        out[i] = text_vector(text[i]) @ light, metadata_weights[[*metadata_cells(*row)]].sum() / np.sqrt(3)
    return out + [text_weights[-1], metadata_weights[-1]]


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars")).withColumn(
        "digest", F.xxhash64("doc_id", F.col("text").isNull(), "text", F.col("lang").isNull(), "lang", "source", "n_chars"))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and label: what most of an id's rows say; ids without a majority are left out."""
    votes = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.avg(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("v"))
    return votes.where("v <> 0.5").select("doc_id", F.when(F.col("v") > 0.5, 1).otherwise(0).alias("label"))


def vectors(rows: DataFrame, digests: list[int]) -> dict[int, tuple[np.ndarray, tuple[int, int, int]]]:
    """Text vector and metadata cells of the rows with the given digests."""
    if not digests:
        return {}
    wanted = rows.sparkSession.createDataFrame([(d,) for d in digests], "digest long")
    found = rows.join(F.broadcast(wanted), "digest").groupBy("digest").agg(
        *[F.any_value(c).alias(c) for c in ("text", "lang", "source", "n_chars")])

    def run(batches):
        for batch in batches:
            digest, text, *metadata = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.int64()), pa.array([text_vector(t).tobytes() for t in text], pa.binary()),
                 pa.array([list(metadata_cells(*m)) for m in zip(*metadata)], pa.list_(pa.int32()))], ["digest", "vector", "cells"])

    found = found.mapInArrow(run, "digest long, vector binary, cells array<int>").collect()
    return {r.digest: (np.frombuffer(r.vector, np.float32), tuple(r.cells)) for r in found}


def surest(rows: DataFrame, known: DataFrame, models: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each view, the digests and labels of the unlabelled texts that it is surest of."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            found = logits_of(batch, *sent.value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "digest", "copy")), pa.array(found[:, 0]), pa.array(found[:, 1])],
                ["doc_id", "digest", "copy", "l0", "l1"])

    # Copies of a labelled text leave, held-out ones among them; after scoring, so that the join moves no texts.
    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    scores = rows.withColumn("copy", F.xxhash64("text")).mapInArrow(
        run, f"doc_id {kind}, digest long, copy long, l0 double, l1 double").join(
        known.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    once = scores.groupBy("copy").agg(F.min(F.struct("digest", "l0", "l1")).alias("x"), F.bool_or("labelled").alias("labelled"))
    once = materialised(once.where(F.col("labelled").isNull()).select("x.*"), "views")
    limit = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    out = []
    for view in ("l0", "l1"):
        chosen = []
        for label, sure in ((1, F.col(view)), (0, -F.col(view))):
            top = once.where(sure >= limit).orderBy(sure.desc(), "digest").limit(ADDED)
            chosen += [(r.digest, label) for r in top.select("digest").collect()]
        out.append(chosen)
    return out


def trained(rows: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the text view, of the metadata view and of their combination, of the best round.

    Which labels are held out goes by the text, so that no copy of a held-out text is fitted.
    """
    sample = known.join(rows.select("doc_id", "digest", F.xxhash64("text").alias("copy")), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct("digest", "copy")).alias("x"), F.min("label").alias("label"))
    sample = sample.select("doc_id", "x.digest", "label", (F.pmod("x.copy", F.lit(HELD_OUT)) == 0).alias("held_out"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    shown = vectors(rows, [r.digest for r in sample])
    fit = [(r.digest, r.label) for r in sample if not r.held_out]
    held = [(r.digest, r.label) for r in sample if r.held_out]

    def matrices(chosen):
        text = np.array([shown[d][0] for d, _ in chosen], np.float32).reshape(-1, CELLS)
        cells = np.array([shown[d][1] for d, _ in chosen], np.int64).reshape(-1, 3)
        return text, metadata_vectors(cells), np.array([y for _, y in chosen], np.float32)

    held_text, held_metadata, held_labels = matrices(held)
    taught: list[dict[int, int]] = [{}, {}]
    best = None
    for turn in range(ROUNDS + 1):
        text, _, y = matrices([*fit, *taught[0].items()])
        text_weights = fitted(text, y)
        _, metadata, y = matrices([*fit, *taught[1].items()])
        metadata_weights = fitted(metadata, y)
        logits = np.stack([held_text @ text_weights[:-1] + text_weights[-1], held_metadata @ metadata_weights[:-1] + metadata_weights[-1]], axis=1)
        mix, loss = combined(logits, held_labels)
        if best is None or loss < best[0]:
            best = (loss, (text_weights, metadata_weights, mix))
        if turn == ROUNDS or not fit:
            break
        by_text, by_metadata = surest(rows, known, (text_weights, metadata_weights))
        taught = [dict(by_metadata), dict(by_text)]
        shown |= vectors(rows, [d for d in {*taught[0], *taught[1]} if d not in shown])
    return best[1]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, log-odds of both views, the calibrated ``score`` and ``kept`` (at least a half).

    A null or empty text has no trigrams, so its text view is the intercept. Repeated rows come
    out repeated. Without any labels every score is a half.
    """
    rows = with_digest(docs)
    known = materialised(labelled(labels), "labels")
    models = docs.sparkSession.sparkContext.broadcast(trained(rows, known))

    def run(batches):
        text_weights, metadata_weights, mix = models.value
        for batch in batches:
            found = logits_of(batch, text_weights, metadata_weights)
            score = sigmoid(np.clip(found, -30, 30) @ mix[:2] + mix[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(score), pa.array(score >= 0.5)],
                ["doc_id", "text_view", "metadata_view", "score", "kept"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return rows.drop("digest").mapInArrow(
        run, f"doc_id {kind}, text_view double, metadata_view double, score double, kept boolean")
