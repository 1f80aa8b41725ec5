"""The co-training classifier: every row scored, labels of both views used, odd tables."""

import numpy as np
from llm_samples import DOCS, prose, rows

from rollcall.llm import co_training
from rollcall.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def test_vectors():
    assert not co_training.text_vector(None).any() and not co_training.text_vector("").any()
    long = prose(1, 300_000)
    assert abs(np.linalg.norm(co_training.text_vector(long)) - 1) < 1e-4
    piece, co_training.PIECE = co_training.PIECE, 1000
    try:
        assert np.allclose(co_training.text_vector(long), text_vector_of_one_piece(long))
    finally:
        co_training.PIECE = piece
    assert co_training.metadata_cells(None, None, None) == (0, 64, 576)


def text_vector_of_one_piece(text):
    data = b"  " + text.encode() + b"  "
    counts = np.zeros(co_training.CELLS)
    for i in range(len(data) - 2):
        counts[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 21] += 1
    return np.sqrt(counts / counts.sum())


def test_fit_meets_its_optimum():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 5)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (draw.random(300) < co_training.sigmoid(4 * x[:, 0] + 1)).astype(np.float32)
    w = co_training.fitted(x, y)
    full = np.hstack([x, np.ones((300, 1))])
    assert abs(full.T @ (co_training.sigmoid(full @ w) - y) / 300 + co_training.RIDGE * w).max() < 1e-3


def test_every_row_is_scored_and_junk_goes(llm):
    texts = [" ".join(w + "###" for w in prose(i, 60).split()) if i % 4 == 0 else prose(i, 60) for i in range(400)]
    made = rows(texts) + [(None, prose(900, 50), None, None, None, None, None, None, None, None), rows([None])[0]]
    labels = [(i, int(i % 4 > 0), 0) for i in range(200)] + [(i, None, 0) for i in range(200, 210)] + [(5000, 1, 0), (None, 1, 0)]
    got = co_training.scored(llm.createDataFrame(made, DOCS), llm.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    ours = {r.doc_id: r.kept for r in got if r.doc_id}
    assert [i for i in range(1, 400) if ours[i] != (i % 4 > 0)] == []
    assert sum(r.doc_id == 0 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1


def test_copies_of_labelled_texts_are_not_taught(llm):
    texts = [prose(i % 40, 60) for i in range(160)]
    docs = co_training.with_digest(llm.createDataFrame(rows(texts), DOCS))
    known = llm.createDataFrame([(i, 1) for i in range(20)], "doc_id long, label int")
    sure = tuple(np.r_[np.zeros(n), 9.0] for n in (co_training.CELLS, co_training.LANGS + co_training.SOURCES + co_training.SIZES))
    by_text, by_metadata = co_training.surest(docs, known, sure)
    labelled = {r.digest for r in docs.where("doc_id % 40 < 20").collect()}
    taught = {d for d, _ in by_text + by_metadata}
    assert len(by_text) == len(by_metadata) == 20 and not taught & labelled


def test_labels_by_majority(llm):
    labels = llm.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 0, 0), (3, 0, 0)], LABELS)
    assert sorted(tuple(r) for r in co_training.labelled(labels).collect()) == [(1, 1), (3, 0)]


def test_tables_without_labels_or_rows(llm, docs, no_docs):
    none = llm.createDataFrame([], LABELS)
    assert {r.score for r in co_training.scored(docs, none).collect()} == {0.5}
    assert co_training.scored(docs, none).count() == docs.count()
    assert co_training.scored(no_docs, none).count() == 0


def test_query_is_registered():
    assert "op5_co_training" in QUERIES
