"""Operators whose results a few lines of Python can repeat: tokens, records, counts, repeats, scores."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from llm_samples import DOCS, prose, rows
from tokenizers import Tokenizer

from rollcall.llm import brown_classes, byte_bpe, framed_records, quality_rules, suffix_trees
from rollcall.llm.shared import materialised_small, shared_folder

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
WORD = r"[^\x20\x09-\x0D]+"


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_model_repeats_the_merges_of_every_token():
    tokens = byte_bpe.read_ranks(RANKS)
    codec = byte_bpe.codec(byte_bpe.serialised_model(tokens), PATTERN)
    for i in range(0, len(tokens), 97):
        letters = tokens[i].decode("latin-1").translate(codec.letters)
        assert codec.pieces.encode(letters) == [i]
    assert codec.tokens == tokens


def test_ids_are_those_of_the_library(docs, no_docs):
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(RANKS))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, PATTERN), RANKS, PATTERN)
    want = [(r.doc_id, bytearray(np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()), bytearray((r.text or "").encode()))
            for r in docs.collect()]
    assert listed(got, "doc_id", "ids", "decoded") == sorted(want, key=repr)
    assert byte_bpe.encoded(no_docs, RANKS, PATTERN).count() == 0


def test_encoding_and_decoding_need_one_worker_a_task(docs, no_docs):
    """The same rows as by both functions one after the other, from one pass through Python."""
    once = byte_bpe.encoded_and_decoded(docs, RANKS, PATTERN)
    both = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, PATTERN), RANKS, PATTERN)
    passes = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert (passes(once), passes(both)) == (1, 2) and once.columns == both.columns
    assert listed(once, *once.columns) == listed(both, *both.columns)
    assert byte_bpe.encoded_and_decoded(no_docs, RANKS, PATTERN).count() == 0


def test_tables_of_groups_are_few_files(llm):
    many = llm.range(4000).repartition(40)
    got = materialised_small(many, "few")
    assert len(got.inputFiles()) <= llm.sparkContext.defaultParallelism < 40
    assert sorted(r[0] for r in got.collect()) == list(range(4000))


def test_decoder_holds_tokens_only():
    model = byte_bpe.serialised_model(byte_bpe.read_ranks(RANKS))
    codec, decoder = byte_bpe.codec(model, PATTERN), byte_bpe.decoder(model)
    ids = np.arange(0, len(codec.tokens), 7, dtype="<u4").tobytes()
    assert decoder.decode(ids) == codec.decode(ids) and vars(decoder) == {"tokens": codec.tokens}


def test_rank_file_without_gaps(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"%s 0\n%s 2\n" % (base64.b64encode(b"a"), base64.b64encode(b"b")))
    try:
        byte_bpe.read_ranks(str(path))
    except ValueError:
        return
    raise AssertionError("a gap went unseen")


def test_records_come_back_in_order(docs, no_docs):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    got = framed_records.written_and_read(docs, JSON, 2).orderBy("start").collect()
    start = 0
    for row, doc in zip(got, sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))):
        ids = library.encode(doc.text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, bytes(row.ids)) == (doc.doc_id, start, np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == docs.count()
    assert framed_records.written_and_read(no_docs, JSON, 2).count() == 0


def test_index_picks_single_records(llm, docs):
    folder = shared_folder(llm, "test")
    framed_records.write_records(docs, JSON, 2, f"{folder}/data")
    framed_records.write_index(llm, f"{folder}/data", folder)
    index = framed_records.read_index(llm, folder)
    assert listed(framed_records.read_records(llm, f"{folder}/data", index.where("doc_id in (6, 11)")), "doc_id") == [(11,), (6,)]


def test_number_of_a_file_is_not_read_from_its_uuid(llm, tmp_path):
    for part in range(3):
        frames = [framed_records.framed(framed_records.body(10 * part + k, b"\1\0\0\0" * (part + 1), 2)) + b"\n" for k in range(part + 1)]
        (tmp_path / f"part-00000-0a1b2c3d-c123-4abc-8def-c12345678901-c00{part}.txt").write_bytes(b"".join(frames))
    index_folder = shared_folder(llm, "test")
    framed_records.write_index(llm, str(tmp_path), index_folder)
    index = framed_records.read_index(llm, index_folder)
    assert listed(index.groupBy("part").count(), "part", "count") == [(0, 1), (1, 2), (2, 3)]
    got = framed_records.read_records(llm, str(tmp_path), index)
    assert listed(got, "doc_id", "start") == [(0, 0), (10, 1), (11, 3), (20, 5), (21, 8), (22, 11)]


def test_damaged_record_is_seen():
    frame = bytearray(framed_records.framed(framed_records.body(5, b"\1\0\0\0\2\0\0\0", 2)))
    assert bytes(framed_records.body_at(bytes(frame), 0)) == framed_records.body(5, b"\1\0\0\0\2\0\0\0", 2)
    frame[15] ^= 1
    try:
        framed_records.body_at(bytes(frame), 0)
    except ValueError:
        return
    raise AssertionError("damage went unseen")


def counts(text):
    words = re.findall(WORD, text or "")
    spans = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    over = {j for i in range(len(words) - 7) if spans[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(over),
            len(words) < 20 or 100 * len(over) > 30 * len(words))


def test_counts_of_quality_rules(docs, no_docs):
    got = quality_rules.quality(docs)
    want = [(r.doc_id, *counts(r.text)) for r in docs.collect()]
    assert listed(got, "doc_id", *quality_rules.STATISTICS, "base_failed") == sorted(want, key=repr)
    assert not [r for r in got.collect() if r.base_failed and r.kept]
    assert quality_rules.quality(no_docs).count() == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.schema == docs.schema and kept.count() == got.where("kept").count()
    assert quality_rules.kept_documents(no_docs).count() == 0


def test_outliers_go_and_clean_texts_stay(llm):
    clean = [prose(100 + i, 40 + i % 90) for i in range(300)]
    junk = [" ".join(w + "###" for w in prose(900 + i, 80).split()) for i in range(9)]
    got = quality_rules.quality(llm.createDataFrame(rows(clean + junk), DOCS)).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(300, 309))


def test_chi_square_limits():
    assert abs(quality_rules.chi2_limit(0.95, 4) - 9.4877) < 1e-3
    assert abs(quality_rules.chi2_below(2.0, 2) - (1 - math.exp(-1))) < 1e-12


def without_repeats(documents):
    seen, out = set(), []
    for doc_id, text in documents:
        words = re.findall(WORD, text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), kept))
    return out


def test_repeats_go_but_for_the_first(docs, no_docs):
    ordered = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    want = sorted(without_repeats([(r.doc_id, r.text) for r in ordered]), key=repr)
    for block_bytes in (1, 3000, 1 << 22):  # blocks of one document, of some, of all
        got = suffix_trees.deduplicated(docs.coalesce(1), block_bytes)
        assert listed(got, "doc_id", "n_words", "n_removed", "text") == want
    whole = suffix_trees.removed(docs)
    assert whole.columns[:-3] == docs.columns and listed(whole, *docs.columns) == listed(docs, *docs.columns)
    assert suffix_trees.deduplicated(no_docs).count() == 0


def test_blocks_are_surveyed_once(llm, docs):
    survey = suffix_trees.surveyed(suffix_trees.Packed(docs.select("doc_id", "text").coalesce(1), 3000))
    rows = survey.collect()
    assert len(rows) > 1 and {r.block for r in suffix_trees.shared_anchors(survey).collect()} <= {r.block for r in rows}
    windows = sum(max(0, len((r.text or "").encode().split()) - suffix_trees.SPAN + 1) for r in docs.collect())
    assert sum(n for r in rows for length, n in zip(r.lengths, r.counts) if length == 0) == windows
    common = suffix_trees.common_prefixes(survey)
    assert all(len(common[length]) <= 1 / suffix_trees.SHARE for length in common)


def test_common_prefixes_are_lengthened(llm):
    block = suffix_trees.Block([1], [" ".join(["a b c d e f g h"] * 5)])
    common = {4: np.unique(suffix_trees.mixed(block.runs[4])), 8: np.empty(0, np.uint64)}
    keys = block.keys(common, block.starts)
    assert (keys == suffix_trees.mixed(block.runs[8][block.starts])).all()


def tokens(text):
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + ["\n"]


def test_base_scores_and_a_better_model(llm, docs, no_docs):
    got = brown_classes.scored(docs)
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    counted = Counter(w for r in docs.collect() if not held(r) for w in tokens(r.text))
    total, distinct = sum(counted.values()), len(counted)
    want = {}
    for r in docs.collect():
        words = tokens(r.text)
        want[r.doc_id] = (held(r), len(words), sum(w in counted for w in words), total,
                          sum(math.log10((counted[w] + 1) / (total + distinct + 1)) for w in words))
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 and math.isfinite(r.score) and r.score < 0
    assert brown_classes.scored(no_docs).count() == 0


def test_words_outside_the_dictionary_are_counted_exactly(llm, docs, monkeypatch):
    whole = {r.doc_id: r for r in brown_classes.scored(docs).collect()}
    monkeypatch.setattr(brown_classes, "DICTIONARY", 40)
    monkeypatch.setattr(brown_classes, "CLUSTERED", 10)
    for r in brown_classes.scored(docs).collect():
        assert r.n_known == whole[r.doc_id].n_known and abs(r.base_score - whole[r.doc_id].base_score) < 1e-6


def test_lists_are_parts_of_the_column():
    column = pa.array([[9], [1, 2], [], [3]], pa.list_(pa.int64()))[1:]
    parts = [*brown_classes.lists(column)]
    assert [p.tolist() for p in parts] == [[1, 2], [], [3]] and all(p.base is not None for p in parts)


def test_exchange_finds_the_better_class():
    draw = np.random.default_rng(1)
    table = draw.integers(0, 50, (brown_classes.STATES, brown_classes.STATES)).astype(float)
    before, after = (draw.integers(0, 3, brown_classes.STATES).astype(float) for _ in range(2))
    table[:, 5] += before
    table[5, :] += after
    table[5, 5] += 4
    values = []
    for c in range(brown_classes.CLASSES):
        moved = table.copy()
        moved[:, 5] -= before
        moved[5, :] -= after
        moved[5, 5] -= 4
        moved[:, c] += before
        moved[c, :] += after
        moved[c, c] += 4
        values.append(brown_classes.likelihood(moved))
    assert brown_classes.best_class(table, 5, before, after, 4.0) == int(np.argmax(values))


def test_digest_of_decoded_text(docs):
    ids = byte_bpe.encoded(docs.where("doc_id = 8"), RANKS, PATTERN)
    row = byte_bpe.decoded(ids, RANKS, PATTERN).first()
    assert hashlib.sha256(row.decoded).hexdigest() == hashlib.sha256(docs.where("doc_id = 8").first().text.encode()).hexdigest()
