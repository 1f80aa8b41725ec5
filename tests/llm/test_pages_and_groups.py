"""Archives, page text, near-duplicates, decontamination, components and the whole pipeline."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from llm_samples import DOCS, edited, prose, rows
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import arc_to_warc, dart_minhash, queries, string_tiling, wrapper_induction
from rollcall.llm.components import components

PAGES = "page_id long, url string, html string, host string, path string, template string"


def page(title: str, body: str, menu: str = "Home", note: str = "") -> str:
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body class='has-sidebar'><nav><ul><li><a href=x>{menu}</a>"
            f"</li></ul></nav><!-- c --><div class=\"ad\">Buy {menu}</div><article><h1>{title}</h1>{body}{note}</article>"
            "<div id='comments'><p>Nice!</p></div><form><p>Name</p></form><footer>&copy; me</footer></body></html>")


@pytest.fixture(scope="session")
def pages(llm):
    made = [(1, "http://a.example/1", page("One", "<p><b>Fish &amp; chips<br><p>Second\n  one"), "h", "p", "t"),
            (2, "http://a.example/2", None, None, None, None), (3, None, "", None, None, None),
            (None, "no url at all", "<p>plain</p> tail", None, None, None),
            (4, "http://A.example/4", "<div>" * 300 + "deep" + "</div>" * 300, None, None, None),
            (5, "http://b.example/5", "<script>if (a < b) {", None, None, None)]
    big = page("Big", "<p>" + prose(1, 400) + "</p>")
    made += [(i, f"http://c.example/{i}", big, None, None, None) for i in (10, 12, 11, 12)]
    made += [(None, "http://c.example/n", big, None, None, None)]
    made += [(i, f"http://d.example/{i}", page(f"Title {i}", f"<p>{prose(i, 30)}</p>", prose(i, 2), "<p>All rights reserved by us.</p>"),
              None, None, None) for i in range(20, 30)]
    return llm.createDataFrame(made, PAGES)


def test_archives_round_trip(llm, pages):
    got = arc_to_warc.archived_and_read(pages).collect()
    source = pages.collect()
    assert len(got) == len(source)
    want = Counter((r.page_id, len((r.html or "").encode()), hashlib.sha1((r.html or "").encode()).hexdigest()) for r in source)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    big = [r for r in got if r.page_id in (10, 11, 12) or r.page_id is None and r.payload_bytes > 1000]
    assert Counter(r.record_type for r in big) == {"response": 1, "revisit": 4}
    assert {r.refers_to for r in big if r.record_type == "revisit"} == {12}
    assert {r.record_type for r in got if r not in big} == {"response"}
    assert arc_to_warc.archived_and_read(pages.limit(0)).count() == 0


def test_both_arc_versions_and_declared_lengths():
    for version in (1, 2):
        block = arc_to_warc.version_block(version, "20000101000000")
        record = arc_to_warc.arc_record(version, 7, "http://x.example/a b", "<p>é\n\nHTTP</p>", "20010203040506")
        volume = b"".join(map(arc_to_warc.member, (block, record)))
        found, = arc_to_warc.arc_records("v", volume)
        assert found["payload"].decode() == "<p>é\n\nHTTP</p>" and found["URL"] == "http://x.example/a%20b"
        assert arc_to_warc.page_of(found["head"]) == 7 and found["Archive-date"] == "20010203040506"
        warc = arc_to_warc.warc_record(found, "urn:uuid:x", None)
        assert b"WARC-Date: 2001-02-03T04:05:06Z" in warc and warc.endswith(b"</p>\r\n\r\n")
        with pytest.raises(ValueError):
            list(arc_to_warc.arc_records("v", b"".join(map(arc_to_warc.member, (block, record[:-9])))))


def test_main_text(pages):
    got = {r.page_id: r.text for r in wrapper_induction.main_texts(pages).collect()}
    assert got[1] == "One\n\nFish & chips\n\nSecond one"
    assert got[2] == got[3] == got[5] == "" and got[4] == "deep" and got[None] in ("plain\n\ntail", "Big\n\n" + prose(1, 400))
    assert got[12] == "Big\n\n" + prose(1, 400)  # copies are no evidence of a template
    assert got[25] == f"Title 25\n\n{prose(25, 30)}"  # what every page of the host has is template
    assert wrapper_induction.main_texts(pages.limit(0)).count() == 0
    assert wrapper_induction.main_texts(pages).where("n_chars <> length(text)").count() == 0


def best_matching(a, i, b, j):
    if a.paths[i] != b.paths[j]:
        return 0
    x, y = a.children[i], b.children[j]
    if not x and not y:
        return 1 + (a.hashes[i] == b.hashes[j])
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    for p in range(len(x)):
        for q in range(len(y)):
            best[p + 1, q + 1] = max(best[p, q + 1], best[p + 1, q], best[p, q] + best_matching(a, x[p], b, y[q]))
    return 1 + best[-1, -1]


def test_tree_matching_is_as_heavy_as_the_full_table():
    draw = random.Random(5)
    for _ in range(60):
        trees = [wrapper_induction.Tree("".join(
            f"<{t}>{draw.choice(['', 'x', 'y', 'z'])}<p>{draw.choice('uvw')}" for t in draw.choices(["div", "p", "ul", "section"], k=draw.randint(1, 7))))
            for _ in range(2)]
        a, b = (wrapper_induction.Skeleton(t.parent, t.paths(), t.hashes()) for t in trees)
        weight, pairs = wrapper_induction.matching(a, 0, b, 0)
        assert weight == best_matching(a, 0, b, 0)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})


def test_many_small_records_are_read_in_linear_time():
    one = b"WARC/1.0 " + bytes(300)
    data = (arc_to_warc.member(one) + arc_to_warc.member(b"")) * 16_000 + arc_to_warc.member(one * 500)
    start = time.process_time()
    got = list(arc_to_warc.members(data))
    assert len(got) == 16_001 and set(got[:-1]) == {one} and got[-1] == one * 500
    assert time.process_time() - start < 2
    with pytest.raises(ValueError):
        list(arc_to_warc.members(data[:-3]))


def test_empty_elements_of_other_names_are_not_paired():
    made = ("<div></div><ul></ul><p>x", "<ul></ul><p>x")
    a, b = (wrapper_induction.Skeleton(t.parent, t.paths(), t.hashes()) for t in map(wrapper_induction.Tree, made))
    assert wrapper_induction.matching(a, 0, b, 0)[0] == best_matching(a, 0, b, 0)


def test_very_deep_pages_are_aligned(llm):
    deep = 2500
    made = [(i, f"http://deep.example/{i}", "<div>" * deep + f"<p>Constant line</p><p>{prose(i, 20)}</p>" + "</div>" * deep) for i in range(6)]
    got = {r.page_id: r.text for r in wrapper_induction.main_texts(llm.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == {i: prose(i, 20) for i in range(6)}


def test_boilerplate_of_mostly_constant_pages_goes(llm):
    fixed = "".join(f"<p>Constant line {i}</p>" for i in range(30))
    made = [(0, "http://h.example/0", None), (1, "http://h.example/1", "<ul><li>Another layout</li></ul>")]
    made += [(i, f"http://h.example/{i}", f"<div>{fixed}<p>{prose(i, 20)}</p><p>{prose(50 + i, 20)}</p></div>") for i in range(2, 12)]
    got = {r.page_id: r.text for r in wrapper_induction.main_texts(llm.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[0] == "" and got[1] == "Another layout"
    assert all(got[i] == f"{prose(i, 20)}\n\n{prose(50 + i, 20)}" for i in range(2, 12))


def test_long_lists_are_aligned_by_equal_texts():
    constant = [f"<li>c{i}</li>" for i in range(300)]
    made = [[f"<li>{side}{i}</li>" for i in range(n)] + constant + [f"<li>{side}end</li>"] for side, n in (("a", 3), ("b", 7))]
    a, b = (wrapper_induction.Skeleton(t.parent, t.paths(), t.hashes()) for t in (wrapper_induction.Tree("<ul>" + "".join(m) + "</ul>") for m in made))
    same = [j for i, j in wrapper_induction.matching(a, 0, b, 0)[1] if b.hashes[j] and a.hashes[i] == b.hashes[j]]
    assert len(same) == 300


def test_pages_are_parsed_once(pages):
    # What is kept of a leaf comes from the files that the one parsing wrote.
    assert any("/skeletons-" in f for f in wrapper_induction.main_texts(pages).inputFiles())


@pytest.mark.parametrize("n", [60, 190, 230])
def test_matching_of_long_lists_is_the_heaviest(n):
    draw = random.Random(n)
    made = [[f"<{t}>{draw.choice('uvwxyz')}{'<br>' if t == 'p' else '<p>' + draw.choice(['u', side, 'Reply'])}</{t}>"
             for t in draw.choices(["div", "p", "section"], k=n)] for side in "ab"]
    a, b = (wrapper_induction.Skeleton(t.parent, t.paths(), t.hashes()) for t in (wrapper_induction.Tree("<ul>" + "".join(m) + "</ul>") for m in made))
    weight, pairs = wrapper_induction.matching(a, 0, b, 0)
    assert weight == best_matching(a, 0, b, 0)
    assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})


def test_truncated_and_broken_pages_are_read():
    assert wrapper_induction.kept_text(wrapper_induction.Tree("<article><p>a &lt; b &am"), set()) == "a < b &am"
    assert wrapper_induction.kept_text(wrapper_induction.Tree("<p>a < b <i>c</i>d<p title='>'>e"), set()) == "a < b cd\n\ne"
    assert wrapper_induction.kept_text(wrapper_induction.Tree("<aside>x</aside><main><p>y</p><div class='shareBar'>z</div></main>"), set()) == "y"


def classes_by_force(texts):
    shingled = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        shingled[i] = Counter([tuple(words[k:k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else [])
    label = {i: i for i in texts}
    for i, a in shingled.items():
        for j, b in shingled.items():
            both = sum((a & b).values())
            if i < j and both and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def chain(seed: int, steps: int) -> list[str]:
    """Texts of which neighbours are similar and the ends are not."""
    out = [prose(seed, 100)]
    for k in range(steps):
        out.append(edited(out[-1], 5 + 8 * k))
    return out


def test_near_duplicates_as_by_force(llm, texts):
    base = prose(50, 200)
    made = texts + chain(60, 11) + [edited(base, k) for k in range(0, 200, 4)] + [prose(70, 100) + " " + prose(80 + k, 60) for k in range(20)]
    docs = llm.createDataFrame(rows(made), DOCS)
    want = classes_by_force(dict(enumerate(made)))
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i: r.class_size for i, r in got.items()} == {i: list(want.values()).count(c) for i, c in want.items()}
    kept = dart_minhash.first_of_each(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_duplicates_of_odd_tables(docs, no_docs):
    got = dart_minhash.near_duplicates(docs)
    assert got.count() == docs.count()
    assert dart_minhash.first_of_each(docs).where("doc_id = 4").count() == 1
    assert dart_minhash.near_duplicates(no_docs).count() == 0 and dart_minhash.first_of_each(no_docs).count() == 0


def test_edits_of_one_text_are_not_all_compared(llm, monkeypatch):
    base, draw, made, compared = prose(90, 100), random.Random(3), [], dart_minhash.compared
    for _ in range(120):
        text = base
        for at in draw.sample(range(0, 100, 3), 3):
            text = edited(text, at)
        made.append(text)
    counts = []

    def spied(pairs, texts):
        counts.append(pairs.count())
        return compared(pairs, texts)

    monkeypatch.setattr(dart_minhash, "compared", spied)
    made = [base, edited(base, 50), edited(edited(base, 50), 53), *made]
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(llm.createDataFrame(rows(made), DOCS)).collect()}
    assert got == classes_by_force(dict(enumerate(made)))
    assert sum(counts[1:]) < 2 * len(made)  # beside each bucket's first node


def test_no_bound_rules_a_similar_pair_out(llm):
    base, draw = prose(91, 60).split() * 2, random.Random(4)
    texts = [[draw.choice(base[:9]) if draw.random() < 0.03 else w for w in base + base[:draw.randint(0, 9)]] for _ in range(40)]
    held = [dart_minhash.weights_of([w.encode() for w in t]) for t in (base, *texts)]
    placed = []
    for i, own in enumerate(held[1:]):
        similar, both = dart_minhash.similarity(held[0], own)
        less, more = dart_minhash.differing(held[0], own)
        size = int(own[1].sum())
        placed.append((1, bytes([i]), size, bytes([i]), 1 - similar, both, less, more, size - both))
    placed = llm.createDataFrame(placed, "bucket long, node binary, size long, label binary, far double, both long, "
                                         "less array<long>, more array<long>, rest long")
    found = {(r.a[0], r.b[0]) for r in dart_minhash.open_pairs(placed, placed, F.lit(True)).collect()}
    want = {(i, k) for i in range(40) for k in range(i) if dart_minhash.similarity(held[i + 1], held[k + 1])[0] >= 0.8}
    assert len(want) > 20 and want <= found and len(found) < 40 * 39 / 2


def test_signatures_estimate_weighted_similarity():
    a, b = [b"%d" % (i % 150) for i in range(400)], [b"%d" % (i % 150) for i in range(300)] + [b"y%d" % i for i in range(100)]
    counted = [dart_minhash.weights_of(t) for t in (a, b)]
    signature, weight = dart_minhash.signatures([a, b])
    assert weight.tolist() == [int(w.sum()) for _, w in counted]
    assert (signature > 0).all()
    assert abs((signature[0] == signature[1]).mean() - dart_minhash.similarity(*counted)[0]) < 0.15


def test_occurrences_weigh_in_full(llm):
    phrase = ["same"] * 104
    turns = [f"w{i}" for i in range(10)]
    made = [" ".join(phrase + prose(1, 6).split()), " ".join(phrase + prose(2, 6).split()),
            " ".join(turns * 4 + turns[:4]), " ".join(turns * 7 + turns[:4])]
    got = dart_minhash.near_duplicates(llm.createDataFrame(rows(made), DOCS)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_components_of_a_long_chain(llm):
    links = llm.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102}


def tiles_by_force(doc, item, least):
    free_a, free_b, out = [x >= 0 for x in doc], [True] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        free_a[i:i + n] = free_b[j:j + n] = [False] * n
        out.append((i, j, n))


def test_tiles_as_by_force():
    draw = random.Random(3)
    for _ in range(150):
        doc, item = ([draw.choice([-1, 0, 1, 2, 3]) for _ in range(draw.randint(0, 40))], [draw.randint(0, 3) for _ in range(draw.randint(1, 25))])
        got = string_tiling.tiling(np.array(doc, np.int64), np.array(item, np.int64), 3)
        want = tiles_by_force(doc, item, 3)
        assert sorted(n for *_, n in got)[-1:] == sorted(n for *_, n in want)[-1:]
        assert all(doc[a:a + n] == item[b:b + n] for a, b, n in got)


def test_rearranged_passages_are_found(llm, docs, no_docs):
    item = prose(31, 40).split()
    bench = llm.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, prose(33, 30)), (4, prose(33, 30))], "item_id long, text string")
    moved = " ".join(item[20:30] + ["between"] + item[:12])
    texts = [moved, prose(34, 50), " ".join(item).upper().replace(" ", ",  "), " ".join(item[:14]), prose(35, 20) + " " + prose(33, 30)]
    made = llm.createDataFrame(rows(texts), DOCS)
    got = {(r.doc_id, r.item_id): r for r in string_tiling.contaminated(made, bench).collect()}
    assert set(got) == {(0, 1), (2, 1), (4, 4)}
    assert got[0, 1].matched == 22 and got[0, 1].words == 40 and len(got[0, 1].tiles) == 2 and got[2, 1].coverage == 1.0
    clean = string_tiling.clean_documents(made, bench)
    assert clean.schema == made.schema and {r.doc_id for r in clean.collect()} == {1, 3}
    assert string_tiling.contaminated(no_docs, bench).count() == 0 and string_tiling.contaminated(docs, bench.limit(0)).count() == 0
    assert string_tiling.clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_pipeline_on_a_small_corpus(llm, tmp_path):
    base, item = prose(200, 80), prose(201, 30)
    passage = prose(202, 60)
    texts = [prose(300 + i, 60 + i) for i in range(60)] + [base, base, edited(base, 40), "too short", prose(203, 50) + " " + item,
             prose(204, 50) + " " + passage, prose(205, 50) + " " + passage, " ".join(w + "***" for w in prose(206, 70).split())]
    llm.createDataFrame(rows(texts), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(llm, str(tmp_path)).collect()}
    assert set(got) == {*range(61), 65, 66} and got[66] < got[65] - 60
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
