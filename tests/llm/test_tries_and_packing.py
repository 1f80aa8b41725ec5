"""Conversation trie, bounded clustering, words and packing against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_samples import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm import bounded_clusters, framed_records, lexical_packing, prefix_trie, words

JSON = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, pos long, size long, node string, depth long"


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


# ---- the trie

def brute_trie(turns):
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        here = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += here
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items())


def trie_rows(llm, turns):
    table = llm.createDataFrame([(*t, 1, 2, "x", 3) for t in turns], TURNS)
    got = prefix_trie.conversation_trie(table).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(tuple(r) for r in got)


def test_trie_equals_plain_version(llm):
    draw = random.Random(3)
    turns = []
    for c in [*range(40), -3, -5, 10**12]:
        for t in range(draw.choice([0, 1, 2, 3, 6, 9, 12])):
            turns.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "", None, "ü"])))
    turns += [(7, None, "system", "first"), (7, 3, "user", "again"), (7, 3, "user", "again"), (None, 1, "user", "nobody's")]
    draw.shuffle(turns)
    assert trie_rows(llm, turns) == brute_trie(turns)


def test_long_conversations_and_copies(llm):
    """A chain of 300 turns, and many conversations of one text, through small pieces of ids."""
    turns = [(5 * c, t, "user", f"turn {t}") for c in range(2) for t in range(300 - 40 * c)]
    turns += [(c, t, "user", f"turn {t}") for c in range(100, 200, 5) for t in range(3)]
    assert trie_rows(llm, turns) == brute_trie(turns)


def test_trie_of_nothing(llm):
    assert trie_rows(llm, []) == [] and trie_rows(llm, [(None, 1, "user", "x")]) == []


def test_totals_of_any_tree(llm):
    """Chains below chains, a star, a caterpillar whose spine has a leaf at every node, and a lone root."""
    draw, parents = random.Random(5), {"r": None, "alone": None}
    for i in range(70):
        parents[f"c{i}"] = f"c{i - 1}" if i else "r"
        parents[f"leaf{i}"] = f"c{i}"
        parents[f"star{i}"] = "c3"
    for i in range(150):
        parents[f"t{i}"] = f"t{draw.randrange(max(0, i - 4), i)}" if i else "r"
    kids, total = defaultdict(int), defaultdict(int)
    for node, parent in parents.items():
        kids[parent] += parent is not None
        up = node
        while up is not None:
            total[up] += len(node)
            up = parents[up]
    rows = [(n, p, kids[n], len(n)) for n, p in parents.items()]
    table = llm.createDataFrame(rows, "node string, parent string, kids long, amount long")
    assert {r["node"]: r["amount"] for r in prefix_trie.subtree_sums(table, ["amount"]).collect()} == {n: total[n] for n in parents}


# ---- clustering

VECTORS = "vec_id long, embedding array<float>, label int, x string, block long, cluster string"


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * float(e)) for e in np.array(v, np.float32)]) for i, v in rows
            if v is not None and len(v) == size and all(e is not None and math.isfinite(e) for e in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in start[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for number in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c)) for _, x in kept]
        if number < rounds:
            for c in range(len(centroids)):
                mine = [x for (_, x), o in zip(kept, own) if o == c]
                if mine:
                    centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    apart = [far(x, centroids[o]) for (_, x), o in zip(kept, own)]
    return sorted(((i, o, d, sum(e for e, p in zip(apart, own) if p == o), sum(apart),
                    hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest())
                   for (i, _), o, d in zip(kept, own, apart)), key=repr)


def test_clusters_equal_plain_version(llm, monkeypatch):
    monkeypatch.setattr(bounded_clusters, "BLOCK_ROWS", 37)
    draw = random.Random(2)
    centres = [[draw.uniform(-3, 3) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + draw.gauss(0, 0.3) for c in draw.choice(centres)]) for i in range(300)]
    rows += [(500 + i, [0.5] * 8) for i in range(40)] + [rows[3], (None, [1.0] * 8), (900, None), (901, [1.0] * 7), (902, []),
             (903, [1.0] * 7 + [None]), (904, [math.nan] * 8), (905, [math.inf] * 8), (906, [-1e30] * 8)]
    table = llm.createDataFrame([(i, v, 1, "y", 5, "z") for i, v in rows], VECTORS)
    log = []
    got = bounded_clusters.clustered(table, 9, 5, "2:", components=8, log=log).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters([r for r in rows if r[0] != 906], 9, 5, 8)
    assert log[0] == 342 and min(log[1:]) < 200  # bounds spare most exact scans once clusters settle


def test_few_and_no_vectors(llm):
    rows = [(1, [0.1] * 8), (2, [0.1] * 8), (3, [2.0] * 8)]
    table = llm.createDataFrame([(i, v, 1, "y", 5, "z") for i, v in rows], VECTORS)
    got = bounded_clusters.clustered(table, 40, 5, "2:", components=8).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, 40, 5, 8)
    assert bounded_clusters.clustered(table.where("vec_id < 0"), 40, 5, "2:", components=8).collect() == []


def test_distances_are_exact_for_large_numbers():
    x = np.array([[(1 << 26) + 1, 3], [5, -(1 << 26)]], np.int32)
    c = np.array([[0, 0], [1 << 26, 1]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
    assert bounded_clusters.squared_distances(x, c).tolist() == want


# ---- words

ODD = [" ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "'s", "'t", "a", "Zb", "é", ".", ",", "23", "x" * 70,
       "<|endoftext|>", "日本", "€", "_", "\r\n", "\x1c", "don't", "'", "ª", "²", " ", " ", "''", "\x00"]


@pytest.mark.parametrize("kept", [1 << 20, 1 << 6])
def test_words_equal_the_library(plain, monkeypatch, kept):
    monkeypatch.setattr(words, "KEPT", kept)
    draw, encode = random.Random(kept), None
    with open(JSON, encoding="utf-8") as file:
        encode = words.LibraryEncoder(file.read())
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 25))) for _ in range(2000)]
    texts += [None, "", prose(1, 400), "y" * 3000, "b c " * 3000, "\n" * 100]
    for at in range(0, len(texts), 59):
        part = texts[at:at + 59]
        ids, begins = encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [plain(t) for t in part]


def test_words_with_equal_hashes(plain, monkeypatch):
    """Where two words have one hash, the text decides."""
    monkeypatch.setattr(words, "FORTH", np.zeros_like(words.FORTH))
    with open(JSON, encoding="utf-8") as file:
        encode = words.LibraryEncoder(file.read())
    ids, begins = encode(pa.array(["one two three", "four one"]))
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [plain("one two three"), plain("four one")]


def test_words_of_latin_letters_go_to_the_model(plain):
    """Accented or not, such a word doesn't pass the whole tokenizer; its ids are those the library gives."""
    with open(JSON, encoding="utf-8") as file:
        encode = words.LibraryEncoder(file.read())
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    texts = [f"{c} b{c}d {c}{c}" for c in letters] + [" étéñß", "ºª", "x\u0251y"]
    ids, begins = encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [plain(t) for t in texts]

    def refuse(*args, **more):
        raise AssertionError("the whole tokenizer")

    encode.tokenizer = SimpleNamespace(model=encode.tokenizer.model, encode=refuse, encode_batch_fast=encode.tokenizer.encode_batch_fast)
    assert encode.encoded([" größenordnung", "éx", " plain"]) == [plain(w) for w in (" größenordnung", "éx", " plain")]


def test_how_often_kept_words_come_is_counted():
    with open(JSON, encoding="utf-8") as file:
        encode = words.LibraryEncoder(file.read())
    for _ in range(2):
        encode(pa.array(["one two two", None, "two"]))
    held = {encode.words.bytes[b:b + n].tobytes(): c for b, n, c in zip(
        encode.words.at["byte"][:], encode.words.at["bytes"][:], encode.words.counts[:])}
    assert held == {b"one": 2, b" two": 4, b"two": 2}


# ---- packing

def test_terms_of_many_remainders_at_once():
    """As one remainder after the other would give them: distinct ids, and weights by the formula."""
    draw, end = random.Random(5), 1
    for kind in (np.uint16, np.uint32):
        rests = [np.array([draw.randrange(1, 30) for _ in range(draw.randint(0, 40))] + [end], kind) for _ in range(50)]
        terms, owner, tf = lexical_packing.distinct(rests)
        assert list(zip(owner, terms, tf)) == [(i, t, n) for i, r in enumerate(rests) for t, n in zip(*np.unique(r, return_counts=True))]
        idf, mean = np.linspace(3, 1, 40), sum(map(len, rests)) / len(rests)
        terms, weights, at = lexical_packing.term_weights(rests, end, idf, mean)
        assert len(at) == len(rests) + 1 and at[-1] == len(terms) == len(weights)
        for r, a, b in zip(rests, at, at[1:]):
            want = {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(r) / mean)) for t, n in zip(*np.unique(r, return_counts=True)) if t != end}
            assert terms[a:b].tolist() == list(want) and np.allclose(weights[a:b], list(want.values()))


def check_pieces(got, texts, plain, window):
    whole = {i: plain(t) + [1] for i, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and r["doc_tokens"] == len(whole[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], len(ids), r["doc_id"]))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in by_doc.items()} == whole
    for pieces in by_sequence.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at == window or at < window and at & (at - 1) == 0
    return by_sequence


def test_packing_is_gapless_and_whole(llm, docs, no_docs, texts, plain):
    once = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for shard in (3, 2048):
        got = lexical_packing.packed(once, JSON, 1, window=64, shard=shard).collect()
        check_pieces(got, list(enumerate(texts)), plain, 64)
    repeated = lexical_packing.packed(docs, JSON, 1).agg(F.sum("length"), F.countDistinct("sequence_id", "offset"), F.count("*")).first()
    assert repeated[0] == sum(len(plain(r["text"])) + 1 for r in docs.collect()) and repeated[1] == repeated[2]
    assert lexical_packing.packed(no_docs, JSON, 1).collect() == []


def brute_fill(rests, window, end_id, found, n, mean):
    """Pieces of one shard: (document, start, length, sequence, offset), scores from the formula."""
    idf = lambda t: math.log(1 + (n - found[t] + 0.5) / (found[t] + 0.5))
    weigh = lambda ids: {t: idf(t) * ids.count(t) * 2.2 / (ids.count(t) + 1.2 * (0.25 + 0.75 * len(ids) / mean))
                         for t in set(ids) - {end_id}}
    weights, unused, out = [weigh(r) for r in rests], list(range(len(rests))), []
    sequence, filled, seed = 0, 0, None
    while unused:
        if filled == 0:
            at = seed = unused[0]
        else:
            at = max(unused, key=lambda d: (round(sum(weights[d].get(t, 0) for t in weights[seed]), 9), -d))
        unused.remove(at)
        start, left = 0, len(rests[at])
        while left:
            n_here = min(left, window - filled)
            out.append((at, start, n_here, sequence, filled))
            start, left, filled = start + n_here, left - n_here, filled + n_here
            if filled == window:
                sequence, filled = sequence + 1, 0
                if left:
                    seed = at
    return out, filled


def test_windows_take_the_best_neighbours():
    """A shard is packed as scores by the formula say; what doesn't fill a window is cut in powers of two."""
    draw, end = random.Random(11), 1
    rests = [[draw.choice(range(2, 12)) + 10 * (i % 4) for _ in range(draw.randint(1, 60))] + [end] for i in range(60)]
    found = np.zeros(64, np.int64)
    for r in rests:
        found[list(set(r))] += 1
    mean = sum(map(len, rests)) / len(rests)
    windows = lexical_packing.Windows(100, end, lexical_packing.inverse_frequency(found, len(rests)), mean, 0)
    got = [(p[0], p[1], len(p[5]), p[3], p[4]) for p in windows.fill([(i, len(r), 0, np.array(r)) for i, r in enumerate(rests)])]
    want, open_ = brute_fill(rests, 100, end, found, len(rests), mean)
    last = max(w[3] for w in want)
    assert got == [w for w in want if not open_ or w[3] < last]
    rest = windows.close()
    sizes = defaultdict(int)
    for p in rest:
        sizes[p[3]] += len(p[5])
    assert sum(sizes.values()) == open_ and all(s & (s - 1) == 0 for s in sizes.values())
    # Documents of one vocabulary mostly share windows.
    of = defaultdict(set)
    for doc, _, _, sequence, _ in got:
        of[sequence].add(doc % 4)
    assert sum(len(s) for s in of.values()) / len(of) < 2.2


def test_copies_are_split_over_shards(llm, plain):
    """A third of all rows with one text: no group of the routing is larger than a few shards."""
    same = prose(1, 30)
    rows = [(i, same if i % 3 == 0 else prose(i, 30)) for i in range(300)]
    table = llm.createDataFrame(rows, "doc_id long, text string")
    got = lexical_packing.packed(table, JSON, 1, window=256, shard=16).collect()
    check_pieces(got, rows, plain, 256)


def test_records_hold_what_the_library_gives(llm, docs, plain):
    read = framed_records.written_and_read(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), JSON, 2).collect()
    want = {r["doc_id"]: plain(r["text"]) + [2] for r in docs.collect() if r["doc_id"] is not None}
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read} == want
