"""Byte-level BPE of whole batches of text, word by word, with the ids of frequent words kept.

The pattern of these tokenizers never joins white space to what stands before it, and joins at
most one space to what follows. So a text can be cut, and its pieces encoded one by one, at these
places: before a run of white space, before the last character of a run that is followed by
something else, after that character unless it is a space, and, where the pattern is known to
split there, between an ASCII letter and an ASCII character that is neither letter nor white space.

All of it works on the UTF-8 bytes of a batch at once: places to cut come from byte classes,
words are looked up by a rolling hash in an open-addressed table, and the ids of all words are
gathered in one step. Hashes only find candidates: the words found are laid end to end and must
equal the text, else the batch is encoded without the table.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

LONGEST = 64  # Longer words are encoded, not kept.
STEP = 1 << 20
KEPT = 1 << 19
TOGETHER = 1000
LAST_LATIN = "\u024f"  # Up to here a letter is one for every version of Unicode in use.
OTHER, LETTER, SPACE, WHITE, MARK = range(5)
BASE = 0x9E3779B97F4A7C15

CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[:128] = MARK
CLASSES[[*range(65, 91), *range(97, 123)]] = LETTER
CLASSES[9:14] = WHITE
CLASSES[32] = SPACE
# First bytes of white space beyond ASCII, and what follows them (fixed values: the property White_Space).
WIDE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE3: [b"\x80\x80"],
        0xE2: [b"\x80" + bytes([b]) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"\x81\x9f"]}


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next from U+0100 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printing else next(others)) for b in range(256)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


FORTH = _powers(BASE, STEP + LONGEST + 1)
BACK = _powers(pow(BASE, -1, 1 << 64), STEP + LONGEST + 1)


def cuts(data: np.ndarray, bounds: np.ndarray, marks: bool = True) -> np.ndarray:
    """Where the words of a batch begin; ``bounds`` has the texts' begins and the end of the last.

    Without ``marks`` texts are cut at white space only.
    """
    n = len(data)
    kind = CLASSES[data]
    white = (kind == SPACE) | (kind == WHITE)
    begins = np.zeros(n + 1, bool)
    lasts = white.copy()  # first byte of a white character, if that is its only one
    wide = []
    for lead, tails in WIDE.items():
        at = np.flatnonzero(data == lead)
        for tail in tails if len(at) else []:
            hit = at[at + len(tail) < n]
            for k, b in enumerate(tail):
                hit = hit[data[hit + 1 + k] == b]
            for k in range(len(tail) + 1):
                white[hit + k] = True
            wide.append((hit, len(tail) + 1))
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    after = np.append(white[1:], True) | edge[1:]  # no cut in white space that ends a text
    begins[:n] = white
    begins[1:n] &= ~white[:-1]
    begins[:n] |= lasts & ~after
    plain_space = kind == SPACE
    begins[1:n] |= ~white[1:] & white[:-1] & ~plain_space[:-1]
    if marks:
        begins[1:n] |= (kind[1:] == MARK) & (kind[:-1] == LETTER)
    for hit, size in wide:
        end = hit + size
        ends = np.where(end < n, white[np.minimum(end, n - 1)], True) | edge[end]
        begins[hit[~ends]] = True
    begins[bounds[:-1]] = True
    begins[n] = False
    return np.flatnonzero(begins[:n])


def gathered(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that start at ``begins``, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]


class Pool:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(len(self.data) // 2, len(values)), self.data.dtype)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, at):
        return self.data[:self.n][at]


class Words:
    """Ids of words, found by hash; of words that don't fit any more the frequent half stays."""

    def __init__(self, width: int):
        self.dtype = f"<u{width}"
        self.slots = np.full(4 * KEPT, -1, np.int32)
        self.keys, self.counts = Pool(np.uint64), Pool(np.int32)
        self.bytes, self.ids = Pool(np.uint8), Pool(self.dtype)
        self.at = {name: Pool(np.int32) for name in ("byte", "bytes", "id", "ids")}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``, -1 for those that aren't kept."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        slot = (keys >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)
        while len(open_):
            place = self.slots[slot]
            held = place >= 0
            open_, slot, place = open_[held], slot[held], place[held]
            same = self.keys.data[place] == keys[open_]
            out[open_[same]] = place[same]
            open_, slot = open_[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _enter(self, keys: np.ndarray, first: int) -> None:
        places = np.arange(first, first + len(keys), dtype=np.int32)
        slot = (keys >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)
        while len(places):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = places[free]
            lost = self.slots[slot] != places
            places, slot = places[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, words: list[bytes], ids: list[list[int]]) -> None:
        """Enters words with distinct keys that aren't kept yet."""
        if self.keys.n + len(keys) > KEPT:
            self._halve()
        first = self.keys.n
        for name, pool, values in (("byte", self.bytes, words), ("id", self.ids, ids)):
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            self.at[name].add(pool.n + np.cumsum(sizes) - sizes)
            self.at[name + "s"].add(sizes)
        self.bytes.add(np.frombuffer(b"".join(words), np.uint8))
        self.ids.add(np.array([i for x in ids for i in x], self.dtype))
        self.keys.add(keys)
        self.counts.add(np.zeros(len(keys), np.int64))
        self._enter(keys, first)

    def _halve(self) -> None:
        n = self.keys.n
        stay = np.sort(np.argpartition(self.counts[:], n // 2)[n // 2:])
        old, old_at = (self.keys[stay], self.counts[stay] // 2), {k: p[stay] for k, p in self.at.items()}
        raw, ids = (gathered(p.data, old_at[k], old_at[k + "s"]) for k, p in (("byte", self.bytes), ("id", self.ids)))
        self.__init__(self.ids.data.dtype.itemsize)
        for name in ("byte", "id"):
            sizes = old_at[name + "s"]
            self.at[name].add(np.cumsum(sizes) - sizes)
            self.at[name + "s"].add(sizes)
        self.bytes.add(raw)
        self.ids.add(ids)
        self.keys.add(old[0])
        self.counts.add(old[1])
        self._enter(old[0], 0)


class Encoder:
    """Ids of texts from the ids of words; ``width`` is the bytes an id needs, 2 or 4."""

    marks = False

    def __init__(self, vocabulary: int):
        self.width = 2 if vocabulary <= 1 << 16 else 4
        self.words = Words(self.width)

    def encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the words."""
        raise NotImplementedError

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more entry for the end). Null is empty."""
        raw = [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not len(data):
            return np.empty(0, self.words.dtype), np.zeros(len(raw) + 1, np.int64)
        # Empty texts begin no word.
        begins = cuts(data, np.append(bounds[:-1][sizes > 0], len(data)), self.marks)
        ends = np.append(begins[1:], len(data))
        parts, counts, at = [], [], 0
        while at < len(begins):
            to = max(at + 1, int(np.searchsorted(ends, begins[at] + STEP, "right")))
            ids, n = self._step(data, begins[at:to], ends[at:to])
            parts.append(ids)
            counts.append(n)
            at = to
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(parts), upto[np.searchsorted(begins, bounds)]

    def _step(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring words, and how many each has."""
        zero, sizes = begins[0], ends - begins
        if sizes[0] > LONGEST and len(sizes) == 1:
            return self._plain(data, begins, ends)
        part = data[zero:ends[-1]]
        upto = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * FORTH[:len(part)], out=upto[1:])
        keys = (upto[ends - zero] - upto[begins - zero]) * BACK[begins - zero]
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(29)
        short = sizes <= LONGEST
        places = self.words.find(keys)
        new = np.flatnonzero((places < 0) & short)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if len(fresh) > KEPT // 2:  # too many for the table at once
                return self._plain(data, begins, ends)
            if self.words.keys.n + len(fresh) > KEPT:  # what was found may go
                self.words._halve()
                places = self.words.find(keys)
                new = np.flatnonzero((places < 0) & short)
                fresh, first = np.unique(keys[new], return_index=True)
                if len(fresh) > KEPT // 2:
                    return self._plain(data, begins, ends)
            at = new[first]
            raw = part.tobytes()
            words = [raw[b:e] for b, e in zip((begins[at] - zero).tolist(), (ends[at] - zero).tolist())]
            self.words.add(fresh, words, self.encoded([w.decode() for w in words]))
            places[new] = self.words.find(keys[new])
        long = np.flatnonzero(~short)
        known = np.where(short, places, 0)
        table = self.words
        n_ids, n_bytes = table.at["ids"][known], table.at["bytes"][known]
        n_bytes[long] = 0
        checked = np.repeat(short, sizes)
        if len(long) == len(sizes) or not np.array_equal(
                gathered(table.bytes.data, table.at["byte"][known], n_bytes), part[checked] if len(long) else part):
            return self._plain(data, begins, ends)
        seen = np.bincount(known[short])
        table.counts.data[:len(seen)] += seen.astype(np.int32)
        if not len(long):
            return gathered(table.ids.data, table.at["id"][known], n_ids), n_ids
        # Long words stand between runs of short ones.
        out, counts, at = [], n_ids, 0
        whole = self.encoded([part[begins[i] - zero:ends[i] - zero].tobytes().decode() for i in long.tolist()])
        for i, ids in zip([*long.tolist(), len(sizes)], [*whole, []]):
            out.append(gathered(table.ids.data, table.at["id"][known[at:i]], n_ids[at:i]))
            out.append(np.array(ids, table.dtype))
            if i < len(sizes):
                counts[i] = len(ids)
            at = i + 1
        return np.concatenate(out), counts

    def _plain(self, data, begins, ends) -> tuple[np.ndarray, np.ndarray]:
        found = self.encoded([data[b:e].tobytes().decode() for b, e in zip(begins.tolist(), ends.tolist())])
        return (np.array([i for ids in found for i in ids], self.words.dtype),
                np.fromiter(map(len, found), np.int64, len(found)))


class LibraryEncoder(Encoder):
    """Ids by a byte-level tokenizer in the form of the tokenizers library; special tokens' strings are ordinary text."""

    marks = True

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        super().__init__(self.tokenizer.get_vocab_size())
        described = json.loads(tokenizer_json)
        before = described.get("pre_tokenizer") or {}
        # A word of letters is one pre-token; the model can have it straight away, in the signs of its bytes.
        self.direct = described.get("normalizer") is None and before.get("type") == "ByteLevel" \
            and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.letters = dict(enumerate(byte_alphabet()))
        self.between, = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of words, none of which has a line feed beside anything else."""
        out: list = [None] * len(words)
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for i, word in enumerate(words):
            bare = word[1:] if word[0] == " " else word
            if self.direct and bare.isalpha() and (bare.isascii() or max(bare) <= LAST_LATIN):
                signs = word.encode().decode("latin-1").translate(self.letters) if not bare.isascii() else \
                    "Ġ" + bare if bare is not word else word
                out[i] = [t.id for t in tokenize(signs)]
            else:
                rest.append(i)
        blank = [i for i in rest if words[i].isspace() or "\n" in words[i]]
        for i, e in zip(blank, self.tokenizer.encode_batch_fast([words[i] for i in blank], add_special_tokens=False)):
            out[i] = e.ids
        filled = [i for i in rest if out[i] is None]
        for at in range(0, len(filled), TOGETHER):
            part = filled[at:at + TOGETHER]
            ids = self.tokenizer.encode("\n".join([words[i] for i in part]), add_special_tokens=False).ids
            begin = 0
            for i in part:
                try:
                    end = ids.index(self.between, begin)
                except ValueError:
                    end = len(ids)
                out[i] = ids[begin:end]
                begin = end + 1
        return out


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str) -> LibraryEncoder:
    """One per worker and tokenizer, so kept words last over tasks."""
    return LibraryEncoder(tokenizer_json)
