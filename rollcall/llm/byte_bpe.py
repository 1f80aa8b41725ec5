"""Byte-level BPE through a sentencepiece model that is written from a rank file.

Each byte is mapped to a printable character, each token becomes a piece of such characters
with score -rank, and the normaliser is the identity; merging the best-scored pair first then
repeats the merges of the rank file. The model is about a megabyte, made on the driver and
sent to the workers, so executors need no local copy of the vocabulary. Decoding looks every
id's piece up and maps its characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from rollcall.llm.shared import give_back
from rollcall.llm.words import Encoder, byte_alphabet

# Field numbers and values of sentencepiece's public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, BPE = 1, 2, 2


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from lines of base64 and rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the id after them is <unk>, never used."""
    letters = byte_alphabet()
    pieces = [_block(PIECES, _block(1, "".join(letters[b] for b in token).encode()) + _float(2, -rank) + _number(3, NORMAL))
              for rank, token in enumerate(tokens)]
    pieces.append(_block(PIECES, _block(1, b"<unk>") + _float(2, 0.0) + _number(3, UNKNOWN)))
    trainer = _number(3, BPE) + _number(4, len(pieces)) + _number(40, len(tokens))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(TRAINER, trainer) + _block(NORMALIZER, normaliser)


class Decoder:
    """The bytes that ids stand for; it holds no more than the tokens."""

    def __init__(self, pieces: sentencepiece.SentencePieceProcessor):
        back = {letter: b for b, letter in enumerate(byte_alphabet())}
        unknown = pieces.unk_id()
        self.tokens = [bytes(map(back.__getitem__, pieces.id_to_piece(i))) for i in range(len(pieces)) if i != unknown]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Codec(Encoder, Decoder):
    """Encodes words pre-token by pre-token, and decodes ids."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        Encoder.__init__(self, len(self.pieces))
        Decoder.__init__(self, self.pieces)
        self.letters = dict(enumerate(byte_alphabet()))
        self.ranks = {token: i for i, token in enumerate(self.tokens)}
        self.pre_tokens = regex.compile(pattern).findall

    def encoded(self, words: list[str]) -> list[list[int]]:
        split = [self.pre_tokens(w) for w in words]
        distinct = list(dict.fromkeys(p for parts in split for p in parts))
        raw = [p.encode() for p in distinct]
        mapped = [r.decode("latin-1").translate(self.letters) for r in raw]
        # A whole pre-token that is in the vocabulary is one token, whether or not merges reach it.
        ids = {p: [self.ranks[r]] if r in self.ranks else found
               for p, r, found in zip(distinct, raw, self.pieces.encode(mapped, num_threads=1))}
        return [[i for p in parts for i in ids[p]] for parts in split]


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


@lru_cache(maxsize=2)
def decoder(model: bytes) -> Decoder:
    return Decoder(sentencepiece.SentencePieceProcessor(model_proto=model))


def cut_out(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    raw = ids.astype("<u4").tobytes()
    return [raw[4 * a:4 * b] for a, b in zip(at.tolist(), at[1:].tolist())]


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` of each whole text, as bytes of little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Repeated rows come out repeated; other columns are dropped.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialised_model(read_ranks(ranks_path)))

    def run(batches):
        encode = codec(model.value, pattern)
        for batch in batches:
            cut = cut_out(*encode(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], ["doc_id", "ids"])
        give_back()

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decoded(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and ``decoded``, the bytes that the ids stand for."""
    model = tokens.sparkSession.sparkContext.broadcast(serialised_model(read_ranks(ranks_path)))

    def run(batches):
        decode = decoder(model.value).decode
        for batch in batches:
            text = pa.array([decode(ids) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["doc_id", "ids", "decoded"])
        give_back()

    kind = tokens.select("doc_id").schema[0].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def encoded_and_decoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What :func:`decoded` gives of :func:`encoded`, by one worker a task instead of two beside each other."""
    model = docs.sparkSession.sparkContext.broadcast(serialised_model(read_ranks(ranks_path)))

    def run(batches):
        both = codec(model.value, pattern)
        for batch in batches:
            cut = cut_out(*both(batch.column(1)))
            text = pa.array([both.decode(ids) for ids in cut], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary()), text], ["doc_id", "ids", "decoded"])
        give_back()

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
