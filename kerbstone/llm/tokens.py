"""Encoding of a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised straight from the vocabulary: one piece per token, its
bytes mapped to printable characters, scored by its negative rank, with the identity for a
normaliser. Texts are cut into pre-tokens, each distinct one is encoded once, and decoding maps
the pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary as base64 token and rank per line; a parameter everywhere below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers before it starts afresh.
REMEMBERED = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by rank; ranks must be 0, 1, 2, ... without a gap."""
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("the ranks of the vocabulary have gaps")
    return [ranked[i] for i in range(len(ranked))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the id after the last is its unknown piece,
    which never occurs since every byte is a token."""
    chars = byte_characters()
    if not {bytes([b]) for b in range(256)} <= {*tokens}:
        raise ValueError("the vocabulary lacks single bytes")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    body = [piece("".join(chars[b] for b in token), float(-rank), 1) for rank, token in enumerate(tokens)]
    unknown = len(tokens)
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown)
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*body, piece("<unk>", 0.0, 2), _field(2, trainer), _field(3, normaliser)])


@lru_cache(maxsize=4)
def model_bytes(path: str = VOCABULARY) -> bytes:
    return serialise_model(read_vocabulary(path))


class Encoder:
    """Texts to ids and back; one per worker process."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._cut = regex.compile(PATTERN).findall
        chars = byte_characters()
        self._to = {i: c for i, c in enumerate(chars)}
        self._from = {ord(c): i for i, c in enumerate(chars)}
        self._known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; none for an empty and for a null text."""
        cut = [self._cut(t) if t else [] for t in texts]
        if len(self._known) > REMEMBERED:
            self._known = {}
        fresh = list(set().union(*cut) - self._known.keys())
        mapped = [t.encode().decode("latin-1").translate(self._to) for t in fresh]
        self._known.update(zip(fresh, map(tuple, self._pieces.encode(mapped, out_type=int, num_threads=1)), strict=True))
        return [list(chain.from_iterable(map(self._known.__getitem__, c))) for c in cut]

    def decode(self, ids: list[int]) -> str:
        text = "".join(self._pieces.id_to_piece(i) for i in ids)
        return bytes(self._from[ord(c)] for c in text).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """This process's encoder of a model."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


#: Characters of text encoded at a time.
_BATCH_CHARS = 4_000_000


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in runs of bounded size, a long text being a run of its own."""
    column, start, size = batch.column(at), 0, 0
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if pa.types.is_string(column.type) and len(column) else np.zeros(len(column), int)
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > _BATCH_CHARS:
            yield start, column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, column.slice(start).to_pylist()


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: the ids of each text, whole and without special tokens.

    An empty and a null text have an empty list. Rows stay as they are: one out per row in.
    """
    model = documents.sparkSession.sparkContext.broadcast(model_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            for start, texts in _texts(batch, 1):
                ids = enc.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of each row."""
    model = documents.sparkSession.sparkContext.broadcast(model_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            for start, texts in _texts(batch, 2):
                n = pa.array([len(i) for i in enc.encode(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), n], names=["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, source string, n_tokens long")
