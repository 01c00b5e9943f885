"""Token ids of a public byte-level BPE, by a sentencepiece model written from its vocabulary.

The model is serialised here, not trained: every vocabulary entry becomes a
piece whose bytes are mapped to printable characters, with score ``-rank``, so
that sentencepiece merges in rank order; normalisation is the identity.  Texts
are cut into pre-tokens by the vocabulary's pattern, each pre-token is encoded
once per worker and remembered, and ids are decoded by the inverse byte map.

Null and empty texts have no ids (an empty list) and no tokens.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO = 400_000

# Fixed value: the vocabulary's pre-token pattern, as published.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY = regex.compile(PATTERN)
# the same for texts of ASCII characters alone, where the standard library's engine does and takes less than half the time
_ASCII = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)


def _printable() -> dict[int, str]:
    """Printable latin-1 characters stand for themselves, the other bytes follow from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_TO_CHAR = _printable()
_TO_BYTE = {c: b for b, c in _TO_CHAR.items()}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(vocabulary: bytes) -> bytes:
    """A sentencepiece BPE model from rank lines ``base64 rank``; piece ids are the ranks, the unknown piece comes last."""
    ranks = {base64.b64decode(a): int(r) for a, r in (line.split() for line in vocabulary.splitlines() if line)}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = ["".join(_TO_CHAR[x] for x in b) for b, _ in sorted(ranks.items(), key=lambda x: x[1])]
    unknown = "<unk>"
    while unknown in set(pieces):
        unknown += ">"
    out = [_field(1, _field(1, p.encode()) + _field(2, -float(i)) + _field(3, 1)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2)))
    size = len(pieces) + 1
    trainer = _field(3, 2) + _field(4, size) + _field(40, size - 1) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class _Memo(dict):
    """Pre-token -> what ``make`` gives; forgets everything when full, so memory is bounded."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = self.make(word)
        return got


class Tokenizer:
    """Encodes, counts and decodes with one vocabulary, given as the bytes of its rank file."""

    def __init__(self, vocabulary: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(vocabulary))
        self.ids_of = _Memo(self._encode)
        self.count_of = _Memo(lambda w: len(self._encode(w)))
        self.piece_of = _Memo(lambda i: bytes(_TO_BYTE[c] for c in self.model.id_to_piece(i)))

    def _encode(self, word: str) -> tuple[int, ...]:
        return tuple(self.model.encode(word.encode().decode("latin-1").translate(_TO_CHAR)))

    @staticmethod
    def words(text: str) -> list[str]:
        """The pre-tokens of ``text``; joined they give it back."""
        return (_ASCII if text.isascii() else _ANY).findall(text)

    def encode(self, text: str | None) -> list[int]:
        """Token ids; empty for null and empty texts."""
        return list(chain.from_iterable(map(self.ids_of.__getitem__, self.words(text)))) if text else []

    def count(self, text: str | None) -> int:
        """Number of tokens; 0 for null and empty texts."""
        return sum(map(self.count_of.__getitem__, self.words(text))) if text else 0

    def bytes_of(self, ids) -> list[bytes]:
        """The bytes of each id."""
        return [self.piece_of[int(i)] for i in ids]

    def decode(self, ids) -> str:
        """The text of ids that encode one."""
        return b"".join(self.bytes_of(ids)).decode()


_loaded: dict[int, Tokenizer] = {}


def load(vocabulary: bytes) -> Tokenizer:
    """One tokenizer per worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _loaded:
        _loaded[key] = Tokenizer(vocabulary)
    return _loaded[key]


def shared(df: DataFrame, path: str = VOCABULARY):
    """The vocabulary file (about 1 MB, whatever the corpus) read once by the driver and broadcast."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) for every row of ``docs``, repeated rows included; one pass, no shuffle."""
    vocabulary = shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = load(vocabulary.value).ids_of.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                per_word = [[ids_of(w) for w in Tokenizer.words(t)] if t else () for t in part.column(1).to_pylist()]
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(per_word)), np.int32)
                sizes = np.fromiter((sum(map(len, x)) for x in per_word), np.int32, len(per_word))
                ids = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), np.cumsum(sizes, dtype=np.int32)]), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", *, path: str = VOCABULARY) -> DataFrame:
    """(key, text) of rows of ids that encode texts; an empty or null list gives the empty text."""
    vocabulary = shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(vocabulary.value).decode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([decode(i) if i else "" for i in part.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def count_tokens(docs: DataFrame, *keep: str, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row; texts stay in their task."""
    vocabulary = shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(vocabulary.value).count
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{schema}, n_tokens bigint")
