"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Every byte maps to one printable character; a vocabulary entry becomes the
piece of its mapped bytes with the negative rank as score, so sentencepiece's
best-scored merges are the lowest-ranked ones.  The model has no normalisation
(identity, no dummy prefix, no white space changes).  Nothing is trained.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .words import sized, slices, utf8

_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in set(_PLAIN)]
#: Character of each byte: itself where it is printable, else one above U+0100.
CHARACTER = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
BYTE = {c: b for b, c in CHARACTER.items()}
_TABLE = {b: ord(c) for b, c in CHARACTER.items()}
KEEP = 100_000  # cached entries of a task, of either kind
BPE, NORMAL, UNKNOWN = 2, 1, 2  # enum values of the model format


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TABLE)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model's bytes: piece i is the token of rank i; ranks run from 0 without gaps."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, _field(1, mapped(t)) + _field(2, -float(i)) + _field(3, NORMAL)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, "<no piece>") + _field(2, 0.0) + _field(3, UNKNOWN)))
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(tokens))
    normaliser = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.odd = regex.compile(r" \s|\s |\A | \Z").search
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.bytes_of = [bytes(map(BYTE.__getitem__, self.model.id_to_piece(i))) for i in range(len(ranks))]
        self.cache: dict[str, bytes] = {}  # of runs of pre-tokens
        self.words: dict[str, bytes] = {}  # of pre-tokens

    def _learn(self, new: Iterable[str]) -> dict[str, bytes]:
        """Ids of pre-tokens as little-endian 32-bit integers; a pre-token that is a token is that token."""
        out, rest = {}, []
        for t in new:
            rank = self.ranks.get(t.encode())
            if rank is None:
                rest.append(t)
            else:
                out[t] = struct.pack("<I", rank)
        for t, ids in zip(rest, self.model.encode([mapped(t.encode()) for t in rest], num_threads=1) if rest else (), strict=True):
            out[t] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _chunks(self, text: str) -> list[str]:
        """Runs of whole pre-tokens.

        A single space between two other characters always begins a pre-token,
        so most texts are cut there; others are cut by the pattern.
        """
        if "\0" in text or self.odd(text):
            return self.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; each pre-token is encoded by itself, and runs of them are cached."""
        cut = [self._chunks(t) for t in texts]
        cache = self.cache
        if len(cache) > KEEP:
            cache.clear()
        if len(self.words) > KEEP:
            self.words.clear()
        new = [(c, self.split(c)) for c in set().union(*cut).difference(cache)]
        learnt = self._learn({w for _, words in new for w in words}.difference(self.words))
        self.words.update(learnt)
        fresh = {c: b"".join([self.words[w] for w in words]) for c, words in new}
        for w in learnt:
            if len(w) > 64:
                del self.words[w]
        short = {c: v for c, v in fresh.items() if len(c) <= 64}
        cache.update(short)
        of = cache if len(short) == len(fresh) else cache | fresh
        return [np.frombuffer(b"".join(map(of.__getitem__, chunks)), "<u4") for chunks in cut]

    def forget(self) -> None:
        """Empty the caches: a worker that is kept after its task shouldn't hold them through other stages."""
        self.cache, self.words = {}, {}

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(2)
def _coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def coded(coder: ByteBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids, ids_le, decoded) of (doc_id, text) batches."""
    try:
        for batch in batches:
            texts = batch.column(1)
            _, at = utf8(texts)
            for lo, hi in slices(at):
                ids = coder.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32))),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array([coder.decode(x) for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_le", "decoded"],
                )
    finally:
        coder.forget()


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_le, decoded) of every row; no shuffle.

    ids: the encoding of the whole text, without special tokens; ids_le: the
    same as little-endian 32-bit integers; decoded: the bytes that the ids
    decode to, which are the text's.  A null text is an empty one (no ids).
    ``vocabulary`` is a rank file that every machine has at that path, or the
    name of a file that was given to ``SparkContext.addFile``.  Repeated rows
    are encoded each; other columns are not read.
    """
    from os.path import exists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from coded(_coder(vocabulary if exists(vocabulary) else SparkFiles.get(vocabulary), pattern), batches)

    return sized(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, ids_le binary, decoded binary"
    )
