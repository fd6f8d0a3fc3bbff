"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised here, straight from a rank file: each vocabulary entry
becomes a piece whose bytes are mapped to characters, scored by its negative
rank, so that sentencepiece merges the pair of least rank first; the normaliser
is the identity.  The unknown piece comes last and thus ids are ranks.  Each
pre-token is encoded by itself; decoding maps ids back to bytes.

Nothing is trained.  The vocabulary file's path is a parameter; each Python
worker loads it once.  A text is handled in bounded runs of pre-tokens; ids and what
they decode to are remembered for pre-tokens met before.

Defined results: null text counts as empty, and an empty text has no tokens;
repeated rows give repeated rows; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A byte's character: one block of letters that no step of sentencepiece treats specially.
_CHAR = [chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto for a byte-level BPE vocabulary with ranks 0, 1, 2, ..."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = [_field(1, _field(1, "".join(map(_CHAR.__getitem__, t)).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, -float(len(tokens))) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    #: Pre-tokens longer than this are not remembered.  ``MOST`` are in each of two
    #: generations: when the young one is full it becomes the old one, and what is met
    #: again moves back, so frequent pre-tokens stay.
    LONGEST, MOST = 64, 150_000

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.bytes_of = sorted(self.ranks, key=self.ranks.__getitem__)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.split, self.all = regex.compile(pattern).finditer, regex.compile(rf"(?:{pattern})").findall
        self.known: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _learn(self, tokens: set[str]) -> dict[str, tuple[tuple[int, ...], str, bytes]]:
        """Each pre-token's ids, the ids as text, and what they decode to."""
        out, rest = {}, []
        for t in tokens:
            data = t.encode()
            rank = self.ranks.get(data)
            if rank is None:
                rest.append((t, "".join(map(_CHAR.__getitem__, data))))
            else:  # a pre-token that is an entry itself is that entry
                out[t] = (rank,)
        if rest:
            out.update(zip((t for t, _ in rest), map(tuple, self.model.encode([m for _, m in rest], num_threads=1)), strict=True))
        return {t: (ids, ",".join(map(self.text_of.__getitem__, ids)), self.decode(ids)) for t, ids in out.items()}

    def _told(self, tokens: list[list[str]]) -> list[list[tuple]]:
        """What is known of lists of pre-tokens; all that are new are encoded in one call."""
        known = self.known
        new = {t for t in set().union(*tokens) if t not in known}
        again = {t for t in new if t in self.old}
        learnt = self._learn(new - again) if len(again) < len(new) else {}
        long = {t: x for t, x in learnt.items() if len(t) > self.LONGEST}
        known.update((t, self.old[t]) for t in again)
        known.update((t, x) for t, x in learnt.items() if len(t) <= self.LONGEST)
        told = [[known[t] if t in known else long[t] for t in ts] if long else list(map(known.__getitem__, ts)) for ts in tokens]
        if len(known) > self.MOST:
            self.old, self.known = known, {}
        return told

    def _parts(self, text: str, size: int) -> Iterator[list[str]]:
        """The pre-tokens of a text, at most ``size`` at a time."""
        if len(text) <= size:
            return iter([self.all(text)] if text else [])
        found = (m.group() for m in self.split(text))
        return iter(lambda: list(islice(found, size)), [])

    def runs(self, text: str, size: int = 1 << 16) -> Iterator[list[int]]:
        """The ids of a text, ``size`` pre-tokens at a time."""
        for tokens in self._parts(text, size):
            yield list(chain.from_iterable([x[0] for x in self._told([tokens])[0]]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.runs(text)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str, size: int = 1 << 16) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by commas, SHA-256 of what they decode to."""
        return self._digest(self._told([tokens])[0] for tokens in self._parts(text, size))

    @staticmethod
    def _digest(parts: Iterable[list[tuple]]) -> tuple[int, str, str]:
        n, ids_hash, back_hash = 0, hashlib.sha256(), hashlib.sha256()
        for told in parts:
            ids = ",".join([x[1] for x in told])
            ids_hash.update(((b"," if n else b"") + ids.encode()))
            back_hash.update(b"".join([x[2] for x in told]))
            n += ids.count(",") + 1
        return n, ids_hash.hexdigest(), back_hash.hexdigest()

    def digests(self, texts: Iterable[str], size: int = 1 << 16, together: int = 1 << 20) -> Iterator[tuple[int, str, str]]:
        """``digest`` of each text; short ones are looked at ``together`` code points at a time."""
        held: list[list[str]] = []
        n = 0

        def flush() -> Iterator[tuple[int, str, str]]:
            for told in self._told(held) if held else []:
                yield self._digest([told] if told else [])

        for text in texts:
            if len(text) <= size:
                held.append(self.all(text) if text else [])
                n += len(text)
            if len(text) > size or n >= together:
                yield from flush()
                held, n = [], 0
                if len(text) > size:
                    yield self.digest(text, size)
        yield from flush()


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the tokens of each whole text."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ids = [own.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary) from doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            data = [own.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass; ids are never held for a whole text."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            n, ids, back = zip(*own.digests(t.as_py() for t in b.column(1)), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
