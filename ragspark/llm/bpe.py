"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from the ranks.

Every byte b becomes the character 256 + b, so each byte string of the rank file is a piece of one character a byte.
A piece's score is its negative rank and its id is its rank: the model merges the pair of lowest rank first, leftmost
among equals, as the rank file asks. The normaliser is the identity, and nothing is added or escaped.

Defined results: a null text counts as empty; an empty text has no ids, and decodes to no bytes; lone surrogates cannot
occur in a Spark string. Repeated rows are encoded alike, row by row. Other columns are passed through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.shared import portions

#: A space between two characters that are no white space. The split pattern always starts a new piece there, so what
#: lies between two of them has the same ids in any text.
CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")
TWO_SPACES = re.compile(r"\s\s")
#: Remembered text parts in a Python worker; beyond it the memory is emptied.
REMEMBERED = 600_000
#: Longer parts are not remembered.
LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    pieces = {int(rank): base64.b64decode(token) for token, rank in rows}
    return [pieces[i] for i in range(len(pieces))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_SHIFT)


_SHIFT = {b: 256 + b for b in range(256)}


def model_bytes(pieces: list[bytes]) -> bytes:
    """The serialised sentencepiece model of these byte strings, with the unknown piece after the last."""
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, piece in enumerate(pieces):
        body = _bytes_field(1, as_characters(piece).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _int_field(3, normal)
        out += _bytes_field(1, body)
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, unknown))
    minus_one = (1 << 64) - 1
    trainer = _int_field(3, bpe) + _int_field(4, len(pieces) + 1) + _int_field(24, 0)
    trainer += _int_field(40, len(pieces)) + b"".join(_int_field(n, minus_one) for n in (41, 42, 43))
    normaliser = _bytes_field(1, b"identity") + b"".join(_int_field(n, 0) for n in (3, 4, 5))
    return bytes(out + _bytes_field(2, trainer) + _bytes_field(3, normaliser))


class Codec:
    """Encodes texts to ids and ids to bytes. One lives in each Python worker."""

    def __init__(self, path: str, pattern: str):
        self.pieces = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.whole = {piece: rank for rank, piece in enumerate(self.pieces)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.pieces))
        self.known: dict[str, list[int]] = {}

    def _pre_tokens(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each of these pre-tokens. One that is a piece as a whole is that piece."""
        words = list(words)
        data = [word.encode() for word in words]
        ids = self.model.encode([as_characters(d) for d in data], num_threads=1)
        whole = self.whole
        return {w: [whole[d]] if len(x) > 1 and d in whole else x for w, d, x in zip(words, data, ids, strict=True)}

    def _learn(self, parts: list[str]) -> None:
        """Remembers the ids of each part, as it stands behind a space."""
        split = [self.pattern.findall(" " + part) for part in parts]
        ids = self._pre_tokens(set(chain.from_iterable(split)))
        known = self.known
        for part, words in zip(parts, split, strict=True):
            known[part] = ids[words[0]] if len(words) == 1 else [*chain.from_iterable(map(ids.__getitem__, words))]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. What is new in all of them goes to the model in one call."""
        split = [x.split(" ") if not TWO_SPACES.search(x) and x == x.strip() else CLEAN_SPACE.split(x) for x in texts]
        heads = [self.pattern.findall(parts[0]) for parts in split]
        first = self._pre_tokens(set(chain.from_iterable(heads)))
        used: set[str] = set()
        for parts in split:
            used.update(parts[1:])
        if len(self.known) + len(used) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [part for part in used if part not in known]
        self._learn(new)
        out = [
            [*chain.from_iterable(map(first.__getitem__, head)), *chain.from_iterable(map(known.__getitem__, parts[1:]))]
            for head, parts in zip(heads, split, strict=True)
        ]
        for part in new:
            if len(part) > LONGEST_REMEMBERED:
                del known[part]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the array of ids of each whole text. A column of that name is replaced."""
    kept = docs.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for batch in batches:
            for part in portions(batch, text):
                texts = [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                column = pa.array(of.encode_all(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """tokens with the bytes that each array of ids stands for. Null ids count as none."""
    kept = tokens.drop(data)
    schema = T.StructType([*kept.schema.fields, T.StructField(data, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for batch in batches:
            arrays = batch.column(batch.schema.get_field_index(ids))
            column = pa.array([of.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in arrays], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, data])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text. Ids are encoded, then decoded, batch by batch, and
    leave the task as digests only: whole lists of ids of a corpus need not pass between processes."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        shown = [str(i) for i in range(len(of.pieces))]
        for batch in batches:
            for part in portions(batch, "_text"):
                ids = of.encode_all([x or "" for x in part.column(1).to_pylist()])
                listed = [hashlib.sha256(" ".join(map(shown.__getitem__, x)).encode()).hexdigest() for x in ids]
                read = [hashlib.sha256(of.decode(x)).hexdigest() for x in ids]
                columns = [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(listed), pa.array(read)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)
