"""Packing documents into token windows by minimum bin slack.

A document's ids, with the end id after the last, are cut at every full window; the rest, shorter than a window, is its
last piece. A full piece is a sequence of its own. For the rest only the number of pieces of each length matters: a plan is made
from this histogram, of at most `window` lengths whatever the corpus holds. For each next group of equal sequences it takes
the longest length left and then, by subset-sum over a bitset with bounded counts, the multiset of lengths that fills the
window closest; counts are backtracked, and the multiset is used as often as the counts allow.

Pieces are ranked within their length: a row number in a part plus the sum of the parts before it, so a length that
holds a third of all pieces is dealt into parts of about RANKED rows. A piece's rank gives its sequence and offset from the plan, which is bounded by
the window and broadcast.

Defined results: a null or empty text has the end id alone; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.shared import free, portions

WINDOW = 2048
END = 1
#: Pieces of one length that are numbered in one task, about.
RANKED = 2_000


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, in the library that encodes it fastest: merges follow the ids, which are
    the ranks. The added tokens of the file are its special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
    byte = {c: b for b, c in enumerate(_byte_characters())}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def _byte_characters() -> str:
    """The character for each byte in such files: printing Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


def pieces(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """(key, start, length, doc_tokens, ids): each document's ids in pieces; ids are little-endian unsigned 32-bit.
    Strings of special tokens in a text are these tokens, as in the tokenizers library by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, pattern)
        for batch in batches:
            for part in portions(batch, batch.schema.names[1]):
                rows: list[tuple] = []
                for value, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(of.encode_to_numpy(x, allowed_special="all") if x else [], end).astype("<u4")
                    rows += ((value, at, min(window, len(ids) - at), len(ids), ids[at : at + window].tobytes()) for at in range(0, len(ids), window))
                types = [part.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[key, "start", "length", "doc_tokens", "ids"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary"
    return docs.select(key, F.col(text).alias(free("_text", [key]))).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill the room closest, within these counts. Long lengths are tried first; the search ends
    as soon as the room can be filled exactly."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, some = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            some = min(some, left)
            steps.append((reach, length, some))
            reach |= reach << some * length & mask
            left, some = left - some, some * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, some in reversed(steps):
        if not before >> at & 1:
            at -= some * length
            used[length] = used.get(length, 0) + some
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> pd.DataFrame:
    """Rows (length, first, per, sequence, offset): pieces of this length from rank `first` on lie `per` to a sequence, from
    that sequence and offset on. Ranks of a length run on to the next row's."""
    left, taken, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest({k: n for k, n in left.items() if n}, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in used.items()), 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += times * n
            left[length] -= times * n
            if not left[length]:
                del left[length]
            offset += n * length
        sequence += times
    return pd.DataFrame(sorted(rows), columns=["length", "first", "per", "sequence", "offset"], dtype="int64")


def pack(rows: DataFrame, order: tuple[str, ...], salt: str, length: str = "length", window: int = WINDOW) -> DataFrame:
    """rows, each of a length of 1 to the window, with sequence_id and offset, without the salt. order: columns by which rows of
    equal length are ranked, part by part. salt: a long column by which pieces of a common length are dealt into parts; a
    number of the row splits even rows that are the same. rows is read twice, so it should be a written table."""
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}  # one row for each length up to the window
    table = plan(counts, window)
    sent = rows.sparkSession.sparkContext.broadcast({c: table[c].to_numpy() for c in table})
    common = [F.lit(x) for k, n in counts.items() if n > RANKED for x in (k, -(-n // RANKED))]
    parts_of = F.coalesce(F.element_at(F.create_map(*common), F.col(length)), F.lit(1)) if common else F.lit(1)
    part, own, start, size, rank = (free(c, rows.columns) for c in ("_part", "_own", "_before", "_length", "_rank"))
    salted = rows.drop("sequence_id", "offset").withColumn(part, F.pmod(F.col(salt), parts_of))
    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.select(length, part).groupBy(length, part).count()
    parts = parts.select(length, part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    place_in = F.row_number().over(Window.partitionBy(length, part).orderBy(*order)) - 1
    ranked = salted.withColumn(own, place_in).join(parts, [length, part]).withColumn(rank, F.col(own) + F.col(start))
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset", salt)]
    ranked = ranked.select(*kept, F.col(length).cast("long").alias(size), F.col(rank).cast("long").alias(rank))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = sent.value
        far = 1 << 44
        starts = rule["length"] * far + rule["first"]
        for batch in batches:
            sizes, ranks = (batch.column(batch.num_columns - k).to_numpy() for k in (2, 1))
            at = np.searchsorted(starts, sizes * far + ranks, "right") - 1
            turn, slot = np.divmod(ranks - rule["first"][at], rule["per"][at])
            columns = [pa.array(rule["sequence"][at] + turn), pa.array(rule["offset"][at] + slot * sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType([*(rows.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
