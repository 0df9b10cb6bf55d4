"""Packing documents into token windows by sums of squares.

A document's ids, with the end id after the last, are one piece where they fit the window. Only longer ones are cut: the first
piece takes what is left over of whole windows, the others are whole windows and sequences of their own. The rest is
placed piece by piece: of all residual gaps that hold the piece, and a new sequence, it goes to the one after which the sum of the
squared counts of open sequences for each gap is smallest; ties go to the smaller gap. So no gap is left often, and whatever
length comes later finds a gap that it fills.

Placing is sequential, so pieces are dealt by a hash into shards of about SHARD. Within a shard pieces of over LONG of the
window come first, longest first, as they can't be helped by later gaps; all others follow in an order by hash, as the rule
asks for arrivals in no order. A shard's emptiest open sequences, holding at most an eighth of its pieces, are taken apart
again and go to the next level, where the shards' rests meet; so each level has an eighth of the rows of the one before it, and the
last is a single shard. There nothing comes later that could fill a gap, so all pieces are placed by length, and a new sequence is
opened only where no gap holds the piece. A sequence is named by the number of its first piece's row.

Defined results: a null or empty text has the end id alone; repeated rows are packed each; an empty table gives no pieces;
other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.packing import encoder
from ragspark.llm.shared import free, portions, written

WINDOW, END = 1024, 2
#: Pieces that are placed in one task, about; the share of a window from which pieces are placed by length; the gap, as a share of
#: the window, up to which a sequence counts as full.
SHARD, LONG, FULL = 50_000, 0.4, 1 / 64


def pieces(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids): each document's ids in pieces; ids are little-endian unsigned 32-bit. Strings of
    special tokens in a text are these tokens, as in the tokenizers library by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, pattern)
        for batch in batches:
            for part in portions(batch, batch.schema.names[1]):
                rows: list[tuple] = []
                for value, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(of.encode_to_numpy(x, allowed_special="all") if x else [], end).astype("<u4")
                    cuts = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
                    rows += ((value, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
                types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[key, "piece", "start", "length", "ids"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary"
    return docs.select(key, F.col(text).alias(free("_text", [key]))).mapInArrow(run, schema)


def place(lengths: np.ndarray, window: int = WINDOW, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, in this order of arrival, and the gap that each sequence is left with. last: a
    new sequence is opened only where no gap holds a piece."""
    none = np.iinfo(np.int64).max
    open_, counts, gaps = [[] for _ in range(window + 1)], np.zeros(window + 1, np.int64), []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, size in enumerate(lengths.tolist()):
        gap, change = window, 2 * counts[window - size] + 1 if size < window else 0
        if size < window:
            # taking an open sequence from gap g to g - size changes the sum by 1 - 2 n(g) and, unless it is full then, 2 n(g - size) + 1
            has = counts[size:window]
            changes = 2 * (counts[: window - size] - has) + 2
            changes[0] = 1 - 2 * has[0]
            changes[has == 0] = none
            best = int(changes.argmin())
            if changes[best] < none and (last or changes[best] <= change):
                gap = size + best
        if gap < window:
            own = open_[gap].pop()
            counts[gap] -= 1
        else:
            own = len(gaps)
            gaps.append(window)
        sequence[k], offset[k], gaps[own] = own, window - gap, gap - size
        if gap > size:
            open_[gap - size].append(own)
            counts[gap - size] += 1
    return sequence, offset, np.array(gaps, np.int64)


def arrivals(lengths: np.ndarray, numbers: np.ndarray, window: int = WINDOW, last: bool = False) -> np.ndarray:
    """The order in which pieces are placed: long ones (in the last shard all) by length, then the others by a hash of their number."""
    with np.errstate(over="ignore"):
        mixed = (numbers.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    long = lengths > (0 if last else LONG * window)
    return np.lexsort((numbers, np.where(long, 0, mixed ^ (mixed >> np.uint64(32))), np.where(long, -lengths, 0)))


def reopened(sequence: np.ndarray, gaps: np.ndarray, most: int, window: int = WINDOW) -> np.ndarray:
    """Whether each piece lies in one of the emptiest sequences, of so many pieces in all at most."""
    held = np.bincount(sequence, minlength=len(gaps))
    emptiest = np.argsort(-gaps, kind="stable")
    taken = (np.cumsum(held[emptiest]) <= most) & (gaps[emptiest] > FULL * window)
    again = np.zeros(len(gaps), bool)
    again[emptiest[taken]] = True
    return again[sequence]


def pack(rows: DataFrame, number: str, length: str = "length", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """rows, each of a length of 1 to the window, with sequence_id and offset, without the number. number: a long column that
    no two rows share. rows is read more than once, so it should be a written table."""
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset", number)]
    group, again = (free(c, [*rows.columns, "sequence_id", "offset"]) for c in ("_shard", "_again"))
    whole = rows.filter(F.col(length) >= window).withColumns({"sequence_id": F.col(number), "offset": F.lit(0).cast("long")})
    parts, left = [whole], rows.filter(F.col(length) < window).drop("sequence_id", "offset")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in left.schema)}, sequence_id long, offset long, `{again}` boolean"
    names = left.columns

    def placing(last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            sizes, numbers = table[length].to_numpy(), table[number].to_numpy()
            order = arrivals(sizes, numbers, window, last)
            sequence, offset, gaps = place(sizes[order], window, last)
            first = np.zeros(len(gaps), np.int64)
            first[sequence[offset == 0]] = numbers[order][offset == 0]
            columns = [pa.array(first[sequence]), pa.array(offset), pa.array(reopened(sequence, gaps, shard // 8, window))]
            table = table.select(names).take(pa.array(order))
            for name, column in zip(("sequence_id", "offset", again), columns, strict=True):
                table = table.append_column(name, column)
            return table

        return run

    while True:
        shards = max(1, -(-left.count() // shard))
        dealt = left.withColumn(group, F.pmod(F.xxhash64(number), F.lit(shards)).cast("int"))
        placed = dealt.groupBy(group).applyInArrow(placing(shards == 1), schema)
        if shards == 1:
            parts.append(placed)
            break
        placed = written(placed, "placed")
        parts.append(placed.filter(~F.col(again)))
        left = placed.filter(again).select(*names)
    every = [p.select(*kept, "sequence_id", "offset") for p in parts]
    return reduce(DataFrame.unionAll, every)
