"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a Bloom filter over its terms, each with the levels of its occurrences that it reaches (LEVELS). Documents of
a size class lie side by side in blocks, and a block is stored by slices: for each bit of the signatures a bitmap over its
documents. Where a term's slices are all set a document may hold it at that level, so bitmaps overestimate presence and
occurrences, never the other way round. For each item the weights of its terms, times the greatest part that the level
allows in a document of this length, are summed over the bitmaps: an upper bound of every document's score.

A search first scores the documents of the k highest bounds of each item exactly, which gives the item's k-th best score so far.
Then all documents whose bound reaches it, so all that are not provably outside, are scored exactly from their texts. Texts are
read for those alone: a bitmap of hashed ids, of fixed size, keeps the others out of the shuffle.

The index holds nothing of the items. It is a table of blocks and of word counts, how many documents of a part of the corpus hold each
term. Items are dealt into groups and meet groups of blocks; neither side is broadcast.

Term identity is exact: terms are found as runs of bytes and told apart by their bytes; hashes are used in signatures only.

Defined results: null and empty texts have no terms and don't count; an item without terms, or whose terms no document
holds, has no rows; fewer than k documents of a score above 0 are all returned; ties go to smaller ids; repeated rows of documents are
documents of their own; documents without an id count in the statistics but are not returned; repeated rows of items have
their own results each; items without an id have none; empty tables give none; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.shared import only, portions, written

K = 10
#: Fixed value: what separates terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Occurrences that a term must have for each level; the last is open.
LEVELS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 28, 40, 64, 128)
#: Bits of a signature for each of its keys at least, and hashes of a key; bits of the widest signature, beyond which more of
#: them are set; documents and bits of a block at most.
BITS_EACH, HASHES, WIDEST, ROWS, BLOCK_BITS = 16, 6, 1 << 22, 1024, 1 << 24
#: Items of a group, and blocks of one; terms whose bitmaps are read at once.
ITEMS, BLOCKS, TERMS = 1024, 4, 1024

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(text: str) -> list[str]:
    """The terms of one text, in order."""
    return re.findall(TERM, text.translate({c: c + 32 for c in range(0x41, 0x5B)}))


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term number, occurrences) of each distinct term of each text, by row, and the terms. In UTF-8 the bytes of
    characters beyond ASCII never are separators, so terms are runs of bytes."""
    binary = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(binary.buffers()[2], np.uint8)[begin:end] if end > begin else np.zeros(0, np.uint8)
    inside = _INSIDE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = offsets - begin
    own = cut[:-1][cut[:-1] < cut[1:]]  # a text's first byte never goes on with the text before
    starts[own] = inside[own]
    at = np.flatnonzero(starts)
    letters = np.ascontiguousarray(_LOWER[data[inside]])
    kept_before = np.concatenate([[0], np.cumsum(inside)])
    ends = np.concatenate([kept_before[at], [len(letters)]]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes())])
    coded = words.dictionary_encode()
    row = np.searchsorted(cut, at, "right") - 1
    vocabulary = max(1, len(coded.dictionary))
    pair, n = np.unique(row.astype(np.int64) * vocabulary + coded.indices.to_numpy(), return_counts=True)
    return pair // vocabulary, pair % vocabulary, n, coded.dictionary


def key_hashes(terms: list[bytes]) -> np.ndarray:
    """A hash for each term and level."""
    own = np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64)
    with np.errstate(over="ignore"):
        mixed = own[:, None] + np.arange(1, len(LEVELS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(27))


def slices_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The bits of each key in signatures of this width, a power of two."""
    with np.errstate(over="ignore"):
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return ((hashes[..., None] + np.arange(HASHES, dtype=np.uint64) * step[..., None]) & np.uint64(width - 1)).astype(np.int64)


def width_of(keys: int) -> int:
    return min(WIDEST, 1 << max(6, int(BITS_EACH * max(1, keys) - 1).bit_length()))


@dataclass
class Block:
    """Documents side by side: their ids, numbers of terms, most occurrences of one term, and the slices."""

    width: int
    ids: np.ndarray
    sizes: np.ndarray
    most: np.ndarray
    slices: np.ndarray  # width, bytes of documents

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """How many levels each term may reach in each document (term, document): 0 where it is not held. Levels are nested, so a
        higher one counts only where all below may be reached."""
        rows = len(self.ids)
        out, some, before = np.zeros((len(hashes), rows), np.uint8), np.arange(len(hashes)), None
        for level in range(len(LEVELS)):
            bits = slices_of(hashes[some, level], self.width)
            found = self.slices[bits[:, 0]]
            for k in range(1, HASHES):
                found &= self.slices[bits[:, k]]
            if before is not None:
                found &= before
            any_ = found.any(axis=1)
            some, before = some[any_], found[any_]
            if not len(some):
                break
            out[some] += np.unpackbits(before, axis=1, count=rows)
        return out


def parts(most: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The greatest part of a weight for each level and document: level's most occurrences, within the document's own most."""
    upper = np.array([*(n - 1 for n in LEVELS[1:]), np.iinfo(np.int32).max], np.int64)
    tf = np.minimum(upper[:, None], most[None, :])
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[None, :])


def lengths_factor(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    return np.array([25 + (75 * int(s) * n) // total for s in sizes], np.int64)


def bounds(block: Block, vocabulary: np.ndarray, items: list[list[tuple[int, int]]], n: int, total: int) -> np.ndarray:
    """The upper bound of each item's score (weights by term number) in each document of the block."""
    part = np.vstack([np.zeros(len(block.ids), np.int64), parts(block.most, lengths_factor(block.sizes, n, total))])
    out, every = np.zeros((len(items), len(block.ids)), np.int64), np.arange(len(block.ids))
    asked = sorted((term, k, weight) for k, terms in enumerate(items) for term, weight in terms)
    at = 0
    for begin in range(0, len(vocabulary), TERMS):
        value = part[block.levels(vocabulary[begin : begin + TERMS]), every]
        held = value.any(axis=1)
        while at < len(asked) and asked[at][0] < begin + TERMS:
            term, k, weight = asked[at]
            if held[term - begin]:
                out[k] += weight * value[term - begin]
            at += 1
    return out


class _Builder:
    """Documents of a size class that wait for their block."""

    def __init__(self, width: int):
        self.width, self.most = width, max(8, min(ROWS, BLOCK_BITS // width))
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.highest, self.bits = [], [], [], []

    def block(self) -> tuple:
        dense = np.zeros((self.width, -(-len(self.ids) // 8) * 8), bool)
        dense[np.concatenate(self.bits), np.repeat(np.arange(len(self.ids)), [len(b) for b in self.bits])] = True
        return self.width, self.ids, self.sizes, self.highest, np.packbits(dense, axis=1).tobytes(), [], []


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of documents, as a written table (width, ids, sizes, most, slices, terms, held): rows of blocks, and rows of
    word counts, whose width is 0 and which have no documents."""
    levels, name = np.array(LEVELS), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, _Builder] = {}

        def rows(*full: tuple) -> pa.RecordBatch:
            types = [pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full, strict=True), types, strict=True)], names=["width", "ids", "sizes", "most", "slices", "terms", "held"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in portions(batch, batch.schema.names[1], 8_000_000):
                row, term, n, words = bags(part.column(1))
                if not len(row):
                    continue
                words = words.to_pylist()
                yield rows((0, [], [], [], b"", [w.decode("utf-8") for w in words], np.bincount(term, minlength=len(words))))
                reached = np.searchsorted(levels, n, "right")
                ends = np.cumsum(reached)
                keys = key_hashes(words)[np.repeat(term, reached), np.arange(ends[-1]) - np.repeat(ends - reached, reached)]
                begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                cuts = np.concatenate([[0], ends[np.append(begins[1:], len(row)) - 1]])
                sizes, highest, names = np.add.reduceat(n, begins), np.maximum.reduceat(n, begins), part.column(0).take(pa.array(row[begins])).to_pylist()
                for k, name in enumerate(names):
                    own = keys[cuts[k] : cuts[k + 1]]
                    to = waiting.setdefault(width := width_of(len(own)), _Builder(width))
                    to.ids.append(name)
                    to.sizes.append(int(sizes[k]))
                    to.highest.append(int(highest[k]))
                    to.bits.append(slices_of(own, width).ravel())
                    if len(to.ids) == to.most:
                        yield rows(to.block())
                        to.clear()
        for to in waiting.values():
            if to.ids:
                yield rows(to.block())

    schema = f"width int, ids array<{name}>, sizes array<bigint>, most array<bigint>, slices binary, terms array<string>, held array<bigint>"
    return written(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema), "signatures")


def statistics(index: DataFrame) -> tuple[int, int]:
    """Documents that have terms, and all their terms."""
    one = index.select(F.size("ids").cast("long").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total")).agg(F.sum("n"), F.sum("total")).first()
    return one[0] or 0, one[1] or 0


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, key, term, times): terms of each row of items, which is numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, n, words = bags(batch.column(2))
            part = pa.table([batch.column(0), batch.column(1)], names=["item", key]).take(pa.array(row))
            part = part.append_column("term", words.take(pa.array(term)).cast(pa.large_string()).cast(pa.string())).append_column("times", pa.array(n, pa.int64()))
            yield from part.combine_chunks().to_batches()

    rows = items.filter(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("item"), key, F.col(text).alias("text"))
    return written(rows.mapInArrow(run, f"item long, `{key}` {items.schema[key].dataType.simpleString()}, term string, times long"), "items")


def weights(asked: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """asked with the weight of each term; terms that no document holds are left out, as they add nothing."""
    held = index.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.held").alias("df"))
    w = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1)))
    return asked.join(held.join(asked.select("term").distinct(), "term", "left_semi"), "term").withColumn("weight", w).filter("weight > 0")


def dealt(asked: DataFrame) -> tuple[DataFrame, int]:
    """(item, terms, least, turn): each item's terms with their weights, in groups of about ITEMS; and the number of groups."""
    turns = 1 + asked.select("item").distinct().count() // ITEMS
    each = asked.groupBy("item").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("weight")).alias("w"))).alias("terms"), F.max("least").alias("least"))
    return each.withColumn("turn", F.pmod(F.xxhash64("item"), F.lit(turns)).cast("int")), turns


def candidates(index: DataFrame, asked: DataFrame, n: int, total: int, k: int | None) -> DataFrame:
    """(item, id, bound) of documents whose bound is above 0 and reaches the item's least; with k those of the k highest
    bounds in each group of blocks alone. asked: (item, term, times, weight, least)."""
    ids = index.schema["ids"].dataType.elementType.simpleString()
    index = index.filter("width > 0")
    groups = 1 + index.count() // BLOCKS
    each, turns = dealt(asked)
    each = each.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    blocks = index.select("width", "ids", "sizes", "most", "slices").withColumn("group", F.pmod(F.xxhash64("slices", "ids"), F.lit(groups)).cast("int"))
    blocks = blocks.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def meet(queries: pa.Table, group: pa.Table) -> pa.Table:
        out = [([], [], [])]
        lists = queries["terms"].to_pylist()
        vocabulary = sorted({t["term"] for x in lists for t in x})
        number = {t: i for i, t in enumerate(vocabulary)}
        items = [[(number[t["term"]], t["w"]) for t in x] for x in lists]
        hashes = key_hashes([t.encode("utf-8") for t in vocabulary])
        least = np.array([x or 1 for x in queries["least"].to_pylist()], np.int64)
        tops = np.zeros((len(items), k or 0), np.int64)
        for width, names, sizes, highest, slices in zip(*(group[c].to_pylist() for c in ("width", "ids", "sizes", "most", "slices")), strict=True):
            block = Block(width, np.array(names), np.array(sizes, np.int64), np.array(highest, np.int64), np.frombuffer(slices, np.uint8).reshape(width, -1))
            found = bounds(block, hashes, items, n, total)
            if k is not None:  # no more than k of a block, and none below the k highest of the blocks before
                few = min(k, found.shape[1])
                chosen = np.argpartition(-found, few - 1, axis=1)[:, :few]
                item, doc = np.repeat(np.arange(len(items)), few), chosen.ravel()
                reached = found[item, doc] >= np.maximum(least, tops.min(axis=1))[item]
                item, doc = item[reached], doc[reached]
                tops = np.partition(np.concatenate([tops, np.take_along_axis(found, chosen, axis=1)], axis=1), few, axis=1)[:, few:]
            else:
                item, doc = np.nonzero(found >= least[:, None])
            out.append((item, block.ids[doc], found[item, doc]))
        columns = [pa.array(np.concatenate([np.asarray(x[c]) for x in out[1:]] or [np.zeros(0, np.int64)])) for c in range(3)]
        return pa.table([queries["item"].combine_chunks().take(columns[0].cast(pa.int64())), columns[1].cast(id_type), columns[2]], names=["item", "id", "bound"])

    id_type = pa.int32() if ids == "int" else pa.string() if ids == "string" else pa.int64()
    found = each.groupBy("turn", "group").cogroup(blocks.groupBy("turn", "group")).applyInArrow(meet, f"item long, id {ids}, bound long")
    return found.filter("id is not null")


def rescored(docs: DataFrame, pairs: DataFrame, asked: DataFrame, n: int, total: int, key: str, text: str) -> DataFrame:
    """(item, id, score) above 0 of pairs (item, id), exactly, from the documents' whole texts."""
    pairs = written(pairs.select("item", "id").distinct(), "pairs")
    each, turns = dealt(asked)
    each = written(each, "dealt")  # by itself, so that the pairs of an item that very many documents may hold can be split where they meet it
    buckets = 1 + pairs.count() // 4096
    bucket = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(buckets)).cast("int").alias("bucket")
    left = pairs.join(each.select("item", "terms", "turn"), "item").select("item", "id", "terms", "turn", bucket)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null")
    right = only(texts, pairs.select("id"), "id").select("id", "text", bucket, F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))

    def meet(wanted: pa.Table, texts: pa.Table) -> pa.Table:
        by_id: dict = {}
        for item, name, terms in zip(*(wanted[c].to_pylist() for c in ("item", "id", "terms")), strict=True):
            by_id.setdefault(name, []).append((item, terms))
        out: list[tuple] = []
        for name, x in zip(texts["id"].to_pylist(), texts["text"], strict=True):
            if name in by_id:
                words = terms_of(x.as_py() or "")
                m, counts = 25 + 75 * len(words) * n // total, Counter(words)
                for item, terms in by_id[name]:
                    score = sum(t["w"] * ((1_000_000_000 * counts[t["term"]]) // (1000 * counts[t["term"]] + 8 * m)) for t in terms if t["term"] in counts)
                    if score > 0:
                        out.append((item, name, score))
        items, names, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(items, pa.int64()), pa.array(names, wanted.schema.field("id").type), pa.array(scores, pa.int64())], names=["item", "id", "score"])

    return left.groupBy("bucket", "turn").cogroup(right.groupBy("bucket", "turn")).applyInArrow(meet, f"item long, id {pairs.schema['id'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(item, rank, key, score): the k documents of the highest scores for each item. index: that of these documents, if it
    has been built."""
    index = build(docs, key, text) if index is None else index
    n, total = statistics(index)
    schema = f"{item} {items.schema[item].dataType.simpleString()}, rank int, {key} {docs.schema[key].dataType.simpleString()}, score long"
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    every = item_terms(items, item, item_text)
    asked = written(weights(every, index, n).select("item", "term", "times", "weight"), "asked")
    best = lambda by: F.row_number().over(Window.partitionBy("item").orderBy(F.desc(by), "id"))
    seeds = candidates(index, asked.withColumn("least", F.lit(None).cast("long")), n, total, k)
    seeds = seeds.withColumn("place", best("bound")).filter(F.col("place") <= k)
    begun = rescored(docs, seeds, asked.withColumn("least", F.lit(None).cast("long")), n, total, key, text)
    begun = begun.withColumn("place", best("score")).filter(F.col("place") <= k)
    least = begun.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    sure = written(asked.join(least, "item", "left"), "bounded")
    found = rescored(docs, candidates(index, sure, n, total, None), sure, n, total, key, text)
    found = found.withColumn("rank", best("score").cast("int")).filter(F.col("rank") <= k)
    names = every.select("item", item).distinct()
    return found.join(names, "item").select(item, "rank", F.col("id").alias(key), "score")
