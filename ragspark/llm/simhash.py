"""SimHash near-duplicates by vantage-point trees.

Fingerprints: ASCII letters are lower-cased, words are runs without ASCII white space, shingles are `words_each` words
joined by one space, with repeats (fewer words: the whole sequence is the one shingle; none: fingerprint 0). A bit is set
if it is set in over half of the shingles' hashes: XXH64 for the 64 bits of a short fingerprint, and for the 512 bits of
a long one eight mixtures of it, with every distinct shingle counted once.

Two rules are offered. `near_duplicates` links short fingerprints at `max_bits` or fewer differing bits, exactly.
`similar_documents` links texts whose sets of shingles have a Jaccard similarity of `similarity` or more. Long fingerprints
find the candidates: two sets of similarity J have an angle of arccos(2J / (1 + J)), of which the share of differing bits is
an estimate. The bound on the bits has room for the estimate's error (ROOM standard deviations). Candidates are then verified
on the whole sets, so no two texts are linked that are less similar; one pair in some dozens that is similar enough is missed,
unless a chain of others connects it (see PIECES).

Verification: groups that candidates connect are dealt into parts of about PART sets. In a part a group grows from a text to all that
are similar enough to one of it, so texts that are found take part in no further comparison. A group of several parts has some
texts (PIVOTS) in all of them; those that its largest verified group then doesn't hold meet all the others, block by block.

Search: fingerprints are cut into pieces on which partners differ by very few bits, and each piece is an index of its own.
A short one has two halves: at 3 or fewer bits in all, one half has at most 1 (in general max_bits // 2). A long one has
PIECES of PIECE_BITS bits, of which partners at the similarity most likely have one that differs by at most 1.
A vantage-point tree over a piece is fitted on a sample of distinct fingerprints: a node deals rows by the distance of the
piece to its vantage point, inside or outside a median radius. Every fingerprint is native to one leaf. By the triangle
inequality a partner of an inside row lies outside only if the row is within the search radius of the border, so just those
rows are sent on to the outer leaves as queries, and no pair is looked for twice. A leaf is a shard; shards of many rows are
cut into slices that meet slice by slice. In a shard the search goes on down a tree of its own, and leaves compare all bits.

Components: a shard returns spanning links only, so groups of near copies never become all their pairs; the links are
contracted by alternating large and small stars, a few rounds of joins and sums over tables in the shared folder. Joins
on a node are salted, as one node may be the centre of all the rest.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and link like any other; repeated
rows and copies share a fingerprint, which is compared once. A null key forms no component minimum but gets its component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.shared import free, only, portions, share_of, written

SEED = 42
WORDS_EACH, SIMILARITY = 5, 0.8
#: The rule of short fingerprints.
SHORT_WORDS, MAX_BITS = 3, 3
#: Long fingerprints: 64-bit words, pieces and their bits. At a similarity of 0.8, 15 bits in 100 differ; a piece then differs by at
#: most 1 with probability 0.17, and at least one of the pieces does with 0.99.
LONG_WORDS, PIECES, PIECE_BITS, PIECE_RADIUS, ROOM = 8, 24, 20, 1, 2.3
#: Distinct fingerprints that trees are fitted on: so many, or this share of them if that is more.
SAMPLE, SHARE = 40_000, 1 / 500
#: Rows that a shard of short and of long fingerprints is meant to hold, and the rows of a slice of a shard that holds far more.
SHARD, LONG_SHARD, SLICE = 8_000, 64_000, 128_000
#: Depth of a tree at most, for its nodes are sent to every task; below it shards are sliced.
DEEPEST = 16
#: Rows of a leaf inside a shard.
LEAF = 512
#: Shingles that are hashed at once.
AT_ONCE = 50_000
#: Sets that are verified in one task, and texts of a larger group that are in all of its parts.
PART, PIVOTS = 1_000, 16
#: Rows of one fingerprint from which on it is joined by itself, and parts into which the rows of a node are dealt.
HOT, SALTS = 10_000, 16


def shingle_hashes(text: str, words_each: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in their order, AT_ONCE at once; none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths).tolist()
    ends = ends[words_each - 1 :].tolist() or [len(joined)]
    of = xxhash.xxh64_intdigest
    for at in range(0, len(ends), AT_ONCE):
        yield np.array([of(joined[a:b], seed) for a, b in zip(begins[at : at + AT_ONCE], ends[at : at + AT_ONCE])], np.uint64)


#: Whether each bit of a byte is set, the highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, the highest bit of a row's first word first. hashes: (row,) or (row, word)."""
    data = hashes.astype(">u8").view(np.uint8).reshape(len(hashes), -1)
    places = np.arange(data.shape[1], dtype=np.int64) * 256
    counts = np.bincount((data + places).ravel(), minlength=256 * data.shape[1]).reshape(-1, 256)
    return np.rint(counts.astype(np.float32) @ _BITS).astype(np.int64).ravel()  # AT_ONCE rows are counted exactly


def fingerprint(text: str, words_each: int = SHORT_WORDS, seed: int = SEED) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words_each, seed):
        counts, n = counts + _set_bits(hashes), n + len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


#: Odd numbers and offsets by which a hash is mixed anew for each word of a long fingerprint.
_ODD = np.arange(1, 2 * LONG_WORDS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_OFFSET = np.arange(1, LONG_WORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)


def shingle_set(text: str, words_each: int = WORDS_EACH) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    parts = [*shingle_hashes(text, words_each)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def long_fingerprint(distinct: np.ndarray) -> bytes:
    """LONG_WORDS words of 64 bits, little-endian, of a set of shingles."""
    if not len(distinct):
        return bytes(8 * LONG_WORDS)
    counts = np.zeros(64 * LONG_WORDS, np.int64)
    for at in range(0, len(distinct), 4096):
        x = (distinct[at : at + 4096, None] ^ _OFFSET) * _ODD
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        counts += _set_bits(x ^ x >> np.uint64(29))
    return np.packbits(2 * counts > len(distinct)).view(">u8").astype("<u8").tobytes()


def fingerprints(docs: DataFrame, text: str = "text", words_each: int = SHORT_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, and fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py() or "", words_each) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(values, np.uint64).view(np.int64))], names=[*keep, "fp"])

    return _texts(docs, text, keep).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())]))


def long_fingerprints(docs: DataFrame, text: str = "text", words_each: int = WORDS_EACH, keep: tuple[str, ...] = ("doc_id",), sets: bool = False) -> DataFrame:
    """The columns to keep; node, a hash of the set of the text's shingles; fp, its long fingerprint (binary); and with sets the
    set itself (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.schema.names[-1]):
                every = [shingle_set(x.as_py() or "", words_each) for x in part.column(part.num_columns - 1)]
                nodes = pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in every], np.uint64).view(np.int64))
                columns = [*part.columns[:-1], nodes, pa.array([long_fingerprint(x) for x in every], pa.binary())]
                columns += [pa.array([x.tobytes() for x in every], pa.binary())] if sets else []
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "node", "fp", "set"][: len(columns)])

    fields = [T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("set", T.BinaryType())]
    return _texts(docs, text, keep).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *fields[: 2 + sets]]))


def _texts(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(free("text", keep)))


def halves(prints: np.ndarray) -> list[np.ndarray]:
    """The two halves of short fingerprints."""
    return [(prints[:, 0] >> np.uint64(shift)) & np.uint64(0xFFFFFFFF) for shift in (0, 32)]


def pieces(prints: np.ndarray) -> list[np.ndarray]:
    """PIECES pieces of long fingerprints, each of PIECE_BITS bits of one word."""
    each = 64 // PIECE_BITS
    return [(prints[:, k // each] >> np.uint64(k % each * PIECE_BITS)) & np.uint64((1 << PIECE_BITS) - 1) for k in range(PIECES)]


def most_bits(similarity: float, bits: int = 64 * LONG_WORDS) -> int:
    """Differing bits up to which long fingerprints are linked."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + ROOM * math.sqrt(bits * share * (1 - share)))


@dataclass
class Tree:
    """A vantage-point tree over one piece of the fingerprints, in the order of a binary heap. Node k has children 2k + 1
    (inside) and 2k + 2; leaf k of depth d is node 2^d - 1 + k."""

    depth: int
    vantage: np.ndarray
    radius: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Tree:
        """Vantage points are chosen from a node's own sample rows: of a few, the one whose distances spread most."""
        tree = cls(depth, np.zeros((1 << depth) - 1, np.uint64), np.zeros((1 << depth) - 1, np.int64))
        rows = {0: np.unique(sample)}
        random = np.random.default_rng(SEED)
        for k in range(len(tree.vantage)):
            own = rows.pop(k, np.zeros(0, np.uint64))
            if len(own):
                tries = random.choice(own, min(8, len(own)), replace=False)
                distances = [np.bitwise_count(own ^ v).astype(np.int64) for v in tries]
                best = max(range(len(tries)), key=lambda i: distances[i].var())
                tree.vantage[k], tree.radius[k] = tries[best], int(np.median(distances[best]))
                near = distances[best] <= tree.radius[k]
                rows[2 * k + 1], rows[2 * k + 2] = own[near], own[~near]
        return tree

    def deal(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number, leaf, native): each row's own leaf, and the leaves to which it goes as a query."""
        row, node, native = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(values[row] ^ self.vantage[node]).astype(np.int64)
            r = self.radius[node]
            inside, outside = d <= r, d > r
            also_in, also_out = ~native & outside & (d - reach <= r), inside & (d + reach > r)
            own = np.where(inside, 2 * node + 1, 2 * node + 2)
            row, node, native = (
                np.concatenate([row, row[also_in], row[also_out]]),
                np.concatenate([own, 2 * node[also_in] + 1, 2 * node[also_out] + 2]),
                np.concatenate([native, np.zeros(int(also_in.sum() + also_out.sum()), bool)]),
            )
        return row, node - len(self.vantage), native


def close_pairs(values: np.ndarray, native: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within a shard whose values differ by at most so many bits: of natives among themselves, and of
    queries with natives, each found once."""
    stack = [(np.flatnonzero(native), np.flatnonzero(~native))]
    while stack:
        own, asked = stack.pop()
        if not len(own) or len(own) + len(asked) < 2:
            continue
        v = values[own]
        d = np.bitwise_count(v ^ v[0]).astype(np.int64)
        if len(own) <= LEAF or not d.any():
            step = max(1, 1_000_000 // len(own))
            for k, rows in ((0, own), (1, asked)):
                for at in range(0, len(rows), step):
                    found, to = np.nonzero(np.bitwise_count(values[rows[at : at + step], None] ^ v[None, :]) <= bits)
                    if not k:
                        found, to = found[to > found + at], to[to > found + at]
                    if len(found):
                        yield rows[at : at + step][found], own[to]
            continue
        r = min(int(np.median(d)), int(d.max()) - 1)
        near = d <= r
        e = np.bitwise_count(values[asked] ^ v[0]).astype(np.int64)
        stack.append((own[near], asked[e - bits <= r]))
        stack.append((own[~near], np.concatenate([asked[e + bits > r], own[near & (d + bits > r)]])))


def within(pairs: Iterator[tuple[np.ndarray, np.ndarray]], prints: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs whose whole fingerprints differ by at most so many bits."""
    for a, b in pairs:
        for at in range(0, len(a), 100_000):
            some, to = a[at : at + 100_000], b[at : at + 100_000]
            fine = np.bitwise_count(prints[some] ^ prints[to]).sum(axis=1, dtype=np.int64) <= bits
            if fine.any():
                yield some[fine], to[fine]


def lowest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in these pairs, and the smallest value of each one's component."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, low = at[: len(a)], at[len(a) :], np.arange(len(values))
    while True:
        was = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == was).all():
            return values, values[low]


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each linked value with the smallest value of its component. Pairs are reduced block by block, so memory follows
    the values, not the pairs."""
    a, b, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for more in pairs:
        waiting.append(lowest_of(*more))
        if sum(len(x) for x, _ in waiting) > max(100_000, 2 * len(a)):
            a, b = lowest_of(*map(np.concatenate, zip((a, b), *waiting, strict=True)))
            waiting = []
    return lowest_of(*map(np.concatenate, zip((a, b), *waiting, strict=True)))


def links(distinct: DataFrame, bits: int = MAX_BITS, radius: int | None = None, sample: int = SAMPLE, shard: int | None = None) -> DataFrame:
    """Spanning links (a, b) between nodes of distinct (node long, fp) whose fingerprints differ by at most so many bits.

    fp: short (long) or long (binary) fingerprints. For short ones two nodes are connected by the links just if a chain of close
    pairs connects them; for long ones if a chain of close pairs does that differ by at most `radius` in some piece."""
    spark, short = distinct.sparkSession, distinct.schema["fp"].dataType == T.LongType()
    radius = (bits // 2 if short else PIECE_RADIUS) if radius is None else radius
    shard = (SHARD if short else LONG_SHARD) if shard is None else shard
    cut = halves if short else pieces

    def words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None] if short else np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)

    n = distinct.count()
    rows = distinct.filter(share_of(max(sample, int(n * SHARE)), n, "fp", F.lit("sample"))).select("fp").toArrow()["fp"]
    fitted = words(rows) if len(rows) else np.zeros((0, 1 if short else LONG_WORDS), np.uint64)
    depth = int(np.clip(np.ceil(np.log2(max(1, n / shard))), 0, min(DEEPEST, np.log2(max(2, len(fitted) / 8)))))
    trees = [Tree.fit(x, depth) for x in cut(fitted)]
    # rows of each leaf by the sample; they decide how a leaf is cut, not what is found
    sizes = [np.bincount(tree.deal(x, -1)[1], minlength=1 << depth) * (n / max(1, len(fitted))) for tree, x in zip(trees, cut(fitted), strict=True)]
    sent = spark.sparkContext.broadcast([(tree, np.ceil(np.maximum(1, x) / SLICE).astype(np.int64)) for tree, x in zip(trees, sizes, strict=True)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                numbers = part.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for k, ((tree, slices), values) in enumerate(zip(sent.value, cut(words(part.column(1))), strict=True)):
                    row, leaf, native = tree.deal(values, radius)
                    # a native meets the natives of its own slice, and those of the later slices as a query; others meet all slices
                    most = slices[leaf]
                    own = (numbers[row] % most.astype(np.uint64)).astype(np.int64)
                    first = np.where(native, own, 0)
                    each = np.repeat(np.arange(len(row)), most - first)
                    place = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(most - first) - (most - first), most - first)
                    mine = native[each] & (place == own[each])
                    columns = [pa.array(np.full(len(each), k, np.int32)), pa.array(leaf[each].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(mine), *(c.take(pa.array(row[each])) for c in part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "slice", "native", "node", "fp"])

    dealt = distinct.select("node", "fp").mapInArrow(deal, f"tree int, leaf int, slice int, native boolean, node long, fp {distinct.schema['fp'].dataType.simpleString()}")

    def search(group: pa.Table) -> pa.Table:
        nodes, native, prints = group["node"].to_numpy(), group["native"].to_numpy(), words(group["fp"])
        pairs = close_pairs(prints[:, 0], native, bits) if short else within(close_pairs(pieces(prints)[group["tree"][0].as_py()], native, radius), prints, bits)
        a, b = spanning(pairs)
        return pa.table([pa.array(nodes[a[a != b]]), pa.array(nodes[b[a != b]])], names=["a", "b"])

    return dealt.groupBy("tree", "leaf", "slice").applyInArrow(search, "a long, b long").distinct()


def _for_each_salt(rows: DataFrame) -> DataFrame:
    """rows for each part of the other side. They are merged, not sent out: Spark would judge their size before they are copied."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).hint("merge")


def _stars(edges: DataFrame) -> bool:
    """Whether these different pairs (u, v) are stars with v in the middle, which a round of stars leaves as they are: no u has two
    v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("outer")), F.struct(F.col("v").alias("node"), F.lit(0).alias("outer")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("outer").alias("outer"), F.min("outer").alias("least"))
    return not nodes.agg(F.count_if(F.expr("outer > 1 or outer = 1 and least = 0"))).first()[0]


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of the pairs (a, b): the smallest node reachable, by rounds of large and small stars
    until all pairs are stars.

    A round's tables lie in the shared folder. A node with very many partners is summed before the shuffle, and its
    pairs are dealt into SALTS parts where they meet its minimum."""
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _for_each_salt(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").withColumn("salt", salt).join(lowest, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = _for_each_salt(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.withColumn("salt", salt).join(lowest, ["u", "salt"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.filter("u <> v").distinct(), "edges", spent=[edges])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of sorted hashes have this Jaccard similarity or more; empty ones are alike."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    if not len(a):
        return True
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def grown(prints: np.ndarray, sets: list[np.ndarray], bits: int, similarity: float) -> np.ndarray:
    """For each text the first one of its group: texts that a chain of pairs connects, each with at most so many differing bits
    and of this similarity. Who has been found is compared with none again."""
    first, left = np.full(len(sets), -1), np.arange(len(sets))
    while len(left):
        seed, left, waiting = left[0], left[1:], [left[0]]
        first[seed] = seed
        while waiting and len(left):
            own = waiting.pop()
            near = np.bitwise_count(prints[left] ^ prints[own]).sum(axis=1, dtype=np.int64) <= bits
            found = np.zeros(len(left), bool)
            found[near] = [similar(sets[own], sets[k], similarity) for k in left[near]]
            first[left[found]] = seed
            waiting += left[found].tolist()
            left = left[~found]
    return first


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    prints = np.frombuffer(b"".join(table["fp"].to_pylist()), "<u8").reshape(table.num_rows, -1)
    return table["node"].to_numpy(), prints, [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]


def verified(members: DataFrame, bits: int, similarity: float, part: int = PART) -> DataFrame:
    """Links (a, b) of texts that a chain of similar pairs connects. members: a written table (root, node, fp, set), where root
    is that of the group by candidates."""

    def grow(table: pa.Table) -> pa.Table:
        nodes, prints, sets = _members(table.sort_by("node"))
        nodes, at = np.unique(nodes, return_index=True)  # pivots are members too
        first = grown(prints[at], [sets[k] for k in at], bits, similarity)
        linked = np.flatnonzero(first != np.arange(len(nodes)))
        return pa.table([pa.array(nodes[linked]), pa.array(nodes[first[linked]])], names=["a", "b"])

    sizes = members.groupBy("root").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    sizes = written(sizes, "sizes")
    dealt = members.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    large = written(dealt.filter("parts > 1").select(*members.columns, "parts", "part"), "large")
    few = F.row_number().over(Window.partitionBy("root", "part").orderBy(F.xxhash64("node", F.lit(1))))
    pivots = large.withColumn("_place", few).filter(F.col("_place") <= PIVOTS)  # of each part first, so that no task sorts a group
    few = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(1))))
    pivots = pivots.withColumn("_place", few).filter(F.col("_place") <= PIVOTS)
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = dealt.select("root", "part", "node", "fp", "set").unionByName(pivots.select("root", "part", "node", "fp", "set"))
    links_ = written(every.groupBy("root", "part").applyInArrow(grow, "a long, b long"), "verified")
    if large.isEmpty():
        return links_
    # what the largest verified group of a large one does not hold meets all that it has no chain to yet
    roots = components(links_.join(large.select(F.col("node").alias("a")), "a"))
    known = large.join(roots.withColumnRenamed("root", "_own"), "node", "left").withColumn("own", F.coalesce("_own", "node")).drop("_own")
    known = written(known, "known")
    main = known.groupBy("root", "own").count().groupBy("root").agg(F.max_by("own", F.struct("count", "own")).alias("main"))
    rest = written(known.join(main, "root").filter("own <> main").drop("main"), "rest")
    blocks = rest.groupBy("root").agg(F.ceil(F.count("*") / part).cast("int").alias("blocks"))
    left = rest.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = known.join(blocks, "root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        a, b = [], []
        if some.num_rows and others.num_rows:
            (nodes, prints, sets), (to, others_prints, others_sets) = _members(some), _members(others)
            own, theirs = some["own"].to_numpy(), others["own"].to_numpy()
            for k in range(len(nodes)):
                near = (np.bitwise_count(others_prints ^ prints[k]).sum(axis=1, dtype=np.int64) <= bits) & (theirs != own[k])
                done: set[int] = set()  # one link to each group is enough
                for m in np.flatnonzero(near):
                    if theirs[m] not in done and similar(sets[k], others_sets[m], similarity):
                        done.add(theirs[m])
                        a.append(nodes[k])
                        b.append(to[m])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ("root", "block", "part", "node", "fp", "set", "own")
    met = left.select(*columns).groupBy("root", "block", "part").cogroup(right.select(*columns).groupBy("root", "block", "part")).applyInArrow(meet, "a long, b long")
    return links_.unionByName(met)


def _distinct(prints: DataFrame, key: str) -> DataFrame:
    """A written table (node, fp, least, copies): each node with its smallest key and its number of rows."""
    return written(prints.groupBy("node", "fp").agg(F.min(key).alias("least"), F.count("*").alias("copies")), "distinct")


def _with_components(prints: DataFrame, key: str, least: DataFrame, found: DataFrame) -> DataFrame:
    """(key, fp, component) for each row of the written table prints (key, fp, node). found: links of the nodes of least."""
    linked = components(found).withColumnRenamed("node", "linked")
    alone = least.join(linked, least["node"] == linked["linked"], "left_anti").select("node", "copies", F.col("least").alias("component"))
    grouped = least.join(linked, least["node"] == linked["linked"]).select("node", "least", "copies", "root")
    lowest = _for_each_salt(grouped.groupBy("root").agg(F.min("least").alias("component")))
    moved = grouped.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(lowest, ["root", "salt"]).select("node", "copies", "component")
    moved = written(moved.unionByName(alone), "components")
    # a fingerprint of many rows is not dealt out by its value; of such there is one in HOT rows at most
    hot = F.broadcast(moved.filter(F.col("copies") >= HOT).select("node", "component"))
    rest = prints.join(hot.select("node"), "node", "left_anti").join(moved.filter(F.col("copies") < HOT).select("node", "component"), "node")
    return prints.join(hot, "node").unionByName(rest).select(key, "fp", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = SHORT_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component): a row for each row of docs; component is the smallest key reachable over links of short
    fingerprints at max_bits or fewer differing bits."""
    prints = written(fingerprints(docs, text, words_each, (key,)).withColumn("node", F.col("fp")), "fingerprints")
    least = _distinct(prints, key)
    return _with_components(prints, key, least, links(least.select("node", "fp"), max_bits))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = WORDS_EACH, similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """(key, fp, component): a row for each row of docs; component is the smallest key reachable over links of texts whose
    shingle sets have this Jaccard similarity or more. docs is read twice, so it should be a written table."""
    prints, bits = written(long_fingerprints(docs, text, words_each, (key,)), "fingerprints"), most_bits(similarity)
    least = _distinct(prints, key)
    candidates = written(components(links(least.select("node", "fp"), bits)), "candidates")
    # one text of each node: the first row of its smallest key
    wanted = candidates.join(least.select("node", "least"), "node").select("node", "root", F.col("least").alias(key))
    texts = only(docs.select(key, text), wanted.select(key), key)
    whole = long_fingerprints(texts, text, words_each, (key,), sets=True)
    members = whole.join(wanted.select("node", "root"), "node").groupBy("root", "node").agg(F.first("fp").alias("fp"), F.first("set").alias("set"))
    return _with_components(prints, key, least, verified(written(members, "members"), bits, similarity, part))
