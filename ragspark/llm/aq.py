"""Approximate nearest neighbours by additive quantisation, then exact reranking.

A vector is the sum of STAGES codewords of full width, one from each codebook. Codebooks are fitted on a bounded sample of
vectors (SAMPLE), each by k-means on what the ones before it leave. Every vector is encoded by a beam search that keeps the
BEAM best sums after each stage. With the codes the ratio of its own norm to the sum's norm is stored, which takes back the
shrinking of the code. A query makes a table of its inner product with every codeword; a vector's approximate score is the
sum of its codes' entries times its ratio. The best of each block by this score are scored exactly, in double precision, and
the best of all blocks are kept. How many those are is measured in every meeting of a block of vectors with a part of the
queries: some of these queries are also scored against the whole block, and so many are reranked as hold WANTED of what is
truly nearest to them. Wide or shapeless vectors, whose codes err more, so get a deeper rerank. Nothing is left out of the scan.

Equal vectors are encoded and scored once. Each keeps its smallest ids, one more than are asked for, so a vector that a
third of all rows share stays one row, and ties go to smaller ids.

Defined results: vectors that are null, of norm zero, hold null or non-finite components, have no id or another width than
most take no part; rows that repeat an id and its vector count once; fewer candidates than asked for are all returned. Equal
scores of different vectors are ordered by id before every cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.shared import share_of, written

STAGES, CODES, BEAM, ROUNDS = 8, 256, 4, 8
SAMPLE = 12_000
#: The share of the true nearest that the rerank is to hold, as measured with so many queries of each meeting.
WANTED, PROBES = 0.98, 32
#: Pairs of a vector and a query that are worth a task, and bytes of vectors or queries that a task holds at most.
PAIRS, BLOCK_BYTES = 1 << 24, 32 << 20


@dataclass
class Codebooks:
    words: np.ndarray  # stage, code, width

    @classmethod
    def fit(cls, sample: np.ndarray) -> Codebooks:
        random, rest, words = np.random.default_rng(3), sample.astype(np.float32), []
        for _ in range(STAGES):
            centres = rest[random.choice(len(rest), CODES, replace=len(rest) < CODES)] + random.normal(0, 1e-6, (CODES, rest.shape[1])).astype(np.float32)
            for _ in range(ROUNDS):
                near = (rest @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
                n = np.bincount(near, minlength=CODES)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, rest)
                centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            rest = rest - centres[(rest @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)]
            words.append(centres)
        return cls(np.stack(words))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of each row, by beam search over the stages."""
        x = x.astype(np.float32)
        n, every = len(x), np.arange(len(x))[:, None]
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        error = (rest**2).sum(axis=2)
        for words in self.words:
            all_errors = error[:, :, None] - 2 * (rest @ words.T) + (words**2).sum(axis=1)
            flat = all_errors.reshape(n, -1)
            keep = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            beam, code = np.divmod(best, CODES)
            rest = rest[every, beam] - words[code]
            codes = np.concatenate([codes[every, beam], code[:, :, None].astype(np.uint8)], axis=2)
            error = np.take_along_axis(flat, best, axis=1)
        return codes[np.arange(n), error.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(words[codes[:, k]] for k, words in enumerate(self.words))

    def scores(self, queries: np.ndarray, codes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """Approximate inner products, row by query, from tables of the queries with the codewords."""
        total = np.zeros((len(codes), len(queries)), np.float32)
        for k, words in enumerate(self.words):
            total += (words @ queries.T)[codes[:, k]]
        return total * ratio[:, None]


def usable(vector: Column) -> Column:
    """Neither null nor of norm zero nor with null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, key: str, vector: str, ids: int) -> DataFrame:
    """(vector, ids): each distinct usable vector of the usual width with its smallest ids."""
    fine = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    width = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    fine = fine.filter(F.size("vector") == (width["n"] if width else 0))
    fine = fine.groupBy("vector", "id").agg(F.lit(1).alias("one")).drop("one")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return fine.withColumn("place", place).filter(F.col("place") <= ids).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def nearest(exact: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores, greatest first, ties to the smaller first id."""
    some = np.arange(len(exact))
    if len(exact) > k:
        some = np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k])
    return some[np.lexsort((first[some], -exact[some]))[:k]]


def depth(rough: np.ndarray, exact: np.ndarray, k: int, wanted: float = WANTED) -> int:
    """How many of a block's best by rough score hold so large a share of its k best by exact score, over some queries."""
    k = min(k, exact.shape[1])
    true = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    above = np.sort(-rough, axis=1)
    places = np.concatenate([np.searchsorted(a, -r[t], "right") for a, r, t in zip(above, rough, true, strict=True)])
    return int(np.quantile(places, wanted, method="higher"))


def meeting(books: Codebooks, asked: np.ndarray, codes: np.ndarray, ratio: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its k best vectors in the block, best first, and their exact scores.

    How many are reranked is measured here: PROBES queries are scored exactly against the whole block, and the rerank takes
    as many rough scores as hold WANTED of these queries' true best. Vectors that tie with the last of them are taken too.
    Where that is half of the block or more, the whole block is scored exactly."""
    rough = lambda q: np.ascontiguousarray(books.scores(q.astype(np.float32), codes, ratio).T)
    probes = asked[:: max(1, len(asked) // PROBES)][:PROBES]
    taken = len(x)
    if len(x) > 4 * k:
        # at least as many as make chance unlikely to decide between few probes
        taken = max(4 * k, 2 * depth(rough(probes), probes @ x.T.astype(np.float64), k))
    whole = x.astype(np.float64) if 2 * taken >= len(x) else None
    cut = len(x) - min(len(x), k if whole is not None else taken)
    for at in range(0, len(asked), step := max(1, 8_000_000 // len(x))):
        some = asked[at : at + step]
        found = rough(some) if whole is None else some @ whole.T
        for row, own in zip(found, some, strict=True):
            least = np.partition(row, cut)[cut]
            near = np.flatnonzero(row >= least if whole is None else row >= least - 1e-9 * abs(least) - 1e-12)
            exact = (x[near].astype(np.float64) * own).sum(axis=1)
            best = nearest(exact, first[near], k)
            yield near[best], exact[best]


def search(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each query, but for the query itself."""
    spark = rows.sparkSession
    base = written(distinct_vectors(rows, key, vector, k + 1).withColumn("v", F.xxhash64("vector")), "vectors")
    asked = rows.filter(is_query).select(F.col(key).alias("query_id"), F.col(vector).alias("vector")).filter(F.col("query_id").isNotNull()).distinct()
    asked = written(asked.join(base.select("vector", "v"), "vector"), "queries")
    n, q = base.count(), asked.select("v").distinct().count()
    fitted = base.filter(share_of(sample, n, "v")).select("vector", "v").orderBy("v").toPandas()
    sent = spark.sparkContext.broadcast(Codebooks.fit(np.stack(fitted["vector"]))) if len(fitted) else None
    width, kind = (len(fitted["vector"][0]) if len(fitted) else 1), np.dtype("<f8" if "double" in rows.schema[vector].dataType.simpleString() else "<f4")
    # a task has at least PAIRS pairs, if there are so many, and at most BLOCK_BYTES of either side; as square as it goes,
    # because every vector is copied once for each part of the queries and the other way round
    most = max(1, BLOCK_BYTES // (width * kind.itemsize))
    tasks = int(np.clip(n * q // PAIRS, 1, 2 * spark.sparkContext.defaultParallelism))
    side = max(1, min(most, int((n * q / tasks) ** 0.5)))
    turns = max(1, -(-q // side))
    blocks = max(1, -(-n // most), -(-tasks // turns))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.stack([np.asarray(v, kind) for v in part.column(0).to_numpy(zero_copy_only=False)])
                codes = sent.value.encode(x)
                ratio = np.linalg.norm(x.astype(np.float64), axis=1) / np.maximum(np.linalg.norm(sent.value.decode(codes), axis=1), 1e-9)
                columns = [pa.array([r.tobytes() for r in x], pa.binary()), part.column(1), part.column(2), part.column(3), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ratio, pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, names=["vector", "ids", "v", "block", "codes", "ratio"])

    index = base.select("vector", "ids", "v", F.pmod("v", F.lit(blocks)).cast("int").alias("block"))
    index = index.mapInArrow(encode, f"vector binary, ids array<{base.schema['ids'].dataType.elementType.simpleString()}>, v long, block int, codes binary, ratio float")
    index = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    wanted = asked.select("v", "vector").dropDuplicates(["v"]).withColumn("turn", F.pmod(F.xxhash64("v"), F.lit(turns)).cast("int"))
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(queries: pa.Table, block: pa.Table) -> pa.Table:
        names, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if queries.num_rows and block.num_rows:
            v = queries["v"].to_numpy()
            order = np.argsort(v)  # whatever order the shuffle brought, so that a task run again gives the same rows
            every = np.stack(queries["vector"].to_numpy()).astype(np.float64)[order]
            x = np.frombuffer(b"".join(block["vector"].to_pylist()), kind).reshape(block.num_rows, -1)
            codes = np.frombuffer(b"".join(block["codes"].to_pylist()), np.uint8).reshape(block.num_rows, -1)
            lists = block["ids"].combine_chunks()
            first = lists.flatten().to_numpy()[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]])]
            for name, (near, exact) in zip(v[order], meeting(sent.value, every, codes, block["ratio"].to_numpy(), x, first, k + 1), strict=True):
                names.append(np.full(len(near), name))
                places.append(near)
                scores.append(exact)
        return pa.table([pa.array(np.concatenate(names)), pa.array(np.concatenate(scores)), block["ids"].take(pa.array(np.concatenate(places)))], names=["v", "score", "ids"])

    found = wanted.groupBy("block", "turn").cogroup(index.groupBy("block", "turn")).applyInArrow(meet, f"v long, score double, ids {base.schema['ids'].dataType.simpleString()}")
    best = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), F.element_at("ids", 1)))
    found = found.withColumn("place", best).filter(F.col("place") <= k + 1)
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id")))
    lists = found.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("list"))
    own = F.slice(F.filter("list", lambda c: c["id"] != F.col("query_id")), 1, k)
    rows_out = asked.select("query_id", "v").join(lists, "v").select("query_id", F.posexplode(own).alias("at", "c"))
    return rows_out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.minus")).alias("score"))
