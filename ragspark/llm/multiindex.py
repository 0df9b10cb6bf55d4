"""Hard-negative mining with an inverted multi-index.

A vector becomes whole numbers, floor(256 x). It is cut in two halves, each with a codebook of its own, fitted by k-means on a
bounded sample (SAMPLE); the pair of its codes is its cell. A cell knows how far its members' halves lie from the codewords
at most, its radii. So an anchor's product with any member is at most the sum of two half scores: half of the anchor times the codeword,
plus the half's length times the radius. A heap over the two sorted lists of half scores, the multi-sequence walk, gives
cells by falling sums without making all of them; those whose own radii say less are passed over.

A search has two walks. The first goes on until its cells hold FIRST vectors, and what they hold gives a bound: the k-th
best score found. The second goes on until the sum falls below that bound, where no cell left can hold a better vector, so what it finds is
exact. Positives, the best vectors of the anchor's label, are searched first; their scores open windows for vectors of other
labels, and the walk for negatives ends when every window of an anchor is certified: its third best score, or the window's
lower end where fewer were found, lies above the sum of all cells left.

Cells are dealt to tasks in runs of neighbours; a cell with more members than a task holds is split. In a task the anchors that
visit a cell meet its members in one matrix product, of which only the best for each anchor or window leave it. Equal vectors of
a label are one member with its smallest ids, so a vector that a third of all rows share is searched, and asked, once.

The codebooks and the table of cells are bounded (CODES) and sent to all tasks; anchors and members are not.

Defined results: rows with a null id, label or vector, with null or non-finite components, or with another width than most
take no part; rows that repeat an id with its label and vector count once; ties go to smaller ids; an anchor without positives, or a
positive without negatives, has no rows; an empty table gives none. Components whose products leave 63 bits are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.shared import share_of, written

SCALE, SAMPLE, ROUNDS = 256, 12_000, 8
#: Codewords of a half at most, and members of a cell that are aimed at.
CODES, MEMBERS = 256, 64
#: Members that the first walk of a search sees at least; members of a task, and products that it holds at once.
FIRST, TASK, AT_ONCE = 2_000, 1 << 16, 4_000_000
#: What stands for the product of an anchor with a member whose cell it does not visit.
NOT_SEEN = np.iinfo(np.int64).min


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def members(rows: DataFrame, key: str, vector: str, label: Column, ids: int) -> DataFrame:
    """(x, label, ids): distinct vectors of whole numbers with their smallest ids. Ids are cut in two steps, so that a vector
    that very many rows share is no task's alone."""
    fine = rows.select(F.col(key).alias("id"), label.alias("label"), F.col(vector).alias("x")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")))
    width = fine.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    fine = fine.filter(F.size("x") == (width["n"] if width else 0)).withColumn("x", whole_numbers(F.col("x")))
    part = fine.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).repartition("x", "label", "part").distinct()
    for by in (("x", "label", "part"), ("x", "label")):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        part = part.withColumn("place", place).filter(F.col("place") <= ids).drop("place")
    return part.groupBy("x", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def k_means(x: np.ndarray, codes: int) -> np.ndarray:
    random = np.random.default_rng(5)
    centres = x[random.choice(len(x), codes, replace=len(x) < codes)].astype(np.float64)
    for _ in range(ROUNDS):
        near = nearest_code(x, centres)
        n = np.bincount(near, minlength=codes)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_code(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(part @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1) for part in np.array_split(x, max(1, -(-len(x) // 8192)))])


@dataclass
class Cells:
    """Codebooks of both halves; for each cell that has members its codes, radii, count, first task and number of tasks."""

    books: tuple[np.ndarray, np.ndarray]
    codes: np.ndarray  # cell, half
    radii: np.ndarray  # cell, half
    count: np.ndarray
    task: np.ndarray
    parts: np.ndarray

    def __post_init__(self) -> None:
        self.at = np.full([len(b) for b in self.books], -1)
        self.at[self.codes[:, 0], self.codes[:, 1]] = np.arange(len(self.codes))
        # the greatest radius of a codeword's cells bounds all of them, which the walk needs before it knows the other code
        self.far = [np.zeros(len(b)) for b in self.books]
        for h in (0, 1):
            np.maximum.at(self.far[h], self.codes[:, h], self.radii[:, h])

    @property
    def half(self) -> int:
        return self.books[0].shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., : self.half], x[..., self.half :]

    def walk(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(sum, cell) by falling sums of half scores: no member of this or a later cell has a greater product than the sum."""
        pair = self.halves(query.astype(np.float64))
        length = [np.sqrt((q**2).sum()) for q in pair]
        scores = [b @ q + n * r for b, q, n, r in zip(self.books, pair, length, self.far, strict=True)]
        order = [np.argsort(-s, kind="stable") for s in scores]
        a, b = (s[o] for s, o in zip(scores, order, strict=True))
        slack = 1e-9 * (1 + length[0] + length[1]) * (1 + max(np.abs(a).max(), np.abs(b).max()))
        a, b, grid = a.tolist(), b.tolist(), self.at[np.ix_(order[0], order[1])].tolist()
        heap, next_of = [(-(a[0] + b[0]), 0, 0)], [0] * len(a)
        while heap:
            minus, i, j = heapq.heappop(heap)
            if grid[i][j] >= 0:
                yield slack - minus, grid[i][j]
            # row i goes on to its next column; the first visit of a row opens the next row
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def own_bounds(self, query: np.ndarray) -> np.ndarray:
        """The bound of each cell by its own radii."""
        pair = self.halves(query.astype(np.float64))
        parts = [(b @ q)[self.codes[:, h]] + np.sqrt((q**2).sum()) * self.radii[:, h] for h, (b, q) in enumerate(zip(self.books, pair, strict=True))]
        return (parts[0] + parts[1]) * (1 + 1e-9) + 1e-6 * (1 + np.abs(parts[0]) + np.abs(parts[1]))

    def visited(self, query: np.ndarray, least: float | None, first: int = FIRST) -> list[int]:
        """The cells of the first walk (least is None), or of the one that ends where sums fall below least."""
        out, seen, own = [], 0, self.own_bounds(query) if least is not None else None
        for bound, cell in self.walk(query):
            if least is None:
                if seen >= first:
                    break
                seen += int(self.count[cell])
            elif bound < least:
                break
            elif own[cell] < least:
                continue
            out.append(cell)
        return out


def products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products: by floating point where that is exact, else in 64 bits."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if most < 1 << 53:
        return (queries.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("inner products of these vectors leave 63 bits")
    return queries @ x.T


def best(scores: np.ndarray, allowed: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the columns of its k greatest allowed scores; equal ones by these columns' first ids."""
    scores = np.where(allowed, scores, NOT_SEEN)
    n = scores.shape[1]
    least = np.partition(scores, n - min(k, n), axis=1)[:, n - min(k, n)]
    for r, row in enumerate(scores):
        near = np.flatnonzero((row >= least[r]) & (row > NOT_SEEN))
        if len(near):
            yield r, near[np.lexsort((first[near], -row[near]))[:k]]


def fitted(base: DataFrame, n: int, sample: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Codebooks of both halves; None where no vector is of use."""
    rows = base.filter(share_of(sample, n, "v")).select("x", "v").orderBy("v").toPandas()
    if not len(rows):
        rows = base.select("x", "v").orderBy("v").limit(1).toPandas()
    if not len(rows):
        return None
    x = np.stack(rows["x"]).astype(np.float64)
    codes = int(np.clip(round((n / MEMBERS) ** 0.5), 1, CODES))
    half = (x.shape[1] + 1) // 2
    return k_means(x[:, :half], codes), k_means(x[:, half:], codes)


def cells_of(coded: DataFrame, books: tuple[np.ndarray, np.ndarray], most: int) -> Cells:
    """The table of cells: at most one row for each pair of codes, whatever the corpus holds."""
    table = coded.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).orderBy("i", "j").toPandas()
    count = table["n"].to_numpy(np.int64)
    parts = np.maximum(1, -(-count // most))
    task, at, held = np.zeros(len(count), np.int64), -1, most
    for c, (n, p) in enumerate(zip(count.tolist(), parts.tolist(), strict=True)):
        if p > 1 or held + n > most:
            at, held = at + 1, 0
        task[c] = at
        held += n
        if p > 1:
            at, held = at + p - 1, most
    return Cells(books, table[["i", "j"]].to_numpy(np.int64), table[["r", "s"]].to_numpy(np.float64), count, task, parts)


Find = Callable[[np.ndarray, np.ndarray, np.ndarray, dict, pa.Array], Iterator[tuple]]


class Index:
    """Vectors of whole numbers by cells, in a written table."""

    def __init__(self, base: DataFrame, sample: int = SAMPLE):
        self.spark, n = base.sparkSession, base.count()
        books = fitted(base, n, sample)
        self.empty = books is None
        if self.empty:
            return
        half, cores = books[0].shape[1], self.spark.sparkContext.defaultParallelism
        sent = self.spark.sparkContext.broadcast(books)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
                    pair = x[:, :half].astype(np.float64), x[:, half:].astype(np.float64)
                    codes = [nearest_code(h, b) for h, b in zip(pair, sent.value, strict=True)]
                    radii = [np.sqrt(((h - b[c]) ** 2).sum(axis=1)) for h, b, c in zip(pair, sent.value, codes, strict=True)]
                    columns = [part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), *part.columns[2:], pa.array(codes[0], pa.int32()), pa.array(codes[1], pa.int32()), *(pa.array(r) for r in radii)]
                    yield pa.RecordBatch.from_arrays(columns, names=["v", "x", "label", "ids", "i", "j", "r", "s"])

        ids = base.schema["ids"].dataType.simpleString()
        schema = f"v long, x binary, label {base.schema['label'].dataType.simpleString()}, ids {ids}, i int, j int, r double, s double"
        self.ids, self.label = ids, base.schema["label"].dataType.simpleString()
        self.coded = written(base.select("v", "x", "label", "ids").mapInArrow(encode, schema), "coded")
        # so many members for a task that all cores have some, within what a task holds
        cells = cells_of(self.coded, books, max(256, min(TASK, -(-n // (2 * cores)))))
        self.cells = self.spark.sparkContext.broadcast(cells)
        where = self.spark.createDataFrame([(*map(int, c), k, int(t), int(p)) for k, (c, t, p) in enumerate(zip(cells.codes, cells.task, cells.parts, strict=True))], "i int, j int, cell int, task int, parts int")
        placed = self.coded.join(F.broadcast(where), ["i", "j"])
        self.placed = placed.select("v", "x", "label", "ids", "cell", (F.col("task") + F.pmod("v", "parts")).cast("int").alias("task"))

    def visits(self, asked: DataFrame, first: bool) -> DataFrame:
        """asked (v, x, label, least, ...) with a row for each task that the walk visits: the task and the cells there."""
        sent, names = self.cells, asked.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = sent.value
            for batch in batches:
                rows, tasks, lists = [], [], []
                least = batch.column(names.index("least")).to_pylist()
                for k, (x, bound) in enumerate(zip(batch.column(names.index("x")).to_pylist(), least, strict=True)):
                    found = np.array(cells.visited(np.frombuffer(x, np.int64), None if first else float("-inf") if bound is None else float(bound)), np.int64)
                    # a split cell is visited in each of its tasks
                    parts = cells.parts[found]
                    of = np.repeat(found, parts)
                    to = np.repeat(cells.task[found], parts) + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                    order = np.argsort(to, kind="stable")
                    for t, some in zip(*_runs(to[order], of[order]), strict=True):
                        rows.append(k)
                        tasks.append(t)
                        lists.append(some)
                out = pa.Table.from_batches([batch]).take(pa.array(rows, pa.int64()))
                out = out.append_column("task", pa.array(tasks, pa.int32())).append_column("cells", pa.array(lists, pa.list_(pa.int32())))
                yield from out.combine_chunks().to_batches()

        return asked.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in asked.schema)}, task int, cells array<int>")

    def meet(self, asked: DataFrame, first: bool, find: Find, schema: str) -> DataFrame:
        """What find yields where anchors meet the members of the cells that they visit. find takes the products of some anchors
        with a task's members (NOT_SEEN in other cells), these members' labels and first ids, the anchors' columns as
        lists and the members' ids. Anchors of a task are dealt into turns, so that it holds no more of them than members."""
        names = [f.split(" ")[0] for f in schema.split(", ")]
        turns = max(1, -(-asked.count() // TASK))

        def run(queries: pa.Table, block: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if queries.num_rows and block.num_rows:
                block = block.sort_by("cell")
                x = np.frombuffer(b"".join(block["x"].to_pylist()), np.int64).reshape(block.num_rows, -1)
                lists = block["ids"].combine_chunks()
                first = lists.flatten().to_numpy()[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]])]
                cell, labels = block["cell"].to_numpy(), block["label"].to_numpy()
                queries = queries.sort_by("v")  # whatever order the shuffle brought, so that a task run again gives the same rows
                columns = {c: queries[c].to_pylist() for c in queries.column_names if c not in ("x", "cells")}
                every = np.frombuffer(b"".join(queries["x"].to_pylist()), np.int64).reshape(queries.num_rows, -1)
                visits = queries["cells"].combine_chunks()
                who, to = np.repeat(np.arange(queries.num_rows), pc.list_value_length(visits).to_numpy()), visits.flatten().to_numpy()
                for at in range(0, queries.num_rows, step := max(1, AT_ONCE // block.num_rows)):
                    scores = np.full((min(step, queries.num_rows - at), block.num_rows), NOT_SEEN)
                    some = np.flatnonzero((who >= at) & (who < at + step))
                    some = some[np.argsort(to[some], kind="stable")]
                    for c, rows in zip(*_runs(to[some], who[some]), strict=True):
                        begin, end = np.searchsorted(cell, [c, c + 1])  # none, if a split cell's members fell into other tasks
                        scores[rows - at, begin:end] = products(every[rows], x[begin:end])
                    out += find(scores, labels, first, {n: v[at : at + step] for n, v in columns.items()}, lists)
            return pa.table(list(map(list, zip(*out, strict=True))) if out else [[] for _ in names], names=names).cast(target)

        target = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in self.spark.createDataFrame([], schema).schema])
        dealt = self.visits(asked, first).withColumn("turn", F.pmod(F.xxhash64("v"), F.lit(turns)).cast("int"))
        placed = self.placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        return dealt.groupBy("task", "turn").cogroup(placed.groupBy("task", "turn")).applyInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "string": pa.string()}
    return pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Sorted keys, each once, with their values."""
    if not len(keys):
        return [], []
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins].tolist(), np.split(values, begins[1:])


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best
    vectors of the same label, the first vectors of other labels whose scores lie from low to high per cent of the positive's."""
    own_label = F.col(label) if isinstance(label, str) else label
    kind = rows.schema[key].dataType.simpleString()
    base = members(rows, key, vector, own_label, max(positives + 1, negatives))
    base = written(base.withColumn("v", F.monotonically_increasing_id()), "members")
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    index = Index(base, sample)
    if index.empty:
        return rows.sparkSession.createDataFrame([], schema)
    anchors = rows.filter(is_anchor).select(F.col(key).alias("anchor_id"), own_label.alias("label"), F.col(vector).alias("x"))
    anchors = anchors.filter(F.col("anchor_id").isNotNull() & usable(F.col("x"))).withColumn("x", whole_numbers(F.col("x"))).distinct()
    anchors = written(anchors.join(base.select("x", "label", "v"), ["x", "label"]).select("anchor_id", "v"), "anchors")
    asked = index.coded.join(anchors.select("v").distinct(), "v").select("v", "x", "label")

    top = positives + 1

    def same_label(scores: np.ndarray, labels: np.ndarray, first: np.ndarray, anchors: dict, ids: pa.Array) -> Iterator[tuple]:
        for r, near in best(scores, labels[None, :] == np.array(anchors["label"])[:, None], first, top):
            yield from ((anchors["v"][r], int(scores[r, m]), ids[m].as_py()) for m in near)

    def best_of(found: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
        """The k best ids of each group; every vector has as many ids as can be among them."""
        rows = found.select(*by, "score", F.explode("ids").alias("id"))
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k)

    hits = f"v long, score long, ids {index.ids}"
    begun = best_of(index.meet(asked.withColumn("least", F.lit(None).cast("long")), True, same_label, hits), ("v",), top)
    # the walk must go on to the top-th best id; where the first found fewer there is no bound
    least = begun.groupBy("v").agg(F.when(F.count("*") >= top, F.min("score")).alias("least"))
    sure = asked.join(least, "v", "left")
    near = written(best_of(index.meet(sure, False, same_label, hits), ("v",), top).select("v", "score", "id", "place"), "near")
    each = near.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("anchor_id")), 1, positives)
    pairs = anchors.join(each, "v").select("v", "anchor_id", F.explode(others).alias("p"))
    pairs = written(pairs.select("v", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")), "pairs")

    # a window in whole numbers: from the first one that is not below low per cent to the last that is not above high per cent
    hundredths = lambda n: ((n - F.pmod(n, F.lit(100))) / 100).cast("long")  # noqa: E731  rounded down
    score = F.col("positive_score")
    windows = pairs.select("v", "positive_score").distinct()
    windows = windows.select("v", "positive_score", (-hundredths(score * -low)).alias("from_"), hundredths(score * high).alias("to")).filter("from_ <= to")
    windows = windows.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("positive_score", "from_", "to"))).alias("w"))
    windows = windows.select("v", *(F.col(f"w.{c}").alias(c) for c in ("positive_score", "from_", "to")))
    searched = asked.join(windows, "v")

    def in_windows(scores: np.ndarray, labels: np.ndarray, first: np.ndarray, anchors: dict, ids: pa.Array) -> Iterator[tuple]:
        other = labels[None, :] != np.array(anchors["label"])[:, None]
        for k in range(max(map(len, anchors["from_"]))):
            has = [r for r, w in enumerate(anchors["from_"]) if len(w) > k]
            from_, to = (np.array([anchors[c][r][k] for r in has])[:, None] for c in ("from_", "to"))
            part = scores[has]
            for r, near in best(part, other[has] & (part >= from_) & (part <= to), first, negatives):
                a = has[r]
                yield from ((anchors["v"][a], anchors["positive_score"][a][k], int(part[r, m]), ids[m].as_py()) for m in near)

    hits = f"v long, positive_score long, score long, ids {index.ids}"
    begun = best_of(index.meet(searched.withColumn("least", F.lit(None).cast("long")), True, in_windows, hits), ("v", "positive_score"), negatives)
    third = begun.groupBy("v", "positive_score").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("third"))
    each = searched.select("v", F.explode(F.arrays_zip("positive_score", "from_")).alias("w")).select("v", "w.*")
    least = each.join(third, ["v", "positive_score"], "left").groupBy("v").agg(F.min(F.coalesce("third", "from_")).alias("least"))
    sure = searched.join(least, "v")
    found = best_of(index.meet(sure, False, in_windows, hits), ("v", "positive_score"), negatives)
    lists = found.groupBy("v", "positive_score").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("n"))
    out = pairs.join(lists, ["v", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.explode("n").alias("n"))
    return out.select("anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), "n.negative_id", "positive_score", "n.negative_score")
