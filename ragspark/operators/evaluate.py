"""Ranking metrics and reports over whole runs. Metrics of queries without relevant items are null, not 0."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.text import REFUSAL
from ragspark.operators import spans


def judged(hits: DataFrame, grades: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """hits with the grade of each; 0 where it has none."""
    return hits.join(grades.select(query, item, "grade"), [query, item], "left").fillna(0, ["grade"])


def gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + 1)


def score_queries(queries: DataFrame, hits: DataFrame, grades: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """queries with n_relevant, n_retrieved, recall, reciprocal_rank, dcg, ndcg and hit at k."""
    return score_at(queries, hits, grades, (k,), query, item).drop("k")


def score_at(queries: DataFrame, hits: DataFrame, grades: DataFrame, ks: tuple[int, ...], query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """score_queries for each of several k, told apart by k, in one pass over hits and grades: what is found within each k are
    sums of the same groups."""
    gains = lambda place: F.array(*(F.coalesce(F.sum(F.when(F.col(place) <= k, gain(F.col("grade"), F.col(place)))), F.lit(0.0)) for k in ks))
    ideal = grades.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), item)))
    ideal = ideal.groupBy(query).agg(F.count("*").alias("n_relevant"), gains("_r").alias("_ideals"))
    found = F.col("grade") > 0
    got = judged(hits, grades, query, item).groupBy(query).agg(
        F.count("*").alias("n_retrieved"), F.array(*(F.count_if((F.col("rank") <= k) & found) for k in ks)).alias("_founds"), F.min(F.when(found, F.col("rank"))).alias("_first"), gains("rank").alias("_dcgs"),
    )
    rows = queries.join(ideal, query, "left").join(got, query, "left").fillna(0, ["n_relevant", "n_retrieved"])
    each = F.array(*(F.struct(F.lit(k).alias("k"), *(F.coalesce(F.get(c, F.lit(i)), F.lit(0)).alias(c[:-1]) for c in ("_founds", "_dcgs", "_ideals"))) for i, k in enumerate(ks)))
    rows = rows.select(*queries.columns, "n_relevant", "n_retrieved", "_first", F.explode(each).alias("_e")).select("*", "_e.*").drop("_e")
    given = lambda c: F.when(F.col("n_relevant") > 0, c)
    return rows.withColumns({
        "recall": given(F.col("_found") / F.col("n_relevant")), "reciprocal_rank": given(F.coalesce(1 / F.col("_first"), F.lit(0.0))),
        "dcg": given(F.col("_dcg")), "ndcg": given(F.col("_dcg") / F.col("_ideal")), "hit": given((F.col("_found") > 0).cast("int")),
    }).drop("_found", "_first", "_dcg", "_ideal")


def score_runs(queries: DataFrame, hits: DataFrame, grades: DataFrame, k: int | tuple[int, ...], retrievers: tuple[str, ...], query: str = "query_id", item: str = "chunk_id", retriever: str = "retriever") -> DataFrame:
    """score_queries for the hits of several retrievers at once: a run's query is the pair of both. Several k: as score_at."""
    run = F.struct(retriever, query).alias("_run")
    of_runs = lambda df: df.withColumn(retriever, F.explode(F.array(*map(F.lit, retrievers))))
    score = score_queries if isinstance(k, int) else score_at
    rows = score(of_runs(queries).withColumn("_run", run), hits.select(run, item, "rank"), of_runs(grades).select(run, item, "grade"), k, "_run", item)
    return rows.drop("_run")


def run(queries: DataFrame, hits: DataFrame, labels: DataFrame, docs: DataFrame, chunks: DataFrame, k: int | tuple[int, ...], retrievers: tuple[str, ...]) -> DataFrame:
    """Scores of several retrievers' hits against labelled spans, at one k or several. Labels that don't match the texts are an
    error: nothing is scored against broken anchors."""
    return score_runs(queries, hits, spans.grades(spans.resolve(spans.require_sound(labels, docs), chunks)), k, retrievers)


def summary(scores: DataFrame, by: tuple[str, ...] = ("query_type", "source_type"), retriever: str = "retriever") -> DataFrame:
    """Means over all queries of a retriever, and by each slice, in one pass: (retriever, slice, value, n_queries, ...)."""
    grouped = scores.groupingSets([[F.col(retriever)], *([F.col(retriever), F.col(c)] for c in by)], F.col(retriever), *map(F.col, by))
    metrics = ("recall", "reciprocal_rank", "ndcg")
    out = grouped.agg(F.count("*").alias("n_queries"), *(F.avg(m).alias(m) for m in metrics), F.count_if(~F.col("answerable") & (F.col("n_retrieved") > 0)).alias("n_unanswerable_with_results"), *(F.grouping(c).alias(f"_{c}") for c in by))
    name, value = F.lit("all"), F.lit(None).cast("string")
    for c in by:
        name, value = F.when(F.col(f"_{c}") == 0, c).otherwise(name), F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return out.select(retriever, name.alias("slice"), value.alias("value"), "n_queries", *metrics, "n_unanswerable_with_results")


def by_extraction(hits: DataFrame, grades: DataFrame, chunks: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Share of relevant chunks found within k, by the way their text was extracted."""
    found = hits.filter(F.col("rank") <= k).select(query, item, F.lit(1).alias("_found"))
    rows = grades.join(chunks.select(item, "extraction"), item).join(found, [query, item], "left")
    return rows.groupBy("extraction").agg(F.count("*").alias("n_relevant"), F.avg(F.coalesce("_found", F.lit(0))).alias("recall"))


def essential_recall(resolved: DataFrame, hits: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """By query, the share of spans of grade 2 with a resolved chunk within k."""
    top = hits.filter(F.col("rank") <= k).select(query, item, F.lit(1).alias("_hit"))
    found = resolved.filter("grade = 2").join(top, [query, item], "left").groupBy(query, "doc_id", "char_start", "char_end").agg(F.max(F.coalesce("_hit", F.lit(0))).alias("_hit"))
    return found.groupBy(query).agg(F.count("*").alias("n_spans"), F.avg("_hit").alias("essential_recall"))


def false_answer_rate(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Share of unanswerable queries that were answered instead of refused."""
    refused = F.col(answer) == REFUSAL
    return answers.filter(~F.col("answerable")).agg(F.count("*").alias("n_unanswerable"), F.avg((~refused).cast("int")).alias("false_answer_rate"))


def poisson_steps(most: int = 12) -> list[float]:
    """The chances of at most 0, 1, 2 and so on of a Poisson(1) variable; the rest has a chance of under 1e-9."""
    total, steps, term = 0.0, [], 0.36787944117144233
    for n in range(most):
        total += term
        steps.append(total)
        term /= n + 1
    return steps


def bootstrap(scores: DataFrame, metric: str, replicates: int = 1000, level: float = 0.95, query: str = "query_id", by: str = "retriever") -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean. Each query gets a Poisson(1) weight in each replicate from
    a digest of both, so that results repeat exactly: 8 hexadecimal digits of the MD5 of the query and the replicate's group of four.

    Replicates are an array: a task sums the weighted scores of its rows for all of them, and the sums, a row for each task and
    group, are added in two steps."""
    steps, names, kind = np.array(poisson_steps()), [by, "sums", "weights"], scores.schema[by].dataType.simpleString()

    def draws(name: str) -> np.ndarray:
        digests = b"".join(hashlib.md5(f"{name}|{k}".encode(), usedforsecurity=False).digest() for k in range(-(-replicates // 4)))
        return np.searchsorted(steps, (np.frombuffer(digests, ">u4")[:replicates] + 0.5) / 2**32, "left").astype(float)

    def table(groups: dict) -> pa.RecordBatch:
        columns = [[k for k in groups], [v[0].tobytes() for v in groups.values()], [v[1].tobytes() for v in groups.values()]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], field), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    field = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for batch in batches:
            for group, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, held, w = *groups.setdefault(group, (np.zeros(replicates), np.zeros(replicates))), draws(name)
                total += w * value
                held += w
        if groups:
            yield table(groups)

    def added(rows: pa.Table) -> pa.Table:
        total, held = (np.frombuffer(b"".join(rows[c].to_pylist())).reshape(-1, replicates).sum(axis=0) for c in names[1:])
        return pa.Table.from_batches([table({rows[by][0].as_py(): (total, held)})])

    def interval(rows: pa.Table) -> pa.Table:
        total, held = (np.frombuffer(b"".join(rows[c].to_pylist())).reshape(-1, replicates).sum(axis=0) for c in names[1:])
        low, high = np.quantile(total[held > 0] / held[held > 0], [(1 - level) / 2, (1 + level) / 2])
        return pa.table([pa.array([rows[by][0].as_py()], field), pa.array([low]), pa.array([high])], names=[by, "low", "high"])

    rows = scores.filter(F.col(metric).isNotNull()).select(by, F.col(query).cast("string"), F.col(metric).cast("double"))
    schema = f"`{by}` {kind}, sums binary, weights binary"
    parts = rows.mapInArrow(sums, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    bounds = parts.groupBy(by, "_part").applyInArrow(added, schema).groupBy(by).applyInArrow(interval, f"`{by}` {kind}, low double, high double")
    return scores.groupBy(by).agg(F.avg(metric).alias("mean")).join(bounds, by)


def stratification(queries: DataFrame, targets: DataFrame, points: float = 5.0, by: str = "query_type", split: str = "split") -> DataFrame:
    """(split, by, share, target, drifted) against target shares in percent."""
    counts = queries.groupBy(split, by).agg(F.count("*").alias("n"))
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy(split))
    every = queries.select(split).distinct().crossJoin(targets)  # a row for each split and type, which is the report itself
    rows = every.join(counts.select(split, by, share.alias("share")), [split, by], "left").fillna(0.0, ["share"])
    return rows.withColumn("drifted", F.abs(F.col("share") - F.col("target")) > points)


def judge_agreement(pairs: DataFrame, levels: int = 5, by: str = "answer_tier", human: str = "human_score", judge: str = "judge_score") -> DataFrame:
    """By tier: Spearman's correlation over mean ranks, quadratic-weighted kappa and mean absolute error. Ranks come from
    counts by score, of which there are `levels`, so no tier is sorted as a whole."""
    def ranks(score: str) -> DataFrame:
        counts = pairs.groupBy(by, score).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(by, score, (before + (F.col("_n") + 1) / 2).alias(f"_{score}"), F.col("_n").alias(f"_n_{score}"))

    cells = pairs.groupBy(by, human, judge).agg(F.count("*").alias("n")).join(ranks(human), [by, human]).join(ranks(judge), [by, judge])
    a, b, n = F.col(f"_{human}"), F.col(f"_{judge}"), F.col("n")
    d2 = F.pow(F.col(human) - F.col(judge), 2)
    total = cells.groupBy(by).agg(
        F.sum(n).alias("_t"), F.sum(n * a).alias("_a"), F.sum(n * b).alias("_b"), F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"),
        F.sum(n * d2).alias("_seen"), F.sum(n * F.abs(F.col(human) - F.col(judge))).alias("_off"),
    )
    hs = pairs.groupBy(by, human).agg(F.count("*").alias("_h"))
    js = pairs.groupBy(by, judge).agg(F.count("*").alias("_j"))
    chance = hs.join(js, by).groupBy(by).agg(F.sum(F.col("_h") * F.col("_j") * d2).alias("_chance"))
    t = F.col("_t")
    rho = (t * F.col("_ab") - F.col("_a") * F.col("_b")) / F.sqrt((t * F.col("_aa") - F.col("_a") ** 2) * (t * F.col("_bb") - F.col("_b") ** 2))
    kappa = F.when(F.col("_chance") > 0, 1 - F.col("_seen") * t / F.col("_chance"))
    return total.join(chance, by).select(by, t.alias("n_pairs"), F.round(rho, 9).alias("spearman"), F.round(kappa, 9).alias("kappa"), F.round(F.col("_off") / t, 9).alias("mae"))


def claim_report(claims: DataFrame, citations: DataFrame, must_cite: DataFrame) -> DataFrame:
    """By id: the share of required claims judged present (claims: id, claim, present), and the share of required spans
    that a cited span of the same document overlaps (citations and must_cite: id, doc_id, char_start, char_end)."""
    coverage = claims.groupBy("id").agg(F.count("*").alias("n_claims"), F.avg(F.col("present").cast("int")).alias("claim_coverage"))
    m = must_cite.select("id", "doc_id", F.col("char_start").alias("_a"), F.col("char_end").alias("_b"))
    met = m.join(citations, ["id", "doc_id"], "left").withColumn("_hit", F.coalesce((F.col("char_start") < F.col("_b")) & (F.col("char_end") > F.col("_a")), F.lit(False)))
    cited = met.groupBy("id", "doc_id", "_a", "_b").agg(F.max("_hit").alias("_hit")).groupBy("id").agg(F.avg(F.col("_hit").cast("int")).alias("citation_accuracy"))
    return coverage.join(cited, "id", "full_outer")


def corpus_summary(docs: DataFrame, segments: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_chars, n_segments) by document, and the totals in a row without id."""
    s = segments.groupBy(doc).agg(F.count("*").alias("n_segments"))
    rows = docs.select(doc, F.length(text).cast("long").alias("n_chars")).join(s, doc, "left").fillna(0, ["n_segments"])
    return rows.unionByName(rows.agg(F.sum("n_chars").alias("n_chars"), F.sum("n_segments").alias("n_segments")).withColumn(doc, F.lit(None).cast(docs.schema[doc].dataType)))


def chunk_distribution(chunks: DataFrame, page: str = "page_number") -> DataFrame:
    return chunks.groupBy(page).agg(F.count("*").alias("number_of_chunks"), F.round(F.avg("word_count"), 6).alias("avg_words_per_chunk"))


def size_statistics(chunks: DataFrame, sizes: tuple[str, ...] = ("word_count", "num_sentences", "character_count")) -> DataFrame:
    """One row: count, and of each size the least, greatest and mean; the median of the first. Medians come from counts by
    value."""
    return chunks.agg(F.count("*").alias("n_chunks"), *(f(c).alias(f"{n}_{c}") for c in sizes for n, f in (("min", F.min), ("max", F.max), ("avg", lambda c: F.round(F.avg(c), 6)))), F.median(sizes[0]).alias(f"median_{sizes[0]}"))


def small(rows: DataFrame, below: int, text: str) -> DataFrame:
    """rows with fewer words than this, with n_words."""
    return rows.withColumn("n_words", F.size(tx.words(F.col(text)))).filter(F.col("n_words") < below)


def length_distribution(rows: DataFrame, most: int, text: str = "text") -> DataFrame:
    """One row: count, mean, deviation, quartiles and extremes of word counts, and how many are over `most`."""
    n = rows.select(F.size(tx.words(F.col(text))).alias("n"))
    return n.agg(F.count("*").alias("n_rows"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev("n"), 6).alias("std"), F.min("n").alias("least"), *(F.percentile("n", p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)), F.max("n").alias("greatest"), F.count_if(F.col("n") > most).alias("n_over"))


def cleaning_report(pages: DataFrame, key: str = "page_number", text: str = "text") -> DataFrame:
    """Words and characters of each page before and after cleaning."""
    raw, clean = F.coalesce(F.col(text), F.lit("")), tx.clean_page(F.col(text))
    return pages.select(key, raw.alias("_raw"), clean.alias("_clean")).select(key, F.size(tx.words(F.col("_raw"))).alias("raw_words"), F.length("_raw").alias("raw_chars"), F.size(tx.words(F.col("_clean"))).alias("clean_words"), F.length("_clean").alias("clean_chars"))
