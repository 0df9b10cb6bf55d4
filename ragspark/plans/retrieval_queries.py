"""Retrieval over vectors, passages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.operators import evaluate, retrieve
from ragspark.plans import inputs
from ragspark.plans.inputs import TOKENS, bm25_sql, dense_sql, fuse_sql
from ragspark.plans.registry import Tables, query
from ragspark.sources import index, scratch

HITS = "SELECT query_id, chunk_id, score, rank FROM hits"


def _dense(measure: str, k: int = 10):  # noqa: ANN202
    return lambda t: retrieve.dense_top_k(inputs.vector_queries(t), inputs.vectors(t), k, measure)


def r1_dense_top_k(t: Tables) -> DataFrame:
    return _dense("l2_cosine")(t)


def r3_cosine_top_k(t: Tables) -> DataFrame:
    return _dense("cosine")(t)


def r4_l2_top_k(t: Tables) -> DataFrame:
    return _dense("l2")(t)


def r5_inner_top_k(t: Tables) -> DataFrame:
    return _dense("inner")(t)


for _f, _m in ((r1_dense_top_k, "l2_cosine"), (r3_cosine_top_k, "cosine"), (r4_l2_top_k, "l2"), (r5_inner_top_k, "inner")):
    query(f"WITH {dense_sql(_m, 10, ascending=_m == 'l2')} {HITS}")(_f)


@query("SELECT a.vec_id, b.vec_id AS other_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-10), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def r2_cosine(t: Tables) -> DataFrame:
    """Each vector with the next one."""
    after = t.embeddings.select(F.col("vec_id").alias("other_id"), (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_b"))
    return t.embeddings.select("vec_id", "embedding").join(after, "vec_id").select("vec_id", "other_id", F.round(retrieve.cosine(F.col("embedding"), F.col("_b")), 6).alias("cosine"))


@query(f"WITH {dense_sql('inner', 10)} SELECT query_id, chunk_id, score, rank FROM hits WHERE score >= 0.35")
def r6_threshold(t: Tables) -> DataFrame:
    return retrieve.above(_dense("inner")(t), 0.35)


@query("SELECT vec_id, round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def r7_l2_normalise(t: Tables) -> DataFrame:
    unit = t.embeddings.select("vec_id", retrieve.l2_normalise(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("WITH n AS (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, len(embedding) AS w FROM embeddings) SELECT count(*) AS n_vectors, min(round(n, 6)) AS min_norm, max(round(n, 6)) AS max_norm, round(avg(n), 6) AS avg_norm, count(*) FILTER (w <> 64) AS n_wrong_width FROM n")
def r8_norm_audit(t: Tables) -> DataFrame:
    return retrieve.norm_audit(t.embeddings, 64)


@query(f"WITH {bm25_sql()} {HITS}")
def r9_bm25(t: Tables) -> DataFrame:
    return retrieve.bm25_top_k(inputs.passages(t), inputs.as_chunks(t), stemmed=False)


@query(f"WITH {bm25_sql(stemmed=True)} {HITS}")
def r9_bm25_stemmed(t: Tables) -> DataFrame:
    return retrieve.bm25_top_k(inputs.passages(t), inputs.as_chunks(t))


@query(f"WITH {bm25_sql(stemmed=True)} {HITS}")
def r9_stored_index(t: Tables) -> DataFrame:
    """Search of a stored index, whose documents were drafts with a word more before they were changed to what they are."""
    chunks, held = inputs.as_chunks(t).select("chunk_id", "text"), index.TermIndex(t.spark, scratch.new_path(t.spark, "index"), parts=8)
    drafts = chunks.withColumn("text", F.concat(F.lit("draft "), "text"))
    held.change(drafts)
    held.change(chunks, drafts)
    return held.search(inputs.passages(t))


PHRASES = rf"""docs AS (SELECT doc_id AS chunk_id, {TOKENS.format("text")} AS d FROM documents), st AS (SELECT count(*) AS n, avg(len(d)) AS avg_len FROM docs),
 tok AS (SELECT item_id AS query_id, {TOKENS.format("q")} AS t FROM (SELECT item_id, unnest(regexp_extract_all(regexp_replace(text, '^(\S+) (\S+)', '\1_\2'), '[\p{{L}}\p{{N}}_]+')) AS q FROM benchmark)),
 bag AS (SELECT query_id, t, count(*) AS mult FROM tok WHERE len(t) > 0 GROUP BY ALL), units AS (SELECT DISTINCT t FROM bag),
 places AS (SELECT chunk_id, len(d) AS len, d, unnest(d) AS w, generate_subscripts(d, 1) AS pos FROM docs),
 tf AS (SELECT t, chunk_id, any_value(p.len) AS len, count(*) AS tf FROM units JOIN places p ON t[1] = w AND (len(t) = 1 OR d[pos : pos + len(t) - 1] = t) GROUP BY t, chunk_id),
 df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
 sc AS (SELECT query_id, chunk_id, round(sum(mult * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)))), 9) AS score
  FROM bag JOIN tf USING (t) JOIN df USING (t), st GROUP BY ALL),
 hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sc) WHERE rank <= 5)"""


@query(f"WITH {PHRASES} {HITS}")
def r10_phrases(t: Tables) -> DataFrame:
    """Passages whose first two words are joined by an underscore, which makes them a phrase."""
    joined = t.benchmark.select(F.col("item_id").alias("query_id"), F.regexp_replace("text", r"^(\S+) (\S+)", "$1_$2").alias("text"))
    return retrieve.bm25_top_k(joined, inputs.as_chunks(t), stemmed=False)


@query(rf"WITH tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok GROUP BY term")
def r11_term_statistics(t: Tables) -> DataFrame:
    return retrieve.term_stats(inputs.as_chunks(t), stemmed=False)


@query(rf"WITH tok AS (SELECT doc_id, len({TOKENS.format('text')}) AS len FROM documents) SELECT count(*) AS n, round(avg(len), 6) AS avg_len FROM tok")
def r11_corpus_statistics(t: Tables) -> DataFrame:
    return retrieve.corpus_stats(retrieve.lengths(inputs.as_chunks(t))).select("n", F.round("avg_len", 6).alias("avg_len"))


HALF = "SELECT item_id AS query_id, substr(text, 1, 80) AS text FROM benchmark"


@query(f"WITH {bm25_sql(prefix='whole_', k=40)}, {bm25_sql(HALF, prefix='half_', k=40)}, {fuse_sql(['whole_hits', 'half_hits'], 5)} SELECT query_id, chunk_id, score, rank FROM fhits")
def r12_rank_fusion(t: Tables) -> DataFrame:
    """Rankings by whole passages and by their beginnings."""
    chunks = inputs.as_chunks(t)
    half = inputs.passages(t).withColumn("text", F.substring("text", 1, 80))
    return retrieve.fuse([retrieve.bm25_top_k(q, chunks, 40, stemmed=False) for q in (inputs.passages(t), half)])


HYBRID = f"""{bm25_sql(k=40, prefix='l')}, {dense_sql('l2_cosine', 40, queries='SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id', prefix='d')}, {fuse_sql(['lhits', 'dhits'], 5)}"""


def with_vectors(t: Tables) -> DataFrame:
    """Passages with the vectors of their numbers."""
    return inputs.passages(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def hybrid_hits(t: Tables) -> DataFrame:
    return retrieve.hybrid(with_vectors(t), inputs.as_chunks(t), inputs.vectors(t), stemmed=False)


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, score, rank FROM fhits")
def r13_hybrid(t: Tables) -> DataFrame:
    """A passage's vector is the one with its number."""
    return hybrid_hits(t)


@query(f"""WITH {bm25_sql(k=40, prefix='l', stemmed=True)}, {dense_sql('l2_cosine', 40, queries='SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id', prefix='d')}, {fuse_sql(['lhits', 'dhits'], 5)} SELECT query_id, chunk_id, score, rank FROM fhits""")
def r13_hybrid_stemmed(t: Tables) -> DataFrame:
    return retrieve.hybrid(with_vectors(t), inputs.as_chunks(t), inputs.vectors(t))


FAULTY = """bad AS (SELECT query_id, CASE WHEN kind = 4 AND rank = 2 THEN first ELSE chunk_id END AS chunk_id, CASE WHEN kind = 1 THEN -score ELSE score END AS score, CASE WHEN kind = 2 AND rank > 1 THEN rank + 1 ELSE rank END AS rank FROM
  (SELECT *, query_id // 20 % 5 AS kind, first_value(chunk_id) OVER (PARTITION BY query_id ORDER BY rank) AS first FROM hits) WHERE kind = 3 OR rank <= 10)"""


@query(f"""WITH {dense_sql('inner', 12)}, {FAULTY}, l AS (SELECT *, lag(score) OVER w AS above, lag(chunk_id) OVER w AS id, row_number() OVER w AS pos FROM bad WINDOW w AS (PARTITION BY query_id ORDER BY rank))
 SELECT query_id, fault FROM (SELECT query_id, CASE WHEN score > above THEN 'scores ascend' WHEN score = above AND chunk_id < id THEN 'ties are out of order' WHEN rank <> pos THEN 'ranks have gaps' WHEN pos > 10 THEN 'too many hits' END AS fault FROM l) WHERE fault IS NOT NULL GROUP BY ALL
 UNION ALL SELECT query_id, 'an item stands twice' FROM (SELECT query_id FROM bad GROUP BY query_id, chunk_id HAVING count(*) > 1) GROUP BY query_id""")
def r14_contract_audit(t: Tables) -> DataFrame:
    """Rankings of which four in five have a fault: ascending scores, a gap, hits too many, an item twice."""
    kind, first = F.floor(F.col("query_id") / 20) % 5, F.first("chunk_id").over(Window.partitionBy("query_id").orderBy("rank"))
    hits = _dense("inner", 12)(t).withColumns({"kind": kind, "first": first}).filter("kind = 3 or rank <= 10")
    bad = hits.select(
        "query_id", F.when((F.col("kind") == 4) & (F.col("rank") == 2), F.col("first")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(F.col("kind") == 1, -F.col("score")).otherwise(F.col("score")).alias("score"),
        F.when((F.col("kind") == 2) & (F.col("rank") > 1), F.col("rank") + 1).otherwise(F.col("rank")).alias("rank"),
    )
    return retrieve.contract_faults(bad, 10)


@query(f"WITH {dense_sql('inner', 10)}, t AS (SELECT query_id, max(score) AS top_score FROM hits WHERE chunk_id <> query_id GROUP BY query_id) SELECT vec_id AS query_id, top_score, CASE WHEN top_score IS NULL THEN 'empty' WHEN top_score < 0.45 THEN 'low' ELSE 'ok' END AS confidence FROM embeddings LEFT JOIN t ON query_id = vec_id WHERE vec_id % 20 = 0")
def r15_confidence(t: Tables) -> DataFrame:
    """The score of the nearest other vector."""
    return retrieve.confidence(inputs.vector_queries(t), _dense("inner")(t).filter("chunk_id <> query_id"), 0.45)


@query(f"WITH {bm25_sql()} SELECT query_id, rank, score, chunk_id, substr(text, 1, 300) AS preview FROM hits JOIN documents ON doc_id = chunk_id")
def r16_j3_j4_summary(t: Tables) -> DataFrame:
    hits = retrieve.bm25_top_k(inputs.passages(t), inputs.as_chunks(t), stemmed=False)
    return retrieve.hydrate(hits, inputs.as_chunks(t)).select("query_id", "rank", "score", "chunk_id", tx.preview(F.col("text")).alias("preview"))


@query(f"WITH {bm25_sql(chunks="SELECT doc_id AS chunk_id, text FROM documents WHERE lang = 'en'")} {HITS}")
def r17_filtered(t: Tables) -> DataFrame:
    """English documents only; statistics are those of what is searched."""
    chunks = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.bm25_top_k(inputs.passages(t), chunks, stemmed=False)


@query(f"""WITH {dense_sql('inner', 40)}, r AS (SELECT h.query_id, h.chunk_id, round(h.score + 0.1 * (a.label = b.label)::INT, 9) AS score FROM hits h JOIN embeddings a ON a.vec_id = h.query_id JOIN embeddings b ON b.vec_id = h.chunk_id)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM r) WHERE rank <= 4""")
def r18_rerank(t: Tables) -> DataFrame:
    """A second score that prefers the query's own class."""
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_a"))
    rows = _dense("inner", 40)(t).join(q, "query_id").join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
    out = retrieve.rerank(rows, F.round(F.col("score") + 0.1 * (F.col("_a") == F.col("label")).cast("int"), 9))
    return out.select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {dense_sql('inner', 10, prefix='a')}, {dense_sql('inner', 10, prefix='b', where='q.label = v.label')} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.rank, b.rank) AS rank, a.chunk_id AS left_id, a.score AS left_score, b.chunk_id AS right_id, b.score AS right_score, coalesce(a.chunk_id = b.chunk_id, false) AS same_chunk FROM ahits a FULL OUTER JOIN bhits b ON a.query_id = b.query_id AND a.rank = b.rank")
def j10_side_by_side(t: Tables) -> DataFrame:
    """All vectors against those of the query's class."""
    within = retrieve.dense_top_k(inputs.vector_queries(t), inputs.vectors(t), 10, "inner", within="label")
    return retrieve.side_by_side(_dense("inner")(t), within)


GRADES = "grades AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, (1 + coalesce(l.quality, 0))::INT AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id)"
ASKED = "asked AS (SELECT item_id AS query_id, (CASE WHEN item_id % 2 = 0 THEN 'exact_term' ELSE 'conceptual' END) AS query_type, (CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END) AS source_type, item_id IN (SELECT query_id FROM grades) AS answerable FROM benchmark)"


def grades(t: Tables) -> DataFrame:
    return inputs.spans(t).select("query_id", F.col("doc_id").alias("chunk_id"), "grade")


def _kinds() -> tuple[Column, Column]:
    return F.when(F.col("item_id") % 2 == 0, "exact_term").otherwise("conceptual").alias("query_type"), F.when(F.length("text") > 200, "long").otherwise("short").alias("source_type")


def asked(t: Tables) -> DataFrame:
    some = grades(t).select("query_id").distinct().withColumn("answerable", F.lit(True))
    rows = t.benchmark.select(F.col("item_id").alias("query_id"), *_kinds())
    return rows.join(some, "query_id", "left").fillna(False, ["answerable"])


def scores_sql(hits: str, name: str, k: int = 5, prefix: str = "") -> str:
    p = prefix or name
    return f"""{p}j AS (SELECT h.*, coalesce(g.grade, 0) AS grade FROM {hits} h LEFT JOIN grades g ON g.query_id = h.query_id AND g.chunk_id = h.chunk_id),
 {p}g AS (SELECT query_id, count(*) AS n_retrieved, count(*) FILTER (rank <= {k} AND grade > 0) AS found, min(rank) FILTER (grade > 0) AS first, sum(grade / log2(rank + 1)) FILTER (rank <= {k}) AS dcg FROM {p}j GROUP BY query_id),
 {p}i AS (SELECT query_id, count(*) AS n_relevant, sum(grade / log2(r + 1)) FILTER (r <= {k}) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS r FROM grades) GROUP BY query_id),
 {p}s AS (SELECT '{name}' AS retriever, a.*, coalesce(n_relevant, 0) AS n_relevant, coalesce(n_retrieved, 0) AS n_retrieved, CASE WHEN n_relevant > 0 THEN coalesce(found, 0) / n_relevant END AS recall,
  CASE WHEN n_relevant > 0 THEN coalesce(1 / first, 0) END AS reciprocal_rank, CASE WHEN n_relevant > 0 THEN coalesce(dcg, 0) END AS dcg, CASE WHEN n_relevant > 0 THEN coalesce(dcg, 0) / ideal END AS ndcg, CASE WHEN n_relevant > 0 THEN (coalesce(found, 0) > 0)::INT END AS hit
  FROM asked a LEFT JOIN {p}g g ON g.query_id = a.query_id LEFT JOIN {p}i i ON i.query_id = a.query_id)"""


def run_scores(t: Tables, k: int | tuple[int, ...] = 5) -> DataFrame:
    """Scores of the lexical and the hybrid run, by query, once all labels have been found in the texts."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), *_kinds())
    names = ("lexical", "hybrid")
    hits = retrieve.runs(with_vectors(t), inputs.as_chunks(t), inputs.vectors(t), names, k if isinstance(k, int) else max(k), stemmed=False)
    whole = t.documents.select("doc_id", F.col("doc_id").alias("chunk_id"), F.lit(0).alias("source_start"), F.length("text").alias("source_end"))
    labels = scratch.written(inputs.spans(t), "labels")
    return evaluate.run(q, hits, labels, t.documents, whole, k, names).withColumn("answerable", F.col("n_relevant") > 0)


RUNS = f"{bm25_sql()}, {HYBRID}, {GRADES}, {ASKED}, {scores_sql('hits', 'lexical')}, {scores_sql('fhits', 'hybrid')}, runs AS (SELECT * FROM lexicals UNION ALL SELECT * FROM hybrids)"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"WITH {RUNS} SELECT * REPLACE (round(recall, 9) AS recall, round(reciprocal_rank, 9) AS reciprocal_rank, round(dcg, 9) AS dcg, round(ndcg, 9) AS ndcg) FROM runs")
def a2_a5_query_scores(t: Tables) -> DataFrame:
    return _rounded(run_scores(t), "recall", "reciprocal_rank", "dcg", "ndcg")


AT = (1, 3, 5, 10)


@query(f"""WITH {bm25_sql(k=10)}, {bm25_sql(k=40, prefix='l')}, {dense_sql('l2_cosine', 40, queries='SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id', prefix='d')}, {fuse_sql(['lhits', 'dhits'], 10)}, {GRADES}, {ASKED},
 {", ".join(scores_sql(hits, name, k, f"{name}{k}") for k in AT for hits, name in (("hits", "lexical"), ("fhits", "hybrid")))}
 {" UNION ALL ".join(f"SELECT retriever, {k} AS k, count(*) AS n_queries, round(avg(recall), 9) AS recall, round(avg(reciprocal_rank), 9) AS reciprocal_rank, round(avg(ndcg), 9) AS ndcg, round(avg(hit), 9) AS hit FROM {name}{k}s GROUP BY retriever" for k in AT for name in ("lexical", "hybrid"))}""")
def a2_a7_at_several_k(t: Tables) -> DataFrame:
    """Means of each run at several k, from one pass."""
    out = run_scores(t, AT).groupBy("retriever", "k").agg(F.count("*").alias("n_queries"), *(F.avg(c).alias(c) for c in ("recall", "reciprocal_rank", "ndcg", "hit")))
    return _rounded(out, "recall", "reciprocal_rank", "ndcg", "hit")


SUMMARY = "count(*) AS n_queries, round(avg(recall), 9) AS recall, round(avg(reciprocal_rank), 9) AS reciprocal_rank, round(avg(ndcg), 9) AS ndcg, count(*) FILTER (NOT answerable AND n_retrieved > 0) AS n_unanswerable_with_results FROM runs"


@query(f"WITH {RUNS} SELECT retriever, 'all' AS slice, NULL::VARCHAR AS value, {SUMMARY} GROUP BY ALL UNION ALL SELECT retriever, 'query_type', query_type, {SUMMARY} GROUP BY ALL UNION ALL SELECT retriever, 'source_type', source_type, {SUMMARY} GROUP BY ALL")
def a6_a7_a9_run_summary(t: Tables) -> DataFrame:
    return _rounded(evaluate.summary(run_scores(t)), "recall", "reciprocal_rank", "ndcg")


@query(f"WITH {bm25_sql()}, {GRADES}, c AS (SELECT doc_id AS chunk_id, CASE WHEN length(text) >= 2000 THEN 'text' ELSE 'ocr' END AS extraction FROM documents) SELECT extraction, count(*) AS n_relevant, round(avg((h.chunk_id IS NOT NULL)::INT), 9) AS recall FROM grades g JOIN c ON c.chunk_id = g.chunk_id LEFT JOIN hits h ON h.query_id = g.query_id AND h.chunk_id = g.chunk_id GROUP BY extraction")
def a8_by_extraction(t: Tables) -> DataFrame:
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.when(F.length("text") >= 2000, "text").otherwise("ocr").alias("extraction"))
    hits = retrieve.bm25_top_k(inputs.passages(t), inputs.as_chunks(t), stemmed=False)
    return _rounded(evaluate.by_extraction(hits, grades(t), chunks, 5), "recall")


@query(f"WITH {bm25_sql()}, {GRADES} SELECT g.query_id, count(*) AS n_spans, round(avg((h.chunk_id IS NOT NULL)::INT), 9) AS essential_recall FROM grades g LEFT JOIN hits h ON h.query_id = g.query_id AND h.chunk_id = g.chunk_id WHERE grade = 2 GROUP BY g.query_id")
def a19_essential_recall(t: Tables) -> DataFrame:
    resolved = inputs.spans(t).withColumn("chunk_id", F.col("doc_id"))
    hits = retrieve.bm25_top_k(inputs.passages(t), inputs.as_chunks(t), stemmed=False)
    return _rounded(evaluate.essential_recall(resolved, hits, 5), "essential_recall")


_DRAW = " + ".join(f"(u > {s!r})::INT" for s in evaluate.poisson_steps())


@query(f"""WITH {RUNS}, draws AS (SELECT retriever, ndcg, b, (('0x' || substr(md5(query_id::VARCHAR || '|' || b // 4), b % 4 * 8 + 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM runs, (SELECT unnest(range(1000)) AS b) WHERE ndcg IS NOT NULL),
 means AS (SELECT retriever, b, sum(({_DRAW}) * ndcg) / sum({_DRAW}) AS m FROM draws GROUP BY ALL),
 bounds AS (SELECT retriever, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY retriever)
 SELECT retriever, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT retriever, avg(ndcg) AS mean FROM runs GROUP BY retriever) JOIN bounds USING (retriever)""")
def a21_bootstrap(t: Tables) -> DataFrame:
    return _rounded(evaluate.bootstrap(run_scores(t), "ndcg"), "mean", "low", "high")


@query(f"WITH {dense_sql('inner', 10)} SELECT h.query_id, h.chunk_id, rank, score, (a.label = b.label)::INT AS grade FROM hits h JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id")
def j5_judged_hits(t: Tables) -> DataFrame:
    """Vectors of the query's own class are relevant."""
    hits = _dense("inner")(t)
    own = inputs.vector_queries(t).select("query_id", "label")
    relevant = hits.select("query_id", "chunk_id").join(own, "query_id").join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("_b")), "chunk_id").filter("label = _b").select("query_id", "chunk_id", F.lit(1).alias("grade"))
    return evaluate.judged(hits, relevant)
