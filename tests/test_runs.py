"""Runs over several retrievers, index statistics, dense ids and short passages against plain Python."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.stem import porter
from ragspark.operators import chunk, retrieve
from ragspark.plans import inputs
from ragspark.plans.registry import Tables
from ragspark.sources import corpus, scratch


@pytest.fixture(scope="module")
def chunks(spark):
    r = np.random.default_rng(0)
    words = "networks network softmax scaling scaled attention normal normalization d_k dot products".split()
    return spark.createDataFrame([(i, " ".join(r.choice(words, int(r.integers(0, 30))))) for i in range(80)], "chunk_id long, text string")


def test_runs_keep_the_order_of_their_arms(spark, chunks):
    r = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(80)], "chunk_id long, embedding array<double>")
    asked = [(0, "softmax d_k", [1.0, 0.0, 0.0, 0.0]), (1, "scaling of the networks networks", None), (2, "?!", [0.0, 1.0, 0.0, 0.0])]
    queries = spark.createDataFrame(asked, "query_id long, text string, embedding array<double>")
    got = {}
    for h in retrieve.runs(queries, chunks, vectors).collect():
        got.setdefault((h["retriever"], h["query_id"]), {})[h["rank"]] = h["chunk_id"]
    arms = {"lexical": retrieve.bm25_top_k(queries, chunks, 40), "dense": retrieve.dense_top_k(queries.filter("embedding is not null"), vectors, 40)}
    ranks = {}
    for name, hits in arms.items():
        for h in hits.collect():
            ranks.setdefault((name, h["query_id"]), {})[h["chunk_id"]] = h["rank"]
    assert set(got) == {("lexical", 0), ("lexical", 1), ("dense", 0), ("dense", 2), ("hybrid", 0), ("hybrid", 1), ("hybrid", 2)}
    for (name, q), found in got.items():
        own = [ranks.get((a, q), {}) for a in (("lexical", "dense") if name == "hybrid" else (name,))]
        score = {c: round(sum(1 / (60 + x[c]) for x in own if c in x), 12) for x in own for c in x}
        assert [found[k] for k in sorted(found)] == sorted(score, key=lambda c: (-score[c], c))[:5]


def test_term_statistics(spark, chunks):
    for stemmed in (False, True):
        df, tf = {}, {}
        for r in chunks.collect():
            terms = [porter(t) if stemmed else t for t in re.findall("[a-z]+", r["text"].replace("_", " "))]
            for t in terms:
                tf[t] = tf.get(t, 0) + 1
            for t in set(terms):
                df[t] = df.get(t, 0) + 1
        assert {r["term"]: (r["df"], r["tf"]) for r in retrieve.term_stats(chunks, stemmed).collect()} == {t: (df[t], tf[t]) for t in tf}
    assert {r["chunk_id"]: r["len"] for r in retrieve.lengths(chunks).collect()} == {r["chunk_id"]: len(re.findall("[a-z]+", r["text"].replace("_", " "))) for r in chunks.collect()}


def test_dense_search_within_a_class(spark):
    x = np.random.default_rng(2).normal(size=(200, 6))
    rows = [(i, v.tolist(), i % 7 if i < 150 else 0) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, label int")
    queries = vectors.filter("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for h in retrieve.dense_top_k(queries, vectors, 5, "inner", within="label").collect():
        got.setdefault(h["query_id"], {})[h["rank"]] = h["chunk_id"]
    for q in range(0, 200, 9):
        same = [i for i in range(200) if rows[i][2] == rows[q][2]]
        assert [got[q][k] for k in range(1, 6)] == sorted(same, key=lambda i: (-round(float(x[q] @ x[i]), 9), i))[:5]


def test_dense_ids_follow_the_order(spark):
    rows = [(f"d{i % 97:03d}" if i % 97 else None, i // 97) for i in range(97 * 3)]
    df = spark.createDataFrame(rows, "doc_id string, ordinal int").repartition(5)
    got = {(r["doc_id"], r["ordinal"]): r["chunk_id"] for r in chunk.with_ids(df, exact=True, parts=10).collect()}
    assert got == {x: n for n, x in enumerate(sorted(rows, key=lambda x: (x[0] or "", x[1])), 1)}
    assert chunk.with_ids(df.limit(0), exact=True).count() == 0


def test_faults_of_chunks(spark):
    docs = spark.createDataFrame([(1, " one two  three "), (2, "x")], "doc_id long, text string")
    rows = [(1, 0, "one", 1, 4), (1, 1, "two", 5, 8), (1, 2, "three", 10, 15), (2, 0, "x", 0, 1)]
    sound = spark.createDataFrame(rows, "doc_id long, ordinal int, text string, source_start int, source_end int")
    assert chunk.chunk_faults(sound, docs).count() == 0
    found = lambda df: {(r["doc_id"], r["ordinal"], r["fault"]) for r in chunk.chunk_faults(df, docs).collect()}
    assert found(sound.filter("ordinal <> 1")) == {(1, 2, "ordinals are not dense")}
    assert found(sound.withColumn("text", F.upper("text"))) == {(d, n, "text differs from its slice") for d, n, *_ in rows}
    assert found(sound.filter("ordinal < 2")) == {(1, 1, "the end is left out")}
    assert found(sound.filter("ordinal > 0").withColumn("ordinal", F.col("ordinal") - 1)) == {(1, 0, "the beginning is left out")}


def test_sentences_keep_their_text(spark):
    text = "See Fig. 2 and e.g. Smith et al. There it is! Dr. Who <DOT> came. (Yes) no? [A] \"b\" vs. C"
    got = spark.createDataFrame([(text,), (None,), (" ",)], "t string").select(tx.sentences(F.col("t"))).collect()
    assert [r[0] for r in got] == [["See Fig. 2 and e.g. Smith et al. There it is!", "Dr. Who <DOT> came.", "(Yes) no?", '[A] "b" vs. C'], [], []]


def test_short_passages_are_found(spark, tmp_path):
    texts = ["alpha beta gamma delta epsilon zeta eta", "beta gam", "", "xalpha betay", "no"]
    passages = ["alpha beta", "gam", "alpha beta gamma delta epsilon zeta", "missing", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["query_id"], r["doc_id"], r["char_start"], r["grade"]) for r in inputs.spans(inputs.Tables(spark, str(tmp_path))).collect()}
    assert got == {(i, d, t.index(p), 1 + (d == 0)) for i, p in enumerate(passages) if p for d, t in enumerate(texts) if p in t}


def test_data_sets_count_what_they_write(spark, tmp_path):
    rows = spark.createDataFrame([("ret-0001", "q", True), ("ret-0002", "r\nx", False)], "id string, query string, answerable boolean")
    assert corpus.write_dataset(rows, f"{tmp_path}/d") == 2
    read, problems = corpus.read_dataset(spark, f"{tmp_path}/d")
    assert {(r["id"], r["query"]) for r in read.collect()} == {("ret-0001", "q"), ("ret-0002", "r\nx")} and problems.count() == 0


def test_dense_search_meets_in_many_partitions(spark):
    """Blocks of both sides land in one task by the type of their keys too, which one coalesced partition would hide."""
    x = np.random.default_rng(3).normal(size=(60, 4))
    vectors = spark.createDataFrame([(i, v.tolist(), i % 3 if i % 10 else None) for i, v in enumerate(x)], "chunk_id long, embedding array<double>, label int")
    queries = vectors.filter("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        every = retrieve.dense_top_k(queries, vectors, 4, "inner").collect()
        own = retrieve.dense_top_k(queries, vectors, 4, "inner", within="label").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for hits, labels in ((every, [0] * 60), (own, [i % 3 if i % 10 else None for i in range(60)])):
        got = {(h["query_id"], h["rank"]): h["chunk_id"] for h in hits}
        wanted = {}
        for q in range(0, 60, 5):
            some = [i for i in range(60) if labels[q] is not None and labels[i] == labels[q]]
            wanted |= {(q, r): i for r, i in enumerate(sorted(some, key=lambda i: (-round(float(x[q] @ x[i]), 9), i))[:4], 1)}
        assert got == wanted


def test_phrases_gather_no_places(spark, monkeypatch):
    """Unstemmed phrases are runs of words, one more term each; joining the places of their words would bring those of a common word together."""
    monkeypatch.setattr(retrieve, "phrase_counts", None)
    texts = ["a b c", "a b a b", "c b a", "a", "", "x a a b c a b c", "b c"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = {0: "a_b", 1: "a_b_c", 2: "c_b_a x", 3: "q_a"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = {}
    for h in retrieve.bm25_top_k(queries, chunks, 10, stemmed=False).collect():
        got.setdefault(h["query_id"], set()).add(h["chunk_id"])
    assert got == {0: {0, 1, 5}, 1: {0, 5}, 2: {2, 5}}


def test_texts_are_not_shuffled_to_meet_few_hits(spark):
    chunks = spark.range(50).selectExpr("id as chunk_id", "'a text' as text")
    hits = spark.range(5).selectExpr("id as query_id", "id * 7 as chunk_id", "1.0d as score", "1 as rank")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = retrieve.hydrate(hits, chunks)
        assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.chunk_id for r in met.collect()) == [0, 7, 14, 21, 28]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_are_counted_where_texts_are_read(spark):
    texts = [(1, "Café cafe d'été, the the ﬁne"), (2, ""), (3, None), (4, "RUNS running run d_k 文字 x²")]
    tokens = spark.createDataFrame(texts, "chunk_id long, text string").select("chunk_id", tx.spaced_tokens(F.col("text")).alias("_s"))
    met = retrieve.words_of_chunks(tokens, {"cafe": "cafe", "running": "run", "runs": "run", "run": "run", "ete": "ete", "d k": "d k"}, (2,))
    assert sorted((r.chunk_id, r.len, r.word, r.tf) for r in met.collect()) == [
        (1, 7, "", 1), (1, 7, "cafe", 2), (1, 7, "ete", 1), (2, 0, "", 1), (3, 0, "", 1), (4, 7, "", 1), (4, 7, "d k", 1), (4, 7, "run", 3),
    ]
    every = retrieve.words_of_chunks(tokens, empty=False).groupBy("chunk_id", "word").agg(F.sum("tf").alias("n"))
    listed = spark.createDataFrame(texts, "chunk_id long, text string").select("chunk_id", F.explode(tx.index_tokens(F.col("text"))).alias("word"))
    assert sorted(every.collect()) == sorted(listed.groupBy("chunk_id", "word").count().collect())


@pytest.mark.parametrize("stemmed", [False, True])
def test_chunks_that_share_a_key_and_many_words_give_the_same_hits(spark, monkeypatch, stemmed):
    chunks = spark.createDataFrame([(1, "runs running the"), (1, "runs café here"), (2, "run d_k the"), (3, "the other")], "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "running the café"), (8, "run d_k")], "query_id long, text string")
    few = sorted(map(tuple, retrieve.bm25_top_k(asked, chunks, stemmed=stemmed).collect()))
    monkeypatch.setattr(retrieve, "WORDS", 0)
    assert sorted(map(tuple, retrieve.bm25_top_k(asked, chunks, stemmed=stemmed).collect())) == few and few


def test_places_of_passages_are_found_once_for_all_that_ask(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "x one two three four five six y"), (2, "one  two\nthree four five six"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "one two three four five six"), (6, "six y"), (7, "absent words that no text has at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    few = inputs.spans(Tables(spark, str(tmp_path)))
    assert "Generate" not in few._jdf.queryExecution().executedPlan().toString()  # what is asked several times reads found places, not texts
    want = [(5, 1, 2, 29, "one two three four five six", 2), (6, 1, 26, 31, "six y", 2)]
    assert sorted(map(tuple, few.collect())) == want
    monkeypatch.setattr(scratch, "FEW", 0)
    assert sorted(map(tuple, inputs.spans(Tables(spark, str(tmp_path))).collect())) == want


def test_words_of_stems_are_found_in_one_pass(spark, monkeypatch):
    """Few stems are told where texts are read; no vocabulary is gathered, shuffled and stemmed before."""
    from ragspark.functions.stem import porter, words_of

    words = ["runs", "running", "run", "rye", "ays", "ies", "aed", "eying", "any", "relational", "relate", "is", "", "x1", "flies", "fly", "dying"]
    for stems in ({"run", "relat", "fli"}, {"i", "a", "ai"}, {porter(w) for w in words}):
        assert words_of(stems)(words) == {w: porter(w) for w in words if porter(w) in stems}
    monkeypatch.setattr(retrieve, "vocabulary", None)
    chunks = spark.createDataFrame([(1, "runs running the"), (2, "café flies"), (3, "run_fly other")], "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "runner ran running"), (8, "cafe fly"), (9, "runs_fly")], "query_id long, text string")
    hits = {(h["query_id"], h["chunk_id"]) for h in retrieve.bm25_top_k(asked, chunks).collect()}
    assert hits == {(7, 1), (7, 3), (8, 2), (8, 3), (9, 3)}


@pytest.mark.parametrize("measure", ["inner", "cosine", "l2", "l2_cosine"])
def test_dense_search_scores_as_its_sql(spark, measure):
    """Scores of components in steps of 1/128 lie on halves of the last place, which numpy and SQL round to different sides; copies tie."""
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(300, 6)) * 16) / 128
    x = np.concatenate([x, x[:100], r.normal(size=(200, 6)) / 8, np.zeros((1, 6))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    queries = vectors.filter("chunk_id % 4 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {tuple(h) for h in retrieve.dense_top_k(queries, vectors, 20, measure).select("query_id", "chunk_id", "score", "rank").collect()}
    with duckdb.connect() as c:
        c.execute("CREATE TABLE v (id BIGINT, embedding DOUBLE[])")
        c.executemany("INSERT INTO v VALUES (?, ?)", [(i, v.tolist()) for i, v in enumerate(x)])
        sql = inputs.dense_sql(measure, 20, "SELECT id AS query_id, embedding FROM v WHERE id % 4 = 0", "SELECT id AS chunk_id, embedding FROM v", ascending=measure == "l2")
        assert got == set(c.sql(f"WITH {sql} SELECT query_id, chunk_id, score, rank FROM hits").fetchall())
