import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import answers, evaluate, lifecycle, ports, validate
from ragspark.sources.store import Store
from ragspark.streaming import ingest


def scores(spark, retrieved, relevant, k=5):
    q = spark.createDataFrame([(1,)], "query_id int")
    hits = spark.createDataFrame([(1, c, n + 1) for n, c in enumerate(retrieved)], "query_id int, chunk_id int, rank int")
    grades = spark.createDataFrame([(1, c, g) for c, g in relevant.items()], "query_id int, chunk_id int, grade int")
    return evaluate.score_queries(q, hits, grades, k).first()


def test_metrics(spark):
    rel = {10: 2, 20: 1}
    assert [scores(spark, r, rel)["recall"] for r in ([10, 99, 20], [10, 99, 98], [99, 98, 97, 96, 95, 10])] == [1.0, 0.5, 0.0]
    assert scores(spark, [99, 10, 20], rel)["reciprocal_rank"] == 0.5 and scores(spark, [98, 99], rel)["reciprocal_rank"] == 0.0
    assert scores(spark, [10, 20], rel)["ndcg"] == 1.0 and scores(spark, [20, 10], rel)["ndcg"] < 1
    assert abs(scores(spark, [99, 10], {10: 3})["dcg"] - 3 / math.log2(3)) < 1e-12
    none = scores(spark, [10], {})
    assert (none["recall"], none["reciprocal_rank"], none["ndcg"], none["n_retrieved"]) == (None, None, None, 1)


def test_bootstrap_is_seeded_and_holds_the_mean(spark):
    rows = spark.createDataFrame([("a", i, float(i % 2)) for i in range(120)], "retriever string, query_id int, ndcg double")
    one, two = (evaluate.bootstrap(rows, "ndcg", 300).first() for _ in range(2))
    assert one == two and one["low"] < one["mean"] == 0.5 < one["high"] and 0.1 < one["high"] - one["low"] < 0.3


def test_contexts(spark):
    q = spark.createDataFrame([(1, "why ?")], "query_id int, question string")
    words = "word " * 400
    hits = spark.createDataFrame([(1, r, r, 0.5, 1, words) for r in (1, 2)], "query_id int, rank int, chunk_id int, score double, page int, text string")
    budgeted = answers.budgeted_prompts(q, hits).first()
    head = "[Source 1 | Page 1 | Chunk 1 | Score 0.5000]\n"
    block = head + words.strip()
    second = (block.replace("Source 1", "Source 2").replace("Chunk 1", "Chunk 2"))[: 3500 - len(block)].rsplit(" ", 1)[0]
    assert budgeted["context"] == block + "\n\n" + second
    assert budgeted["prompt"].endswith("Question:\nwhy?\n\nAnswer:")
    assert answers.strict_prompts(q, hits).first()["context"] == block


def test_prompts_refuse_without_sources(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, question string")
    hits = spark.createDataFrame([(1, 1, 5, "d", 3, "t")], "query_id int, rank int, chunk_id int, doc_id string, page int, text string")
    rows = {r["query_id"]: r for r in answers.prompts(q, hits).collect()}
    assert rows[1]["prompt"] == "Sources:\n\n[1] (d, page 3)\nt\n\nQuestion: a" and rows[1]["answer"] is None
    assert rows[2]["prompt"] is None and rows[2]["answer"] == "The study material provided does not cover this question."
    cited = {r["query_id"]: r for r in answers.citations(answers.prompts(q, hits).withColumn("answer", F.lit("[1] [4]"))).collect()}
    assert cited[1]["cited"] == [1] and cited[1]["invented"] == [4] and cited[2]["cited"] == []


def test_spans_match_brute_force(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=70), r.normal(size=70)
    logits = spark.createDataFrame([(1, 1, i, float(a[i]), float(b[i])) for i in range(70)], "question_id int, chunk_id int, token int, start_logit double, end_logit double")
    best = answers.best_spans(logits).first()
    wanted = max(((a[i] + b[j], -i, -j) for i in range(70) for j in range(i, min(70, i + 40))))
    assert (best["start_token"], best["end_token"]) == (-wanted[1], -wanted[2])
    assert abs(answers.with_confidence(answers.spans(logits)).agg(F.sum("confidence")).first()[0] - 1) < 1e-9


def test_lifecycle(spark):
    rows = [("a", 0, "pending", None, None, None), ("a", 1, "processing", None, None, None), ("a", 2, "failed", "X: y", 4, None), ("a", 3, "completed", None, None, 7), ("b", 0, "pending", None, None, None), ("b", 1, "processing", None, None, None)]
    events = spark.createDataFrame(rows, "doc_id string, seq long, status string, error string, n_pages int, n_chunks int").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    state = {r["doc_id"]: r for r in lifecycle.fold(events).collect()}
    assert (state["a"]["status"], state["a"]["error"], state["a"]["n_pages"], state["a"]["n_chunks"]) == ("completed", None, 4, 7)
    stale = lifecycle.reset_stale(events).collect()
    assert [(r["doc_id"], r["seq"], r["status"]) for r in stale] == [("b", 2, "failed")]
    assert lifecycle.unknown_targets(events, events.filter("doc_id = 'a'")).count() == 2


def test_rules(spark):
    span = "array<struct<doc_id:string,char_start:int,char_end:int,quote:string,grade:int>>"
    rows = [("ret-0001", "q", "conceptual", "dev", True, [("d", 0, 3, "abc", 2)], "human"), ("bad", "", "odd", "x", True, [], None), ("ret-0002", "q", "unanswerable", "test", False, [("d", 5, 5, "", 3)], "model")]
    df = spark.createDataFrame(rows, f"id string, query string, query_type string, split string, answerable boolean, relevant_spans {span}, verified_by string")
    found = {}
    for r in validate.problems(df, strict=True).collect():
        found.setdefault(r["id"], set()).add(r["problem"])
    assert "ret-0001" not in found and len(found["bad"]) == 6 and found["ret-0002"] == {"unanswerable with spans", "span range is wrong", "quote is empty", "grade is not 1 or 2", "not verified by a human"}


def test_embedder_contract(spark):
    embed = ports.embedder(ports.hash_model(16, {"pin": [3.0] + [0.0] * 15}), 16, batch=2)
    texts = ["a", "b", None, "pin", "a"]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(embed(F.col("t"))).collect()]
    assert rows[2] is None and rows[0] == rows[4] != rows[1] and rows[3] == [1.0] + [0.0] * 15
    assert all(abs(np.linalg.norm(r) - 1) < 1e-5 for r in rows if r)
    with pytest.raises(ValueError, match="components"):
        ports.hash_model(4, {"x": [1.0]})


def test_completions(spark):
    prompts = spark.createDataFrame([(1, "say"), (2, "fail"), (3, "think"), (4, None)], "query_id int, prompt string").withColumn("system", F.lit("s"))

    def load():
        def model(prompt, system):
            if prompt == "fail":
                raise RuntimeError("no")
            return "<think>x</think>" + (" yes" if prompt == "say" else "")

        return model

    got = {r["query_id"]: (r["completion"], r["error"]) for r in ports.complete(prompts, load).collect()}
    assert got == {1: ("yes", None), 2: (None, "RuntimeError: no"), 3: (None, "empty completion")}


def test_stream_equals_batch(spark, tmp_path):
    def load():
        model = ports.hash_model(8)()

        def careful(texts):
            if any("bad" in x for x in texts):
                raise RuntimeError("bad text")
            return model(texts)

        return careful

    embed = ports.embedder(load, 8, errors=True)
    s, inbox = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    first = spark.createDataFrame([("a", "one text " * 30), ("b", "two texts " * 200), ("c", "one text " * 30), ("d", "a bad text"), ("e", None), ("f", " ")], "doc_id string, text string")
    first.coalesce(1).write.mode("append").parquet(inbox)
    run = lambda: ingest.ingest_stream(spark.readStream.schema(first.schema).parquet(inbox), s, embed, str(tmp_path / "cp")).awaitTermination()
    run()
    docs = {r[0] for r in s.read("chunks").select("doc_id").distinct().collect()}
    assert docs == {"a", "b"}
    state = lambda: {r["doc_id"]: (r["status"], r["error"], r["n_chunks"]) for r in lifecycle.fold(s.read("events")).collect()}
    assert state() == {"a": ("completed", None, 1), "b": ("completed", None, 3), "d": ("failed", "RuntimeError: bad text", None), "e": ("failed", "ValueError: no text", None), "f": ("completed", None, 0)}
    before = {t: sorted(map(str, s.read(t).collect())) for t in ("chunks", "postings", "vectors")}
    ingest.ingest_batch(first.filter("doc_id in ('a', 'b', 'c')"), s, embed)
    assert {t: sorted(map(str, s.read(t).collect())) for t in before} == before
    spark.createDataFrame([("b", "new words")], first.schema).coalesce(1).write.mode("append").parquet(inbox)
    run()
    assert [r["text"] for r in s.read("chunks").filter("doc_id = 'b'").collect()] == ["new words"] and state()["b"] == ("completed", None, 1)
    assert s.read("vectors").count() == s.read("chunks").count() and {r[0] for r in s.read("postings").select("doc_id").distinct().collect()} == {"a", "b"}
    assert s.delete(spark.createDataFrame([("b",)], "doc_id string")) == 1 and s.read("vectors").count() == s.read("chunks").count() == 1


def test_nothing_is_scored_against_broken_anchors(spark):
    docs = spark.createDataFrame([("d", "some text of a document")], "doc_id string, text string")
    chunks = spark.createDataFrame([(7, "d", 0, 23)], "chunk_id int, doc_id string, source_start int, source_end int")
    label = lambda quote: spark.createDataFrame([(1, "d", 5, 9, quote, 2)], "query_id int, doc_id string, char_start int, char_end int, quote string, grade int")
    q, hits = spark.createDataFrame([(1,)], "query_id int"), spark.createDataFrame([("a", 1, 7, 1)], "retriever string, query_id int, chunk_id int, rank int")
    assert {r["retriever"]: r["recall"] for r in evaluate.run(q, hits, label("text"), docs, chunks, 5, ("a", "b")).collect()} == {"a": 1.0, "b": 0.0}
    with pytest.raises(ValueError, match="don't match"):
        evaluate.run(q, hits, label("other"), docs, chunks, 5, ("a", "b"))


def test_spans_have_so_many_characters(spark):
    logits = spark.createDataFrame([(1, 1, i, float(i == 0), float(i == 5), i * 10, i * 10 + 9) for i in range(9)], "question_id int, chunk_id int, token int, start_logit double, end_logit double, char_start int, char_end int")
    assert {(r["start_token"], r["end_token"]) for r in answers.spans(logits, chars=(2, 9)).collect()} == {(i, i) for i in range(9)}
    assert answers.spans(logits.drop("char_start"), chars=(2, 9)).count() == 45
