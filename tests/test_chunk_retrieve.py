import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragspark.operators import chunk, retrieve, spans
from ragspark.sources import store


def sound(text, size, overlap):
    found = list(chunk.cuts(text, size, overlap))
    if not text.strip():
        assert found == []
        return found
    assert found[0][0] == len(text) - len(text.lstrip()) and found[-1][1] == len(text.rstrip())
    for (a, b), (c, d) in zip(found, found[1:]):
        assert c > a and d > b and not text[b:c].strip()
    assert all(0 < b - a <= size and text[a:b] == text[a:b].strip() for a, b in found)
    return found


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n?!", max_size=300), st.integers(20, 60), st.integers(0, 9))
def test_cuts_hold_their_invariants(text, size, overlap):
    sound(text, size, overlap)


def test_cuts_known_cases(spark):
    assert list(chunk.cuts("A" * 300 + "\n\n" + "B" * 300, 400, 50))[0] == (0, 300)
    assert sound("A" * 5000, 500, 100)[-1][1] == 5000
    sound("word " * 3000, 500, 100)
    sound("\n\n".join(f"Paragraph {i}. It has words? Yes! {'x' * i}" for i in range(40)), 400, 80)
    docs = spark.createDataFrame([("a", "word " * 300), ("b", " "), ("c", None)], "doc_id string, text string")
    chunks = chunk.char_chunks(docs, 200, 40)
    assert {r["doc_id"] for r in chunks.collect()} == {"a"}
    assert chunk.chunk_faults(chunks, docs).count() == 0
    assert chunk.chunk_faults(chunks.filter("ordinal <> 1"), docs).count() > 0
    with pytest.raises(ValueError, match="smaller"):
        chunk.char_chunks(docs, 10, 10)


def test_provenance(spark):
    docs = spark.createDataFrame([("d", "x" * 500 + "\n\n" + "y" * 500)], "doc_id string, text string")
    segments = spark.createDataFrame([("d", 0, 500, "text", 1), ("d", 502, 1002, "ocr", 2)], "doc_id string, start int, end int, extraction string, page int")
    rows = chunk.with_provenance(chunk.char_chunks(docs, 400, 0), segments).orderBy("ordinal").collect()
    assert (rows[0]["extraction"], rows[0]["page"], rows[-1]["extraction"], rows[-1]["page"]) == ("text", 1, "ocr", 2)


def test_word_chunks_match_the_loop(spark):
    pages = [(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 29, 30, 180, 181, 319, 320, 321, 500)]
    df = spark.createDataFrame(pages, "page_number int, text string")
    got = {(r["page_number"], r["start_word"], r["word_count"]) for r in chunk.word_chunks(df).collect()}
    assert got == {(n, s, min(180, n - s)) for n, _ in pages for s in range(0, n, 140)}
    wanted = set()
    for n, _ in pages:
        s = 0
        while s < n:
            e = min(s + 180, n)
            if e - s >= 30:
                wanted.add((n, s, e))
            if e == n:
                break
            s = e - 40
    assert {(r["page_number"], r["start_word"], r["end_word"]) for r in chunk.word_chunks_to_end(df).collect()} == wanted


def test_sentence_chunks():
    listed = ["a b c", "d e", "f g h i", "j", "k l m n o p q r s t u v"]
    got = list(chunk.packed(listed, 6, 2))
    assert got == [["a b c", "d e"], ["d e", "f g h i"], ["f g h i", "j"], ["k l m n o p"], ["q r s t u v"]]
    assert all(sum(len(s.split()) for s in p) <= 6 for p in got)


def test_span_overlap(spark):
    s = spark.createDataFrame([(1, "d", a, b, "q", 2) for a, b in ((100, 200), (2000, 2100), (1000, 1100), (950, 1050), (0, 10000))], "query_id int, doc_id string, char_start int, char_end int, quote string, grade int")
    c = spark.createDataFrame([(7, "d", 0, 1000), (8, "other", 0, 1000)], "chunk_id int, doc_id string, source_start int, source_end int")
    got = {(r["char_start"], r["overlap"]) for r in spans.resolve(s, c).collect()}
    assert got == {(100, 1.0), (950, 0.5), (0, 1.0)}
    assert spans.unresolved(s, spans.resolve(s, c)).count() == 2


def test_fusion_and_top_k(spark):
    make = lambda ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id int, chunk_id int, rank int")
    fused = lambda *lists: [(r["chunk_id"], round(r["score"], 9)) for r in retrieve.fuse([make(x) for x in lists]).orderBy("rank").collect()]
    assert fused([7], [7]) == [(7, round(2 / 61, 9))]
    assert [i for i, _ in fused([1, 2], [2])] == [2, 1]
    assert [i for i, _ in fused([9], [3])] == [3, 9]


def test_dense_search_is_exact_with_ties(spark):
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(300, 8)), 1).astype(np.float32)
    x[100:180] = x[5]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")
    queries = vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    for measure in ("inner", "cosine", "l2", "l2_cosine"):
        got = retrieve.dense_top_k(queries, vectors, 10, measure)
        for q in (0, 100, 280):
            s = np.round(retrieve._measure(measure, x[q : q + 1].astype(float), x.astype(float))[0], retrieve.PLACES)
            wanted = np.lexsort((np.arange(300), -s))[:10].tolist()
            assert [h["chunk_id"] for h in got.filter(f"query_id = {q}").orderBy("rank").collect()] == wanted
    assert retrieve.dense_top_k(queries, vectors, 0).count() == 0
    assert retrieve.dense_top_k(queries.limit(0), vectors, 3).count() == 0
    with pytest.raises(ValueError, match="compared"):
        retrieve.dense_top_k(queries.withColumn("embedding", F.slice("embedding", 1, 3)), vectors, 3)


def test_bm25_matches_fts5(spark):
    texts = ["The attention softmax is scaled softmax", "softmax d_k scaling of dot products", "Layer normalization ÉCLAIR networks d k", "convolution networks network", "d then k", ""]
    questions = ["softmax scaling", "C++ networks", "?!*", "d_k", "NEAR(a b) softmax OR", "eclair softmax softmax", ""]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    chunks = spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieve.bm25_top_k(queries, chunks, 10).collect()}
    wanted = {}
    import re

    for i, q in enumerate(questions):
        if tokens := re.findall(r"\w+", q):
            match = " OR ".join(f'"{t}"' for t in tokens)
            wanted |= {(i, n): -s for n, s in db.execute("select rowid, bm25(t) from t where t match ?", (match,))}
    assert got.keys() == wanted.keys()
    assert all(abs(got[k] - wanted[k]) < 1e-6 for k in got)


def test_hybrid_rescues_the_exact_term(spark):
    chunks = spark.createDataFrame([(1, "a decoy about scaling"), (2, "what rmsnorm does"), (3, "filler one"), (4, "filler two")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.43588989]), (3, [0.0, 1.0]), (4, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, "rmsnorm", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    assert [r["chunk_id"] for r in retrieve.dense_top_k(q, vectors, 4).orderBy("rank").collect()][:2] == [1, 2]
    hits = retrieve.hybrid(q, chunks, vectors)
    assert [r["chunk_id"] for r in hits.orderBy("rank").collect()][:2] == [2, 1]
    assert retrieve.contract_faults(hits, 5).count() == 0


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = lambda d, n: {t: spark.createDataFrame([(d, f"{d}{i}", "word") for i in range(n)], "doc_id string, chunk_id string, text string") for t in store.TABLES}
    assert not s.exists("chunks")
    s.replace(rows("a", 3))
    s.replace(rows("b", 2))
    s.replace(rows("a", 1))
    assert {t: s.read(t).count() for t in store.TABLES} == dict.fromkeys(store.TABLES, 3)
    assert store.disagreements(*(s.read(t) for t in store.TABLES)).count() == 0
    assert s.delete(spark.createDataFrame([("b",)], "doc_id string")) == 2
    assert {t: s.read(t).count() for t in store.TABLES} == dict.fromkeys(store.TABLES, 1)


def test_sentence_chunks_go_out_in_small_batches(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    ran, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, *a, **k: ran.append(run) or plain(self, run, *a, **k))
    monkeypatch.setattr(chunk, "AT_ONCE", 5)
    chunk.sentence_chunks(spark.createDataFrame([(1, "a")], "page_number long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([["One two."], ["Three four."], [], ["x"]])], names=["k", "s"])
    out = list(ran[0](iter([batch])))
    assert len(out) == 3 and [x for b in out for x in b.column(0).to_pylist()] == [1, 2, 4]
