import sqlite3

import pytest
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.stem import porter
from ragspark.sources import corpus


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (tx.strip, "  a b\x1c\n", "a b"), (tx.clean_plain, " a \n\t b ", "a b"), (tx.clean_extracted, "eﬃcient trans- \n former ( x ) , y", "efficient transformer (x), y"),
        (tx.clean_extracted, None, ""), (tx.clean_page, "[CLS] trans-\nformer​ [ a ] { b } .", "transformer [a] {b}."), (tx.clean_page, None, ""), (tx.clean_page, "a\r\nb", "a b"),
        (tx.clean_answer, " [SEP], play ##ing ( now ) ;", "playing (now)"), (tx.is_reasonable_answer, " . ", False), (tx.is_reasonable_answer, "[CLS]", False), (tx.is_reasonable_answer, "ok", True), (tx.is_reasonable_answer, None, False),
        (tx.sentences, "See Fig. 2 by Dr. Who et al. It works! (Yes.) no split. ok", ["See Fig. 2 by Dr. Who et al. It works!", "(Yes.) no split. ok"]), (tx.sentences, None, []),
        (tx.words, "  a b  c ", ["a", "b", "c"]), (tx.words, None, []), (tx.query_tokens, "NEAR(a b)", ["NEAR", "a", "b"]), (tx.query_tokens, "?!*()", []), (tx.query_tokens, "C++ d_k", ["C", "d_k"]),
        (tx.index_tokens, "D_k Éclair ÜBER x2", ["d", "k", "eclair", "uber", "x2"]), (tx.strip_reasoning, "<think>a\nb</THINK> yes ", "yes"), (tx.strip_reasoning, "<think>x</think>", ""),
        (tx.slug, "Éclair: Paper (v2).pdf", "eclair-paper-v2-pdf"), (tx.slug, "???", "document"), (tx.slug, None, "document"),
    ],
)
def test_functions(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_citations_and_prompt(spark):
    cited = lambda text, n: one(spark, text, lambda c: tx.cited_indices(c, F.lit(n)))
    assert cited("[2] [1][2] [0] [9]", 3) == [2, 1]
    assert cited(None, 3) == []
    row = spark.sql("select array(named_struct('doc_id','a','page',3,'text','x'), named_struct('doc_id','b','page',cast(null as int),'text','y')) s")
    assert row.select(tx.build_prompt(F.lit("why?"), F.col("s"))).first()[0] == "Sources:\n\n[1] (a, page 3)\nx\n\n[2] (b)\ny\n\nQuestion: why?"


def test_lengths(spark):
    rows = spark.createDataFrame([("a", 1), ("", 1), (None, 1), ("x" * 1001, 1), ("a", 51), ("a", None)], "q string, k int")
    assert [r[0] for r in rows.select(tx.length_verdict(F.col("q"), F.col("k"))).collect()] == [None, "query is empty", "query is empty", "query is too long", "top_k is out of range", "top_k is out of range"]


def test_stems_match_fts5():
    words = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational
    valenci digitizer conformabli radicalli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical
    hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll
    roll attention networks normalization apologies yes ion lion a is archaeology""".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    db.execute("insert into t values (?)", (" ".join(words),))
    found = [term for term, in db.execute("select term from v order by offset")]
    assert found == [porter(w) for w in words]


def test_notebooks_and_markdown(spark, tmp_path):
    (tmp_path / "My Book.ipynb").write_text(
        '{"cells":[{"cell_type":"markdown","source":["# A\\n","b "]},{"cell_type":"raw","source":"x"},{"cell_type":"code","source":"1+1","outputs":[{"output_type":"execute_result","data":{"text/plain":["2"]}},{"output_type":"stream","text":"'
        + "z" * 501 + '"},{"output_type":"error","ename":"E","evalue":"bad"}]},{"cell_type":"code","source":" "}]}'
    )
    parts = corpus.notebook_parts(spark, str(tmp_path / "*.ipynb")).orderBy("page").collect()
    assert [tuple(r) for r in parts] == [("my-book", 1, "# A\nb"), ("my-book", 3, "1+1\n\n2\nE: bad")]
    docs, segments = corpus.assemble(corpus.notebook_parts(spark, str(tmp_path / "*.ipynb")))
    text = docs.first()["text"]
    assert [text[r["start"] : r["end"]] for r in segments.orderBy("start").collect()] == ["# A\nb", "1+1\n\n2\nE: bad"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "N.MD").write_bytes(b"\n# T \xff\n")
    (tmp_path / "sub" / "n.txt").write_text("no")
    files = corpus.scan_files(spark, str(tmp_path))
    assert files.count() == 2
    md = corpus.markdown(files.filter("path like '%MD'")).first()
    assert md["text"] == "# T �" and (md["segments"][0]["start"], md["segments"][0]["end"]) == (0, 5)


def test_frozen_corpus(spark, tmp_path):
    text = "epoch 1\rescaped 50%\rdone\r\nfinished"
    docs = spark.createDataFrame([("a", text), ("b", None)], "doc_id string, text string")
    corpus.freeze(docs, str(tmp_path / "c"))
    assert corpus.read_frozen(spark, str(tmp_path / "c")).first()["text"] == text
    assert spark.read.parquet(str(tmp_path / "c/rejects")).count() == 1
    docs.filter("doc_id = 'a'").selectExpr("doc_id", "text || 'x' text", "sha2(text, 256) text_sha256").write.parquet(str(tmp_path / "d/documents"))
    assert corpus.drift(spark.read.parquet(str(tmp_path / "d/documents"))).count() == 1
    with pytest.raises(Exception, match="drifted"):
        corpus.read_frozen(spark, str(tmp_path / "d")).collect()


def test_dataset_files(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id":"ret-0001","query":"q","relevant_spans":[{"doc_id":"a","char_start":0,"char_end":3,"quote":"abc","grade":2}]}\n\n{bad\n{"id":"ret-0002"}\n')
    rows, bad = corpus.read_dataset(spark, str(tmp_path / "d.jsonl"))
    assert [(r["id"], r["line_no"]) for r in rows.orderBy("line_no").collect()] == [("ret-0001", 1), ("ret-0002", 4)]
    assert [r["line_no"] for r in bad.collect()] == [3]
    assert corpus.write_dataset(rows.drop("line_no"), str(tmp_path / "out")) == 2
    again, none = corpus.read_dataset(spark, str(tmp_path / "out"))
    assert again.count() == 2 and none.count() == 0


def test_duplicates_and_collisions(spark):
    rows = spark.createDataFrame([("a", 2, "h1"), ("b", 1, "h1"), ("c", 3, "h2"), ("c", 4, "h3"), ("d", 5, "h9"), ("d", 5, "h9")], "doc_id string, arrival int, content_hash string")
    stored = spark.createDataFrame([("z", "h9")], "doc_id string, content_hash string")
    assert {(r["doc_id"], r["content_hash"]) for r in corpus.first_by_hash(rows, stored).collect()} == {("b", "h1"), ("c", "h2"), ("c", "h3")}
    assert {r["doc_id"] for r in corpus.id_collisions(rows, stored).collect()} == {"c"}


def test_texts_are_normalised_in_their_batches():
    import pyarrow as pa

    texts = ["plain", None, "", "ﬁne x²", "é"] * 40
    got = tx.nfkc.func(pa.array(texts, pa.string()))
    assert got.to_pylist() == ["plain", None, "", "fine x2", "é"] * 40
    assert tx.nfkc.func(pa.array([], pa.string())).to_pylist() == []
    assert tx.nfkc.func(pa.array([None, "a"], pa.string()).slice(1)).to_pylist() == ["a"]
