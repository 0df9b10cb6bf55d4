"""The stored index against searches of the texts, ingestion from files, and overlap joins, by brute force."""

import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ragspark.operators import chunk, intervals, lifecycle, ports, retrieve, spans
from ragspark.sources import corpus, index, scratch, store
from ragspark.sources.index import TermIndex
from ragspark.sources.store import Store
from ragspark.streaming import ingest

WORDS = [f"w{i}" for i in range(60)] + ["running", "runs", "run", "café", "d_k"]


def some_text(r, n=20):
    return " ".join(r.choices(WORDS, k=n))


def partitions_read(df):
    """The conditions on folders that the scans of the physical plan go by."""
    return " ".join(re.findall(r"PartitionFilters: \[.*?\]", df._jdf.queryExecution().executedPlan().toString()))


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def test_stored_index_equals_search_of_texts(spark, tmp_path):
    r = random.Random(3)
    texts = {i: some_text(r) for i in range(80)} | {80: "", 81: "?!"}
    queries = spark.createDataFrame([(i, some_text(r, 4)) for i in range(8)] + [(90, "w1_w2"), (91, "?"), (92, "nowhere")], "query_id int, text string")
    table = lambda rows: spark.createDataFrame(sorted(rows.items()), "chunk_id int, text string")
    stemmed, now = True, dict(texts)
    index = TermIndex(spark, str(tmp_path / "i"), stemmed=stemmed, parts=2)
    index.change(table(now), name="first")
    index.change(table(now), name="first")  # a change that is known by its name is not done again
    for step in range(2):
        old = {i: now[i] for i in r.sample(sorted(now), 15)}
        new = {i: some_text(r, 30) for i in [*list(old)[:9], 200 + step]}
        index.change(table(new), table(old))
        now = {i: x for i, x in now.items() if i not in old} | new
    # a change that broke off before its record is not seen
    index._add(table({1: "w1 w1 w1"}).select("chunk_id", F.split("text", " ").alias("t")).select("chunk_id", F.lit(3).alias("len"), F.posexplode("t").alias("pos", "term")), "lost")
    wanted = hits(retrieve.bm25_top_k(queries, table(now), 10, stemmed))
    assert len(wanted) > 40 and hits(index.search(queries, 10)) == wanted
    index.compact()
    assert hits(index.search(queries, 10)) == wanted and len(index.records()) == 1
    index.change(table({300: "w1 w2"}), table({}))
    assert hits(index.search(queries, 10)) == hits(retrieve.bm25_top_k(queries, table(now | {300: "w1 w2"}), 10, stemmed))


def test_search_reads_only_its_terms_parts(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "i"), stemmed=False, parts=16)
    index.change(spark.createDataFrame([(i, " ".join(WORDS[:60])) for i in range(5)], "chunk_id int, text string"))
    terms = spark.createDataFrame([("w7",)], "term string")
    part = terms.select(index._part()).first()[0]
    rows = index.live(terms)
    assert f"= {part})" in partitions_read(rows) and {r["term"] for r in rows.collect()} == {"w7"}


def test_only_the_best_of_each_block_leave_a_task(spark, monkeypatch):
    """A word that all chunks share: what tasks give is bounded by blocks, queries and k."""
    monkeypatch.setattr(retrieve, "CHUNKS", 100)
    r = random.Random(4)
    chunks = spark.createDataFrame([(i, f"common {some_text(r, 5)}") for i in range(1000)], "chunk_id int, text string")
    queries = spark.createDataFrame([(i, "common w1") for i in range(6)], "query_id int, text string")
    seen = []
    top_k = retrieve.top_k
    monkeypatch.setattr(retrieve, "top_k", lambda scored, *a, **b: (seen.append(scored.count()), top_k(scored, *a, **b))[1])
    got = hits(retrieve.bm25_top_k(queries, chunks, 5, stemmed=False))
    assert len(got) == 30 and seen[0] <= 10 * 6 * 5
    monkeypatch.setattr(retrieve, "CHUNKS", 4096)
    monkeypatch.setattr(retrieve, "QUERIES", 2)
    assert hits(retrieve.bm25_top_k(queries, chunks, 5, stemmed=False)) == got


def test_overlaps_of_one_large_document(spark):
    """100,000 chunks and as many segments of one document, and short ones, long ones and other documents."""
    n = 100_000
    a = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("ordinal"), (F.col("id") * 80).cast("int").alias("source_start"), (F.col("id") * 80 + 100).cast("int").alias("source_end"), F.lit("t").alias("text"))
    s = spark.range(n).select(F.lit("d").alias("doc_id"), (F.col("id") * 80 + 50).cast("int").alias("start"), (F.col("id") * 80 + 130).cast("int").alias("end"), F.lit("text").alias("extraction"), F.col("id").alias("page"))
    got = chunk.with_provenance(a, s).agg(F.count("*"), F.sum((F.col("page") == F.col("ordinal")).cast("int")), F.count_if(F.col("page").isNull())).first()
    # chunk i has 50 characters in common with segment i and 50 with the one before, the earlier of which wins
    assert got[0] == n and got[1] == 1 and got[2] == 0
    r = np.random.default_rng(5)
    rows = lambda k: [(int(d), int(b), int(b + r.choice([1, 7, 30, 400]))) for d, b in zip(r.integers(0, 3, k), r.integers(0, 500, k))]
    left, right = rows(150), rows(150)
    met = intervals.overlapping(spark.createDataFrame(left, "d int, a int, b int"), spark.createDataFrame(right, "e int, s int, t int"), ("d", "e"), ("a", "b"), ("s", "t"), bucket=16)
    assert sorted(map(tuple, met.collect())) == sorted((d, a, b, e, s, t) for d, a, b in left for e, s, t in right if d == e and a < t and b > s)


def test_labels_of_one_document_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spans, "LABELS", 3)
    rows = [(i, "d", i, i + 4, "0123456789"[i : i + 4] if i % 2 else "no", 1) for i in range(6)] + [(7, "d", 8, 40, "89", 1), (8, "none", 0, 1, "x", 1), (9, None, 0, 1, "x", 1), (1, "d", 1, 5, "1234", 1)]
    df = spark.createDataFrame(rows, "query_id int, doc_id string, char_start int, char_end int, quote string, grade int")
    got = spans.verify(df, spark.createDataFrame([("d", "0123456789")], "doc_id string, text string"))
    assert got.columns == [*df.columns, "reason"]
    told = sorted((r["query_id"], r["reason"] or "") for r in got.collect())
    assert told == sorted([(i, "" if i % 2 else "quote not found") for i in range(6)] + [(1, ""), (7, "past the end"), (8, "no document"), (9, "no document")])


def notebook(*cells):
    return json.dumps({"cells": [{"cell_type": kind, "source": source, "outputs": []} for kind, source in cells]})


def test_ingestion_from_files(spark, tmp_path):
    inbox, embed = tmp_path / "in", ports.embedder(ports.hash_model(8), 8, errors=True)
    inbox.mkdir()
    files = {"One A.md": " words of one\n", "two.ipynb": notebook(("markdown", ["# Two", " lines"]), ("raw", "x"), ("code", "print(1)")), "bad.ipynb": '{"cells": [', "other.ipynb": "{}", "copy.md": " words of one\n", "scan.pdf": "%PDF", "empty.md": " \n"}
    for name, x in files.items():
        (inbox / name).write_text(x)
    (inbox / "deep").mkdir()
    (inbox / "deep" / "three.MD").write_bytes(b"caf\xc3\xa9 \xff words")
    s = Store(spark, str(tmp_path / "s"), 4, parts=4, digits=1)
    run = lambda k: ingest.ingest_files(spark, str(inbox), s, embed, str(tmp_path / f"cp{k}")).awaitTermination()
    state = lambda: {r["doc_id"]: (r["status"], r["n_chunks"]) for r in lifecycle.fold(s.read("events")).collect()}
    run(0)
    assert state() == {"copy": ("completed", 1), "two": ("completed", 1), "bad": ("failed", None), "other": ("failed", None), "scan": ("failed", None), "empty": ("completed", 0), "three": ("completed", 1)}
    errors = {r["doc_id"]: r["error"] for r in lifecycle.fold(s.read("events")).collect()}
    assert errors["bad"] == "ValueError: not a notebook" and errors["scan"].startswith("NotImplementedError") and errors["two"] is None
    texts = lambda: {r["doc_id"]: r["text"] for r in s.read("chunks").collect()}
    assert texts() == {"copy": "words of one", "two": "# Two lines\n\nprint(1)", "three": "café � words"}
    found = lambda q: {r["chunk_id"] for r in s.index.search(spark.createDataFrame([(1, q)], "query_id int, text string")).collect()}
    ids = {r["doc_id"]: r["chunk_id"] for r in s.read("chunks").collect()}
    assert found("lines words") == {ids["copy"], ids["two"], ids["three"]}
    before = {t: sorted(map(str, s.read(t).collect())) for t in ("chunks", "postings", "vectors")}
    run(1)
    assert {t: sorted(map(str, s.read(t).collect())) for t in before} == before and found("lines") == {ids["two"]}
    # a text that changes, and changes back: what it was is no longer held in between
    for k, x in enumerate(("other words", " words of one\n")):
        ingest.ingest_batch(spark.createDataFrame([("copy", x)], "doc_id string, text string"), s, embed)
        assert texts()["copy"] == x.strip() and found("one") == ({ids["copy"]} if k else set())
    gone = spark.createDataFrame([("copy",)], "doc_id string")
    assert s.delete(gone) == 1 and found("one") == set() and s.delete(gone) == 0
    ingest.ingest_batch(spark.createDataFrame([("copy", " words of one\n")], "doc_id string, text string"), s, embed)
    assert texts()["copy"] == "words of one" and found("one") == {ids["copy"]}


def test_hashes_are_looked_up_by_their_beginning(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.col("id").alias("doc_id"), F.lit(1).alias("seq"))
    s.log_hashes(rows, True)
    one = rows.filter("doc_id = 7")
    assert [r[0] for r in s.held(one).collect()] == [one.first()[0]]
    assert f"= {one.first()[0][:2]})" in partitions_read(s.held(one))
    s.log_hashes(one.withColumn("seq", F.lit(2)), False)
    assert s.held(one).count() == 0 and s.held(rows).count() == 299


def test_line_numbers_of_files_in_several_splits(spark, tmp_path):
    lines = [json.dumps({"id": f"ret-{i:04d}", "query": "q" * (i % 50)}) if i % 7 else "" if i % 2 else "{broken" for i in range(400)]
    (tmp_path / "a b.jsonl").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "c.jsonl").write_text("\n".join(lines[:90]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {}
    for most in ("1000", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        rows, problems = corpus.read_dataset(spark, f"{tmp_path}/*.jsonl")
        got[most] = sorted((r["line_no"], r["id"], r["query"]) for r in rows.collect()), sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in problems.collect())
        if most == "1000":
            assert rows.rdd.getNumPartitions() > 1
    assert got["1000"] == got[size]
    assert got[size][0] == sorted((i + 1, f"ret-{i:04d}", "q" * (i % 50)) for n in (400, 90) for i in range(n) if i % 7)
    assert got[size][1] == sorted((name, i + 1, "{broken") for name, n in (("a b.jsonl", 400), ("c.jsonl", 90)) for i in range(n) if i % 14 == 0)


def test_notebooks_by_file_and_by_cell(spark, tmp_path):
    cells = [("markdown", " a\n"), ("code", ["x = 1\n", "y"]), ("raw", "no"), ("markdown", "  "), ("code", "z")]
    (tmp_path / "b.ipynb").write_text(notebook(*cells))
    docs, segments = corpus.assemble(corpus.notebook_parts(spark, str(tmp_path / "*.ipynb")), extraction=F.lit("notebook"))
    row = corpus.notebook_texts(corpus.scan_files(spark, str(tmp_path))).first()
    assert row["text"] == docs.first()["text"] and row["error"] is None
    assert [tuple(x) for x in row["segments"]] == sorted((x["start"], x["end"], x["extraction"], x["page"]) for x in segments.collect())


def test_many_files_are_listed_in_few_tasks(spark):
    own = ingest.for_small_files(spark)
    assert int(own.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 4 * spark.sparkContext.defaultParallelism
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 10_000


def shuffle_files(spark):
    """Names and bytes of the shuffle files that lie there."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if re.match(r"shuffle_.*data$", f.getName())}


def test_postings_of_a_term_lie_in_groups(spark, tmp_path):
    """Rows of the index grow with the terms of some texts, not with all chunks that hold them, and a change leaves no shuffle files."""
    table = spark.createDataFrame([(i, " ".join(WORDS[:60])) for i in range(400)], "chunk_id int, text string").coalesce(1)
    held = TermIndex(spark, str(tmp_path / "i"), parts=2)
    before = shuffle_files(spark)
    held.change(table)
    folder = next(p for p in (tmp_path / "i").iterdir() if p.name in ("groups", "postings"))
    assert spark.read.parquet(str(folder)).count() <= 61
    assert sum(n for name, n in shuffle_files(spark).items() if name not in before) < 30_000  # counts, and keys to be counted
    assert held.live().count() == 400 * 60
    queries = spark.createDataFrame([(1, "w1 w2 w3")], "query_id int, text string")
    few = scratch.few(retrieve.query_terms(queries), "terms")
    assert "SortMergeJoin" not in held.live(few)._jdf.queryExecution().executedPlan().toString()


def test_index_written_in_turns(spark, tmp_path, monkeypatch):
    """Texts in many groups and turns, with marks, repeated keys and blank ones, are found as in a search of the texts."""
    monkeypatch.setattr(index, "AT_ONCE", 4_000)
    monkeypatch.setattr(index, "GROUPED", 300)
    r = random.Random(6)
    rows = [(f"c{i % 150}", some_text(r)) for i in range(160)] + [("e", ""), ("m", "Crème brûlée, crème; w1 w2"), ("n", "?!")]
    table = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string")
    queries = spark.createDataFrame([(i, some_text(r, 4)) for i in range(6)] + [(90, "w1_w2"), (91, "creme w1")], "query_id int, text string")
    held, plain, turns = TermIndex(spark, str(tmp_path / "i"), parts=3), TermIndex(spark, str(tmp_path / "p"), stemmed=False), []
    write = TermIndex._write
    monkeypatch.setattr(TermIndex, "_write", lambda self, *a: (turns.append(1), write(self, *a)))
    held.change(table(rows))
    assert len(turns) > 2 and held.records()[0][3] == len(rows)
    assert hits(held.search(queries, 10)) == hits(retrieve.bm25_top_k(queries, table(rows), 10))
    plain.change(table(rows[:40]))
    assert hits(plain.search(queries, 10)) == hits(retrieve.bm25_top_k(queries, table(rows[:40]), 10, stemmed=False))
    found = sorted((x["chunk_id"], p, x["term"]) for x in plain.live().collect() for p in x["places"])
    assert found == sorted((x["chunk_id"], x["pos"], x["term"]) for x in retrieve.postings(table(rows[:40]), False).collect())


def test_segments_without_live_chunks_are_not_read(spark, tmp_path, monkeypatch):
    table = lambda x, n: spark.createDataFrame([(i, f"{x} w{i}") for i in range(n)], "chunk_id int, text string")
    held = TermIndex(spark, str(tmp_path / "i"), parts=1)
    held.change(table("old", 9))
    held.change(table("new", 9), table("old", 9))
    first, second = (r[1] for r in held.records())
    read, groups = [], TermIndex._groups
    monkeypatch.setattr(TermIndex, "_groups", lambda self, column, values: (read.append(values), groups(self, column, values))[1])
    held.live()
    assert read == [[first], [second]]  # the first one's list of chunks, the other's postings
    q = spark.createDataFrame([(1, "old new w3")], "query_id int, text string")
    assert hits(held.search(q)) == hits(retrieve.bm25_top_k(q, table("new", 9)))
    held.change(table("newest", 2), table("new", 2))  # of this segment most are alive
    now = table("newest", 2).unionByName(table("new", 9).filter("chunk_id > 1"))
    q = spark.createDataFrame([(1, "old new w3"), (2, "newest w1")], "query_id int, text string")
    assert hits(held.search(q, 9)) == hits(retrieve.bm25_top_k(q, now, 9))
    held.compact()
    held.change(table("last", 1), table("newest", 1))
    assert hits(held.search(q, 9)) == hits(retrieve.bm25_top_k(q, table("last", 1).unionByName(now.filter("chunk_id > 0")), 9))


def test_ingestion_keeps_texts_once(spark, tmp_path):
    """Of a batch there stay the store's tables: no table of its own, no text in shuffle files, and no second copy of the postings."""
    r, inbox = random.Random(7), tmp_path / "in"
    inbox.mkdir()
    for i in range(60):
        text = some_text(r, 1500) + f" {r.random()}"
        (inbox / f"d{i}.{'md' if i % 2 else 'ipynb'}").write_text(text if i % 2 else notebook(("markdown", text)))
    (inbox / "copy").mkdir()
    (inbox / "copy" / "d1.md").write_text((inbox / "d1.md").read_text())  # the same document twice
    s, embed = Store(spark, str(tmp_path / "s"), 4, parts=2, digits=1), ports.embedder(ports.hash_model(8), 8, errors=True)
    made, before = set(scratch._MADE), shuffle_files(spark)
    ingest.ingest_files(spark, str(inbox), s, embed, str(tmp_path / "cp")).awaitTermination()
    assert set(scratch._MADE) == made and not s.exists("postings")
    assert sum(n for name, n in shuffle_files(spark).items() if name not in before) < 100_000  # counts, names and numbers; the texts have more characters
    state = lifecycle.fold(s.read("events")).collect()
    assert len(state) == 60 and {x["status"] for x in state} == {"completed"} and sum(x["n_chunks"] for x in state) == s.read("chunks").count()
    chunks = s.read("chunks")
    assert chunks.select("doc_id", "ordinal").distinct().count() == chunks.count() == s.read("vectors").count() > 60
    rows = lambda df: sorted((x["chunk_id"], x["pos"], x["term"], x["doc_id"]) for x in df.collect())
    of_texts = lambda: rows(retrieve.postings(s.read("chunks")).join(s.read("chunks").select("chunk_id", "doc_id"), "chunk_id"))
    assert rows(s.read("postings")) == of_texts()
    # a store that has a table of postings keeps it up
    s.replace({t: s.read(t).localCheckpoint() for t in store.TABLES})
    ingest.ingest_batch(spark.createDataFrame([("d1", "other words")], "doc_id string, text string"), s, embed)
    assert s.exists("postings") and rows(s.read("postings")) == of_texts() and s.read("chunks").filter("doc_id = 'd1'").count() == 1


def test_store_written_in_turns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "AT_ONCE", 20)
    written, write = [], Store._write
    monkeypatch.setattr(Store, "_write", lambda self, name, rows, some: (written.append((name, tuple(some))), write(self, name, rows, some)))
    s = Store(spark, str(tmp_path / "s"), 4)
    rows = lambda ids, x: {t: spark.createDataFrame([(d, f"{d}{i}", x) for d in ids for i in range(2)], "doc_id int, chunk_id string, text string") for t in store.TABLES}
    s.replace(rows(range(30), "a"))
    s.replace(rows(range(20, 40), "b"), spark.createDataFrame([(5,)], "doc_id int"))
    assert written == [(t, (b,)) for _ in range(2) for t in store.TABLES for b in range(4)]
    wanted = sorted((d, f"{d}{i}", "a" if d < 20 else "b") for d in range(40) if d != 5 for i in range(2))
    for t in store.TABLES:
        assert sorted((x["doc_id"], x["chunk_id"], x["text"]) for x in s.read(t).collect()) == wanted
