"""Answer assembly, candidate ranking, lifecycle, data set rules and judged reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.operators import answers, evaluate, lifecycle, ports, retrieve, validate
from ragspark.plans import inputs
from ragspark.plans.inputs import bm25_sql, dense_sql
from ragspark.plans.registry import Tables, query
from ragspark.plans.retrieval_queries import ASKED, GRADES, asked
from ragspark.plans.chunk_queries import walk_sql
from ragspark.plans.text_queries import CLEAN_PAGE
from ragspark.sources import corpus, scratch, store
from ragspark.streaming import ingest

LEAST = 60.0
SQUEEZE_ENDS = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
SOURCES = f"{bm25_sql()}, src AS (SELECT query_id, rank, chunk_id, doc_id, score, text, CASE WHEN lang = 'en' THEN n_chars // 1000 END AS page FROM hits JOIN documents ON doc_id = chunk_id WHERE score >= {LEAST})"


def sources(t: Tables) -> DataFrame:
    """Lexical hits of at least this score, with texts; pages for English documents."""
    hits = retrieve.bm25_top_k(inputs.passages(t), inputs.as_chunks(t), stemmed=False).filter(F.col("score") >= LEAST)
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.when(F.col("lang") == "en", F.floor(F.col("n_chars") / 1000)).alias("page"))
    return retrieve.hydrate(hits, chunks)


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


PROMPTS = rf"""{SOURCES}, p AS (SELECT query_id, count(*) AS n, 'Sources:' || chr(10) || chr(10) || string_agg('[' || rank || '] (' || doc_id || coalesce(', page ' || page, '') || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS s FROM src GROUP BY query_id)"""


@query(f"WITH {PROMPTS} SELECT item_id AS query_id, s || chr(10) || chr(10) || 'Question: ' || text AS prompt, CASE WHEN s IS NULL THEN '{tx.REFUSAL}' END AS answer FROM benchmark LEFT JOIN p ON query_id = item_id")
def g1_g2_prompts(t: Tables) -> DataFrame:
    return answers.prompts(questions(t), sources(t)).select("query_id", "prompt", "answer")


@query(f"""WITH {PROMPTS}, n AS (SELECT item_id AS query_id, coalesce(n, 0) AS n FROM benchmark LEFT JOIN p ON query_id = item_id)
 SELECT query_id, array_to_string(list_filter([2, 1], lambda i: i <= n), ',') AS cited, array_to_string(list_filter(range(1, n + 1), lambda i: i > 2), ',') AS uncited, array_to_string(list_filter([2, 9, 1], lambda i: i > n), ',') AS invented FROM n""")
def g3_g4_citations(t: Tables) -> DataFrame:
    """Answers that cite 2, 9 and 1."""
    rows = answers.prompts(questions(t), sources(t)).withColumn("answer", F.lit("so [2], [9] and [1]; again [2]"))
    out = answers.citations(rows)
    return out.select("query_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("cited", "uncited", "invented")))


@query(rf"""WITH {SOURCES}, b AS (SELECT query_id, rank, '[Source ' || rank || ' | Page ' || coalesce(page::VARCHAR, 'None') || ' | Chunk ' || chunk_id || ' | Score ' || printf('%.4f', score) || ']' || chr(10) || {CLEAN_PAGE.format("text")} AS block FROM src),
 r AS (SELECT *, 3500 - coalesce(sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b),
 o AS (SELECT *, sum((length(block) > room)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS over_ FROM r),
 k AS (SELECT query_id, rank, CASE WHEN over_ = 0 THEN block ELSE regexp_replace(substr(block, 1, room::BIGINT), ' [^ ]*$', '') END AS block FROM o WHERE over_ = 0 OR (over_ = 1 AND length(block) > room AND room > 300)),
 c AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM k GROUP BY query_id)
 SELECT item_id AS query_id, coalesce(context, '') AS context, {SQUEEZE_ENDS.format("'" + answers.CONTEXT_HEAD.replace(chr(10), "' || chr(10) || '") + "' || coalesce(context, '') || chr(10) || chr(10) || 'Question:' || chr(10) || " + CLEAN_PAGE.format("text") + " || chr(10) || chr(10) || 'Answer:'")} AS prompt FROM benchmark LEFT JOIN c ON query_id = item_id""")
def g5_budgeted_prompts(t: Tables) -> DataFrame:
    return answers.budgeted_prompts(questions(t), sources(t)).select("query_id", "context", "prompt")


@query(f"""WITH {SOURCES}, b AS (SELECT query_id, rank, '[Source ' || rank || ' | Page ' || coalesce(page::VARCHAR, 'None') || ' | Chunk ' || chunk_id || ' | Score ' || printf('%.4f', score) || ']' || chr(10) || {CLEAN_PAGE.format("text")} AS block FROM src),
 r AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM b), c AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE total <= 3500 GROUP BY query_id)
 SELECT item_id AS query_id, coalesce(context, '') AS context FROM benchmark LEFT JOIN c ON query_id = item_id""")
def g6_strict_prompts(t: Tables) -> DataFrame:
    return answers.strict_prompts(questions(t), sources(t)).select("query_id", "context")


CANDIDATES = f"{dense_sql('inner', 10)}, cand AS (SELECT query_id AS question, chunk_id, rank AS retrieval_rank, score AS retrieval_score, round(v.embedding[1]::DOUBLE * 50, 6) AS reader_span_score, CASE WHEN (v.label + query_id // 20) % 3 > 0 THEN 'valid_answer' ELSE 'no_valid_span' END AS reader_status, 'answer ' || chunk_id AS answer FROM hits JOIN embeddings v ON v.vec_id = chunk_id WHERE chunk_id <> query_id AND score >= 0.35)"


def candidates(t: Tables) -> DataFrame:
    """Other vectors that are near enough to a query, with a component as the reader's score; some queries have none."""
    hits = retrieve.dense_top_k(inputs.vector_queries(t), inputs.vectors(t), 10, "inner").filter("chunk_id <> query_id and score >= 0.35")
    rows = hits.join(inputs.vectors(t), "chunk_id")
    return rows.select(
        F.col("query_id").alias("question"), "chunk_id", F.col("rank").alias("retrieval_rank"), F.col("score").alias("retrieval_score"), F.round(F.col("embedding")[0].cast("double") * 50, 6).alias("reader_span_score"),
        F.when((F.col("label") + F.floor(F.col("query_id") / 20)) % 3 > 0, "valid_answer").otherwise("no_valid_span").alias("reader_status"), F.concat(F.lit("answer "), "chunk_id").alias("answer"),
    )


def vector_questions(t: Tables) -> DataFrame:
    return inputs.vector_queries(t).select(F.col("query_id").alias("question"))


ALL_QUESTIONS = "SELECT vec_id AS question FROM embeddings WHERE vec_id % 20 = 0"


@query(f"""WITH {CANDIDATES}, n AS (SELECT *, (retrieval_score - min(retrieval_score) OVER w) / (max(retrieval_score) OVER w - min(retrieval_score) OVER w + 1e-10) AS a, (reader_span_score - min(reader_span_score) OVER w) / (max(reader_span_score) OVER w - min(reader_span_score) OVER w + 1e-10) AS b FROM cand WHERE reader_status = 'valid_answer' WINDOW w AS (PARTITION BY question)),
 f AS (SELECT question, chunk_id, retrieval_rank, round(0.4 * a + 0.6 * b, 9) AS final_score FROM n) SELECT question, chunk_id, final_score, row_number() OVER (PARTITION BY question ORDER BY final_score DESC, retrieval_rank, chunk_id)::INT AS final_rank FROM f""")
def w3_w4_blended(t: Tables) -> DataFrame:
    return answers.blended(candidates(t)).select("question", "chunk_id", "final_score", "final_rank")


@query(f"WITH {CANDIDATES}, n AS (SELECT question, count(*) AS n, count(*) FILTER (reader_status = 'valid_answer') AS v FROM cand WHERE retrieval_score >= 0.4 GROUP BY question) SELECT q.question, CASE WHEN n IS NULL THEN 'retrieval_failed' WHEN v = 0 THEN 'reader_failed' ELSE 'valid_answer' END AS status FROM ({ALL_QUESTIONS}) q LEFT JOIN n ON n.question = q.question")
def w5_outcomes(t: Tables) -> DataFrame:
    return answers.outcomes(vector_questions(t), candidates(t), 0.4)


BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY reader_span_score DESC, chunk_id)::INT AS answer_rank FROM cand WHERE reader_status = 'valid_answer') WHERE answer_rank <= 5)"


@query(f"WITH {CANDIDATES}, {BEST} SELECT question, chunk_id, answer, reader_span_score, answer_rank FROM best")
def w6_best_candidates(t: Tables) -> DataFrame:
    return answers.best_candidates(candidates(t)).select("question", "chunk_id", "answer", "reader_span_score", "answer_rank")


@query(f"WITH {CANDIDATES}, {BEST} SELECT q.question, CASE WHEN answer IS NULL THEN '{answers.NONE}' WHEN reader_span_score < 5 THEN '{answers.BELOW}' ELSE answer END AS answer, CASE WHEN answer IS NULL THEN 'no_candidate_answer' WHEN reader_span_score < 5 THEN 'below_threshold' ELSE 'answered' END AS status, reader_span_score AS span_score FROM ({ALL_QUESTIONS}) q LEFT JOIN best b ON b.question = q.question AND answer_rank = 1")
def w7_fallback(t: Tables) -> DataFrame:
    return answers.with_fallback(vector_questions(t), candidates(t))


@query(f"WITH {CANDIDATES}, {BEST}, a AS (SELECT * FROM best WHERE answer_rank = 1), b AS (SELECT * FROM cand WHERE retrieval_rank = 2) SELECT q.question, a.answer AS reader_answer, a.reader_span_score AS reader_score, b.answer AS retrieval_answer, b.retrieval_score AS retrieval_score FROM ({ALL_QUESTIONS}) q LEFT JOIN a ON a.question = q.question LEFT JOIN b ON b.question = q.question")
def j11_strategies(t: Tables) -> DataFrame:
    c = candidates(t)
    reader = answers.best_candidates(c, 1).select("question", "answer", F.col("reader_span_score").alias("score"))
    first = c.filter("retrieval_rank = 2").select("question", "answer", F.col("retrieval_score").alias("score"))  # the first is the query itself
    return answers.strategies(vector_questions(t), {"reader": reader, "retrieval": first})


LOGITS = "logits AS (SELECT vec_id AS question_id, label AS chunk_id, i::INT AS token, i * 12 AS char_start, i * 12 + 11 AS char_end, embedding[i + 1]::DOUBLE AS start_logit, embedding[64 - i]::DOUBLE AS end_logit FROM (SELECT *, unnest(range(0, 64)) AS i FROM embeddings))"


def logits(t: Tables) -> DataFrame:
    """A vector's components as logits of 64 tokens of 11 characters and a blank; ends read them backwards."""
    rows = t.embeddings.select(F.col("vec_id").alias("question_id"), F.col("label").alias("chunk_id"), "embedding", F.posexplode("embedding").alias("token", "_s"))
    at = F.col("token") * 12
    return rows.select("question_id", "chunk_id", "token", at.alias("char_start"), (at + 11).alias("char_end"), F.col("_s").cast("double").alias("start_logit"), F.col("embedding")[63 - F.col("token")].cast("double").alias("end_logit"))


@query(f"""WITH {LOGITS}, s AS (SELECT a.question_id, a.chunk_id, a.token AS start_token, b.token AS end_token, round(a.start_logit + b.end_logit, 9) AS span_score FROM logits a JOIN logits b ON a.question_id = b.question_id AND b.token BETWEEN a.token AND a.token + 39 AND b.char_end - a.char_start BETWEEN 2 AND 400)
 SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY span_score DESC, start_token, end_token) AS r FROM s) WHERE r = 1""")
def w8_best_spans(t: Tables) -> DataFrame:
    return answers.best_spans(logits(t))


@query(f"""WITH {LOGITS}, a AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY start_logit DESC, token) AS r FROM logits), b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY end_logit DESC, token) AS r FROM logits),
 s AS (SELECT a.question_id, a.token AS start_token, b.token AS end_token, a.start_logit + b.end_logit AS x FROM a JOIN b ON a.question_id = b.question_id AND a.r <= 5 AND b.r <= 5 AND b.token BETWEEN a.token AND a.token + 39 AND b.char_end - a.char_start BETWEEN 2 AND 400),
 e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY question_id)) AS e FROM s) SELECT question_id, start_token, end_token, round(e / sum(e) OVER (PARTITION BY question_id), 9) AS confidence FROM e""")
def w9_span_confidence(t: Tables) -> DataFrame:
    found = answers.with_confidence(answers.spans(logits(t), n_best=5))
    return found.select("question_id", "start_token", "end_token", F.round("confidence", 9).alias("confidence"))


@query()
def p2_p5_hash_embeddings(t: Tables) -> DataFrame:
    embed = ports.embedder(ports.hash_model(64), 64)
    rows = ports.embed_chunks(inputs.as_chunks(t), embed)
    return rows.select("chunk_id", F.round(retrieve.norm(F.col("embedding")), 4).alias("norm"), F.round(F.col("embedding")[0], 6).alias("first"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'tion') THEN 'one' WHEN contains(text, 'the') THEN 'two' ELSE 'none' END AS completion FROM conversations")
def p4_scripted(t: Tables) -> DataFrame:
    script = t.spark.createDataFrame([(1, "tion", "one"), (2, "the", "two")], "position int, trigger string, response string")
    prompts = t.conversations.select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("prompt"))
    return ports.scripted(prompts, script, "none").select("query_id.conv_id", "query_id.turn", "completion")


@query(r"SELECT conv_id, turn, CASE WHEN contains(text, 'o') AND regexp_matches(substr(text, 1, 40), '\S') THEN regexp_replace(regexp_replace(substr(text, 1, 40), '^\s+', ''), '\s+$', '') END AS completion, CASE WHEN NOT contains(text, 'o') THEN 'ValueError: no o' WHEN NOT regexp_matches(substr(text, 1, 40), '\S') THEN 'empty completion' END AS error FROM conversations")
def p3_completions(t: Tables) -> DataFrame:
    """A model that repeats the question after some reasoning, and fails on questions without the letter o."""
    def load():  # noqa: ANN202
        def model(prompt: str, system: str | None) -> str:
            if "o" not in prompt:
                raise ValueError("no o")
            return "<think>" + prompt + "</think>" + prompt[:40]

        return model

    prompts = t.conversations.select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("system"))
    return ports.complete(prompts, load).select("query_id.conv_id", "query_id.turn", "completion", "error")


STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
LOG = f"""log AS (SELECT user_id AS doc_id, event_id AS seq, ts, {STATUS} AS status, CASE WHEN {STATUS} = 'failed' THEN 'E' || event_id END AS error, CASE WHEN {STATUS} = 'completed' THEN event_id % 90 END AS n_pages, CASE WHEN {STATUS} = 'completed' AND event_id % 2 = 0 THEN event_id % 700 END AS n_chunks FROM events)"""
FOLD = f"{LOG}, folded AS (SELECT doc_id, arg_max(status, seq) AS status, arg_max_null(error, seq) AS error, arg_max(n_pages, seq) AS n_pages, arg_max(n_chunks, seq) AS n_chunks, min(ts) AS created_at, max(ts) AS updated_at, max(seq) AS seq FROM log GROUP BY doc_id)"


def as_log(events: DataFrame) -> DataFrame:
    """Users as documents, their events as transitions."""
    status = F.expr(STATUS)
    rows = events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"))
    done = F.col("status") == "completed"
    return rows.withColumns({"error": F.when(F.col("status") == "failed", F.concat(F.lit("E"), "seq")), "n_pages": F.when(done, F.col("seq") % 90), "n_chunks": F.when(done & (F.col("seq") % 2 == 0), F.col("seq") % 700)})


@query(f"WITH {FOLD} SELECT doc_id, status, error, n_pages, n_chunks, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM folded")
def l1_l2_status_fold(t: Tables) -> DataFrame:
    f = lifecycle.fold(as_log(t.events))
    return f.select("doc_id", "status", "error", "n_pages", "n_chunks", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@query("SELECT user_id AS doc_id, event_id AS seq FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def l3_unknown_targets(t: Tables) -> DataFrame:
    log = as_log(t.events)
    return lifecycle.unknown_targets(log, log.filter("status = 'pending'")).select("doc_id", "seq")


@query(f"WITH {FOLD} SELECT doc_id, seq + 1 AS seq, 'failed' AS status, '{lifecycle.STALE}' AS error FROM folded WHERE status = 'processing'")
def l4_stale_reset(t: Tables) -> DataFrame:
    return lifecycle.reset_stale(as_log(t.events)).select("doc_id", "seq", "status", "error")


@query("SELECT DISTINCT k AS doc_id, lang, n_chars FROM (SELECT doc_id AS k FROM labels UNION ALL SELECT -1) LEFT JOIN documents d ON d.doc_id = k")
def l5_l6_lookup(t: Tables) -> DataFrame:
    keys = t.labels.select("doc_id").unionByName(t.spark.createDataFrame([(-1,)], "doc_id long"))
    docs = t.documents.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("content_hash"))
    return lifecycle.status_view(lifecycle.lookup(docs, keys))


@query(f"WITH {FOLD} SELECT doc_id, status, error, n_pages, n_chunks FROM folded")
def x3_live_status(t: Tables) -> DataFrame:
    """The fold as a stream over the table's files, run until they are read."""
    spark, folder = t.spark, scratch.new_path(t.spark, "live")
    schema, path = t.events.schema, f"{t.sf_dir}/events.parquet"
    single = spark.read.format("binaryFile").load(path).select("path").first()[0].rstrip("/").endswith("events.parquet")
    reader = spark.readStream.schema(schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(t.sf_dir) if single else reader.parquet(path)
    ingest.live_status(as_log(stream), f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return ingest.current_status(spark, f"{folder}/states").select("doc_id", "status", "error", "n_pages", "n_chunks")


PARSED = rf"""files AS (SELECT doc_id, 'doc-' || doc_id AS slug, doc_id % 50 = 7 AS broken, doc_id % 10 = 3 AS changed, text FROM documents),
 first AS (SELECT min(slug) AS slug FROM files WHERE NOT broken GROUP BY text, doc_id % 2), second AS (SELECT min(slug) AS slug FROM files WHERE changed GROUP BY text),
 parsed AS (SELECT doc_id, slug, regexp_replace(regexp_replace(CASE WHEN slug IN (SELECT slug FROM second) THEN text || ' changed.' ELSE text END, '^\s+', ''), '\s+$', '') AS text FROM files
  WHERE NOT broken AND (slug IN (SELECT slug FROM first) OR slug IN (SELECT slug FROM second))), {walk_sql(((1000, 200),)).replace("FROM documents", "FROM parsed").replace("JOIN documents", "JOIN parsed")}"""


def ingested(t: Tables) -> store.Store:
    """All documents as files, those of even number Markdown, the others notebooks, of which some are broken; ingested as a
    stream, then again, which changes nothing, then some that have changed."""
    spark, folder = t.spark, scratch.new_path(t.spark, "ingest")
    held, embed = store.Store(spark, f"{folder}/store", 8, parts=8, digits=1), ports.embedder(ports.hash_model(8), 8, errors=True)

    def files(text: Column) -> DataFrame:
        book = F.to_json(F.struct(F.array(F.struct(F.lit("markdown").alias("cell_type"), text.alias("source"))).alias("cells")))
        content = F.when(F.col("doc_id") % 2 == 0, text).when(F.col("doc_id") % 50 == 7, F.concat(F.lit('{"cells": ['), text)).otherwise(book)
        return t.documents.select("doc_id", F.concat(F.lit("doc-"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".ipynb")).alias("name"), content.alias("content"))

    changed = files(F.concat("text", F.lit(" changed."))).filter("doc_id % 10 = 3")
    for run, rows, times in (("first", files(F.col("text")), 2), ("second", changed, 1)):
        corpus.write_files(rows, f"{folder}/{run}")
        for _ in range(times):
            ingest.ingest_files(spark, f"{folder}/{run}", held, embed, scratch.new_path(spark, "checkpoint")).awaitTermination()
        scratch.remove(spark, f"{folder}/{run}")
    return held


@query(rf"""WITH RECURSIVE {PARSED}, n AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id) SELECT slug AS doc_id, 'completed' AS status, NULL AS error, coalesce(n, 0)::INT AS n_chunks, coalesce(n, 0) AS n_vectors FROM parsed LEFT JOIN n USING (doc_id)
 UNION ALL SELECT slug, 'failed', 'ValueError: not a notebook', NULL, 0 FROM files WHERE broken""")
def x1_x2_ingested(t: Tables) -> DataFrame:
    """What became of each document: completed, replaced by what it was changed to, or failed."""
    held = ingested(t)
    n = held.read("vectors").groupBy("doc_id").agg(F.count("*").alias("n_vectors"))
    return lifecycle.fold(held.read("events")).select("doc_id", "status", "error", "n_chunks").join(n, "doc_id", "left").fillna(0, ["n_vectors"])


@query(rf"WITH RECURSIVE {PARSED}, {inputs.bm25_sql(chunks='SELECT doc_id * 100000 + ordinal AS chunk_id, substr(text, a + 1, b - a) AS text FROM cut JOIN parsed USING (doc_id)', stemmed=True)} SELECT query_id, rank, score FROM hits")
def x1_searched(t: Tables) -> DataFrame:
    """Search of what was ingested, in the index that ingestion has kept up. Chunks' numbers are hashes, so scores stand for them."""
    return ingested(t).index.search(inputs.passages(t)).select("query_id", "rank", "score")


@query("SELECT item_id::VARCHAR AS id, text AS query, item_id % 2 = 0 AS answerable, (SELECT count(*) FROM benchmark)::INT AS n FROM benchmark")
def s10_s11_dataset(t: Tables) -> DataFrame:
    """Passages written as a data set, one JSON object a line, and read again."""
    path = scratch.new_path(t.spark, "dataset")
    n = corpus.write_dataset(t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), (F.col("item_id") % 2 == 0).alias("answerable")), path)
    rows, _ = corpus.read_dataset(t.spark, path)
    return rows.select("id", "query", "answerable", F.lit(n).cast("int").alias("n"))


@query("SELECT doc_id, sha256(text) AS text_sha256, length(text) AS n_chars, 1 AS version, length(text) - length(replace(text, chr(13), '')) + 1 AS n_returns FROM (SELECT doc_id, text || chr(13) || 'x' AS text FROM documents)")
def s7_s9_frozen(t: Tables) -> DataFrame:
    """Texts with a carriage return, frozen and read back; a text that had drifted would fail."""
    path = scratch.new_path(t.spark, "frozen")
    corpus.freeze(t.documents.select("doc_id", F.concat("text", F.lit("\rx")).alias("text")), path)
    rows = corpus.read_frozen(t.spark, path)
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("n_chars").cast("long").alias("n_chars"), "version", (F.length("text") - F.length(F.replace("text", F.lit("\r"), F.lit(""))) + 1).cast("long").alias("n_returns"))


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id")
def w11_in_order(t: Tables) -> DataFrame:
    return corpus.in_order(t.documents.select("doc_id", "source"), "source")


DATA = f"""{GRADES}, {ASKED}, rows AS (SELECT 'ret-' || (CASE WHEN query_id % 7 = 3 THEN '9' ELSE lpad(query_id::VARCHAR, 4, '0') END) AS id, * FROM asked)"""


def dataset(t: Tables) -> DataFrame:
    """Passages as a data set with faults: some ids of another form, an unknown type, answerable ones that lost their spans."""
    spans = inputs.spans(t).groupBy("query_id").agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "char_start", "char_end", F.when(F.col("query_id") % 4 == 1, "").otherwise(F.col("quote")).alias("quote"), F.when(F.col("query_id") % 4 == 2, 3).otherwise(F.col("grade")).alias("grade"))).alias("relevant_spans"))
    rows = asked(t).join(spans, "query_id", "left")
    number = F.when(F.col("query_id") % 7 == 3, "9").otherwise(F.lpad(F.col("query_id").cast("string"), 4, "0"))
    return rows.withColumns({
        "id": F.concat(F.lit("ret-"), number), "query": F.lit("q"), "query_type": F.when(F.col("query_id") % 5 == 0, "odd").otherwise(F.col("query_type")), "split": F.when(F.col("query_id") % 6 == 0, "train").otherwise("dev"),
        "relevant_spans": F.when(F.col("query_id") % 3 == 0, None).otherwise(F.col("relevant_spans")), "verified_by": F.when(F.col("query_id") % 2 == 0, "human"), "line_no": F.col("query_id"),
    })


@query(f"""WITH {DATA} SELECT id, 'unknown query_type' AS problem FROM rows WHERE query_id % 5 = 0 UNION ALL SELECT id, 'unknown split' FROM rows WHERE query_id % 6 = 0
 UNION ALL SELECT id, 'answerable without spans' FROM rows WHERE answerable AND query_id % 3 = 0 UNION ALL SELECT id, 'quote is empty' FROM rows WHERE answerable AND query_id % 4 = 1 AND query_id % 3 > 0
 UNION ALL SELECT id, 'grade is not 1 or 2' FROM rows WHERE answerable AND query_id % 4 = 2 AND query_id % 3 > 0 UNION ALL SELECT id, 'id has another form' FROM rows WHERE query_id % 7 = 3 UNION ALL SELECT id, 'not verified by a human' FROM rows WHERE query_id % 2 = 1""")
def v1_v5_problems(t: Tables) -> DataFrame:
    return validate.problems(dataset(t), strict=True)


@query(f"WITH {DATA} SELECT id, query_id FROM rows WHERE query_id % 7 = 3 AND query_id <> (SELECT min(query_id) FROM rows WHERE query_id % 7 = 3)")
def u3_repeated_ids(t: Tables) -> DataFrame:
    return validate.repeated_ids(dataset(t)).select("id", "query_id")


@query("SELECT count(*) AS n_unverified FROM benchmark WHERE item_id % 2 = 1")
def a10_unverified(t: Tables) -> DataFrame:
    return validate.unverified(dataset(t))


@query("SELECT item_id AS query_id FROM benchmark WHERE item_id % 6 <> 0")
def v8_split(t: Tables) -> DataFrame:
    return validate.of_split(dataset(t), "dev").select("query_id")


@query(f"WITH {SOURCES}, {GRADES}, {ASKED} SELECT count(*) AS n_unanswerable, round(avg((query_id IN (SELECT query_id FROM src))::INT), 9) AS false_answer_rate FROM asked WHERE NOT answerable")
def a20_false_answers(t: Tables) -> DataFrame:
    """Questions with any source get an answer."""
    rows = answers.prompts(questions(t), sources(t)).select("query_id", F.coalesce("answer", F.lit("some answer")).alias("answer"))
    out = evaluate.false_answer_rate(rows.join(asked(t), "query_id"))
    return out.withColumn("false_answer_rate", F.round("false_answer_rate", 9))


@query("""WITH c AS (SELECT source AS split, lang, count(*) AS n FROM documents GROUP BY ALL), g(lang, target) AS (VALUES ('en', 60.0::DOUBLE), ('fr', 15.0), ('de', 15.0), ('es', 10.0)), s AS (SELECT DISTINCT split FROM c)
 SELECT s.split, g.lang, round(coalesce(100.0 * n / (SELECT sum(n) FROM c x WHERE x.split = s.split), 0), 9) AS share, target, abs(coalesce(100.0 * n / (SELECT sum(n) FROM c x WHERE x.split = s.split), 0) - target) > 5 AS drifted FROM s CROSS JOIN g LEFT JOIN c ON c.split = s.split AND c.lang = g.lang""")
def a22_stratification(t: Tables) -> DataFrame:
    """Sources as splits, languages as types."""
    targets = t.spark.createDataFrame([("en", 60.0), ("fr", 15.0), ("de", 15.0), ("es", 10.0)], "lang string, target double")
    out = evaluate.stratification(t.documents.select(F.col("source").alias("split"), "lang"), targets, by="lang")
    return out.withColumn("share", F.round("share", 9))


@query("""WITH p AS (SELECT lang AS answer_tier, n_chars % 5 AS h, (n_chars % 5 + doc_id % 3) % 5 AS j FROM documents),
 r AS (SELECT *, rank() OVER (PARTITION BY answer_tier ORDER BY h) + (count(*) OVER (PARTITION BY answer_tier, h) - 1) / 2 AS rh, rank() OVER (PARTITION BY answer_tier ORDER BY j) + (count(*) OVER (PARTITION BY answer_tier, j) - 1) / 2 AS rj FROM p),
 a AS (SELECT answer_tier, count(*) AS n, corr(rh, rj) AS rho, sum((h - j) * (h - j)) AS seen, avg(abs(h - j)) AS mae FROM r GROUP BY ALL),
 hs AS (SELECT answer_tier, h, count(*) AS n FROM p GROUP BY ALL), js AS (SELECT answer_tier, j, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT hs.answer_tier, sum(hs.n * js.n * (h - j) * (h - j)) AS chance FROM hs JOIN js ON hs.answer_tier = js.answer_tier GROUP BY ALL)
 SELECT a.answer_tier, n AS n_pairs, round(rho, 9) AS spearman, round(1 - seen::DOUBLE * n / chance, 9) AS kappa, round(mae, 9) AS mae FROM a JOIN c ON a.answer_tier = c.answer_tier""")
def a23_judge_agreement(t: Tables) -> DataFrame:
    pairs = t.documents.select(F.col("lang").alias("answer_tier"), (F.col("n_chars") % 5).alias("human_score"), ((F.col("n_chars") % 5 + F.col("doc_id") % 3) % 5).alias("judge_score"))
    return evaluate.judge_agreement(pairs)


@query(f"""WITH {inputs.SPANS}, c AS (SELECT query_id AS id, count(*) AS n_claims, round(avg((grade = 2)::INT), 9) AS claim_coverage FROM spans GROUP BY ALL), m AS (SELECT query_id AS id, round(avg((doc_id % 2 = 0)::INT), 9) AS citation_accuracy FROM spans GROUP BY ALL)
 SELECT c.id, n_claims, claim_coverage, citation_accuracy FROM c JOIN m ON c.id = m.id""")
def a24_claim_report(t: Tables) -> DataFrame:
    """Spans as claims, present where the grade is 2; cited by a part of the span in documents of even number."""
    s = inputs.spans(t).withColumnRenamed("query_id", "id")
    claims = s.select("id", F.col("quote").alias("claim"), (F.col("grade") == 2).alias("present"))
    cited = s.filter("doc_id % 2 = 0").select("id", "doc_id", "char_start", (F.col("char_start") + 5).alias("char_end"))
    out = evaluate.claim_report(claims, cited, s.select("id", "doc_id", "char_start", "char_end"))
    return out.withColumns({c: F.round(c, 9) for c in ("claim_coverage", "citation_accuracy")})


