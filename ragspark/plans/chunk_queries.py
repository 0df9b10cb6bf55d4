"""Chunkers, provenance, audits, and the reports on chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.operators import chunk, evaluate, lifecycle, spans
from ragspark.plans import inputs
from ragspark.plans.inputs import SPANS, WINDOWS, WORDS
from ragspark.plans.registry import Tables, query
from ragspark.plans.text_queries import CLEAN_PAGE, PARTS, SENTENCES, pages
from ragspark.sources import corpus, store

C2 = f"{WORDS}, c2 AS (SELECT doc_id, start_word::INT AS start_word, w[start_word + 1 : start_word + 180] AS c FROM (SELECT doc_id, w, unnest(range(0, len(w), 140)) AS start_word FROM words))"
C3 = f"""{WORDS}, c3a AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 180 THEN 1 ELSE ceil((len(w) - 180) / 140.0)::BIGINT + 1 END)) AS ordinal FROM words WHERE len(w) > 0),
 c3 AS (SELECT doc_id, ordinal::INT AS ordinal, (ordinal * 140)::INT AS start_word, least(ordinal * 140 + 180, len(w))::INT AS end_word, w[ordinal * 140 + 1 : ordinal * 140 + 180] AS c FROM c3a WHERE least(ordinal * 140 + 180, len(w)) - ordinal * 140 >= 30)"""


def walk_sql(sizes: tuple[tuple[int, int], ...]) -> str:
    """Common table expressions that end in cut (config_id, size, overlap, doc_id, ordinal, a, b): one step for each chunk."""
    skipped = r"({0} + length(substr(text, ({0}) + 1)) - length(regexp_replace(substr(text, ({0}) + 1), '^\s+', '')))"
    cut = " ".join(f"WHEN contains(win, {b}) THEN low + length(win) - strpos(reverse(win), reverse({b})) + 1" for b in ("chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '", "' '"))
    return rf"""cfg(config_id, size, overlap) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(sizes))}),
 step AS (SELECT config_id, size, overlap, doc_id, -1 AS ordinal, NULL::BIGINT AS a, NULL::BIGINT AS b, {skipped.format("0")} AS pos FROM documents, cfg
  UNION ALL SELECT config_id, size, overlap, doc_id, ordinal + 1, pos, kept, CASE WHEN pos + size >= length(text) THEN length(text) ELSE {skipped.format("CASE WHEN kept - overlap > pos THEN kept - overlap ELSE kept END")} END FROM
   (SELECT *, pos + length(regexp_replace(substr(text, pos + 1, stop - pos), '\s+$', '')) AS kept FROM
    (SELECT *, CASE WHEN pos + size >= length(text) THEN length(text) {cut} ELSE pos + size END AS stop FROM
     (SELECT *, pos + size * 6 // 10 AS low, substr(text, pos + size * 6 // 10 + 1, size - size * 6 // 10) AS win FROM step JOIN documents USING (doc_id) WHERE pos < length(text))))),
 cut AS (SELECT * FROM step WHERE ordinal >= 0)"""


@query(f"WITH RECURSIVE {walk_sql(((1000, 200),))} SELECT doc_id, ordinal::INT AS ordinal, substr(text, a + 1, b - a) AS text, a::INT AS source_start, b::INT AS source_end FROM cut JOIN documents USING (doc_id)")
def c1_char_chunks(t: Tables) -> DataFrame:
    return chunk.char_chunks(t.documents)


@query(f"WITH {C2} SELECT doc_id, start_word, array_to_string(c, ' ') AS chunk_text, len(c)::INT AS word_count, length(array_to_string(c, ' '))::INT AS character_count, substr(array_to_string(c, ' '), 1, 300) AS preview FROM c2")
def c2_word_chunks(t: Tables) -> DataFrame:
    return chunk.word_chunks(t.documents, key="doc_id")


@query(f"WITH {C3} SELECT doc_id, ordinal, start_word, end_word, array_to_string(c, ' ') AS text, len(c)::INT AS num_words, length(array_to_string(c, ' '))::INT AS num_characters FROM c3")
def c3_word_chunks_to_end(t: Tables) -> DataFrame:
    return chunk.word_chunks_to_end(t.documents, key="doc_id")


C4 = rf"""{SENTENCES}, pieces AS (SELECT doc_id, p, w, unnest(range(0, len(w), 250)) AS x FROM (SELECT doc_id, p, list_filter(regexp_split_to_array(s[p], '\s+'), lambda x: x <> '') AS w FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p FROM sentences))),
 units AS MATERIALIZED (SELECT doc_id, list(array_to_string(w[x + 1 : x + 250], ' ') ORDER BY p, x) AS u, list(len(w[x + 1 : x + 250]) ORDER BY p, x) AS n FROM pieces GROUP BY doc_id),
 step AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS first, 0::BIGINT AS held, NULL::BIGINT AS a FROM units
  UNION ALL SELECT doc_id, i + 1, begin, coalesce(list_sum(n[begin + 1 : i]), 0)::BIGINT + n[i + 1], CASE WHEN begin > first OR full_ THEN first END FROM
   (SELECT *, CASE WHEN full_ THEN list_filter(range(greatest(first, i - 2), i + 1), lambda f: coalesce(list_sum(n[f + 1 : i]), 0) + n[i + 1] <= 250)[1] ELSE first END AS begin FROM
    (SELECT step.*, n, i > first AND held + n[i + 1] > 250 AS full_ FROM step JOIN units USING (doc_id) WHERE i < len(n)))),
 packs AS (SELECT doc_id, a, i - 1 AS b FROM step WHERE a IS NOT NULL UNION ALL SELECT doc_id, first, i FROM step JOIN units USING (doc_id) WHERE i = len(n)),
 c4 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b)::INT - 1 AS ordinal, (b - a)::INT AS num_sentences, array_to_string(u[a + 1 : b], ' ') AS t FROM packs JOIN units USING (doc_id)),
 c4c AS (SELECT doc_id, ordinal, num_sentences, {CLEAN_PAGE.format("t")} AS chunk_text FROM c4)"""


@query(rf"WITH RECURSIVE {C4} SELECT doc_id, ordinal, num_sentences, chunk_text, len(list_filter(regexp_split_to_array(chunk_text, '\s+'), lambda x: x <> ''))::INT AS word_count, length(chunk_text)::INT AS character_count, substr(chunk_text, 1, 300) AS preview FROM c4c")
def c4_sentence_chunks(t: Tables) -> DataFrame:
    return chunk.sentence_chunks(t.documents, key="doc_id")


@query(r"SELECT doc_id, 0 AS n_faults, length(regexp_replace(text, '\s+$', ''))::INT AS reached FROM documents WHERE regexp_matches(text, '\S')")
def c5_chunk_audit(t: Tables) -> DataFrame:
    """Faults of each document's chunks, and how far they reach."""
    chunks = chunk.char_chunks(t.documents)
    faults = chunk.chunk_faults(chunks, t.documents).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_faults"))
    reached = chunks.groupBy("doc_id").agg(F.max("source_end").alias("reached"))
    return reached.join(faults, "doc_id", "left").fillna(0, ["n_faults"])


@query(f"""WITH {PARTS}, seg AS (SELECT doc_id, page, coalesce(sum(length(text) + 2) OVER w, 0) AS s, coalesce(sum(length(text) + 2) OVER w, 0) + length(text) AS e, CASE WHEN length(text) >= 100 THEN 'text' ELSE 'ocr' END AS extraction FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 {WINDOWS}, met AS (SELECT c.chunk_id, seg.*, row_number() OVER (PARTITION BY c.chunk_id ORDER BY least(source_end, e) - greatest(source_start, s) DESC, s) AS r FROM chunks c JOIN seg ON seg.doc_id = c.doc_id AND source_start < e AND source_end > s)
 SELECT c.chunk_id, c.doc_id, coalesce(extraction, 'text') AS extraction, page FROM chunks c LEFT JOIN met ON met.chunk_id = c.chunk_id AND r = 1""")
def c6_provenance(t: Tables) -> DataFrame:
    routed = corpus.route_pages(pages(t))
    _, segments = corpus.assemble(routed, extraction=F.col("extraction"))
    return chunk.with_provenance(inputs.windows(t), segments.withColumn("page", F.col("page").cast("long"))).select("chunk_id", "doc_id", "extraction", "page")


@query(f"WITH RECURSIVE {walk_sql(((500, 100), (1000, 200), (2000, 400)))} SELECT config_id, size AS chunk_size, overlap, count(*) AS n_chunks, sum(b - a)::BIGINT AS n_chars FROM cut GROUP BY ALL")
def c7_size_sweep(t: Tables) -> DataFrame:
    swept = chunk.swept(t.documents, [(500, 100), (1000, 200), (2000, 400)])
    return swept.groupBy("config_id", "chunk_size", "overlap").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {WINDOWS} SELECT doc_id, ordinal, row_number() OVER (ORDER BY doc_id, ordinal) AS chunk_id FROM chunks")
def c8_dense_ids(t: Tables) -> DataFrame:
    return chunk.with_ids(inputs.windows(t).drop("chunk_id"), exact=True).select("doc_id", "ordinal", "chunk_id")


@query(f"WITH {C2} SELECT doc_id, count(*) AS number_of_chunks, round(avg(len(c)), 6) AS avg_words_per_chunk FROM c2 GROUP BY doc_id")
def a13_chunk_distribution(t: Tables) -> DataFrame:
    return evaluate.chunk_distribution(chunk.word_chunks(t.documents, key="doc_id"), "doc_id")


@query(f"""WITH {C2}, s AS (SELECT len(c) AS word_count, length(array_to_string(c, ' ')) AS character_count FROM c2)
 SELECT count(*) AS n_chunks, min(word_count)::INT AS min_word_count, max(word_count)::INT AS max_word_count, round(avg(word_count), 6) AS avg_word_count, min(character_count)::INT AS min_character_count, max(character_count)::INT AS max_character_count, round(avg(character_count), 6) AS avg_character_count, median(word_count) AS median_word_count FROM s""")
def a14_chunk_sizes(t: Tables) -> DataFrame:
    return evaluate.size_statistics(chunk.word_chunks(t.documents, key="doc_id"), ("word_count", "character_count"))


@query(f"WITH {C2} SELECT doc_id, start_word, len(c)::INT AS n_words FROM c2 WHERE len(c) < 30")
def a15_small_chunks(t: Tables) -> DataFrame:
    return evaluate.small(chunk.word_chunks(t.documents, key="doc_id"), 30, "chunk_text").select("doc_id", "start_word", "n_words")


@query(f"WITH {WINDOWS} SELECT d.doc_id, count(chunk_id) AS n_chunks FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id UNION ALL SELECT NULL, count(*) FROM chunks")
def a11_chunk_counts(t: Tables) -> DataFrame:
    counts = inputs.windows(t).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    every = t.documents.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["n_chunks"])
    return every.unionByName(every.agg(F.sum("n_chunks").alias("n_chunks")).withColumn("doc_id", F.lit(None).cast("long")))


RESOLVED = """resolved AS (SELECT s.*, c.chunk_id, round((least(char_end, source_end) - greatest(char_start, source_start)) / least(char_end - char_start, source_end - source_start), 9) AS overlap
  FROM spans s JOIN chunks c ON c.doc_id = s.doc_id AND char_start < source_end AND char_end > source_start)"""


@query(f"WITH {WINDOWS}, {SPANS}, {RESOLVED} SELECT query_id, doc_id, chunk_id, grade, overlap FROM resolved WHERE overlap >= 0.5")
def j1_resolve_spans(t: Tables) -> DataFrame:
    out = spans.resolve(inputs.spans(t), inputs.windows(t))
    return out.select("query_id", "doc_id", "chunk_id", "grade", F.round("overlap", 9).alias("overlap"))


@query(f"WITH {WINDOWS}, {SPANS}, {RESOLVED} SELECT query_id, doc_id, char_start, char_end FROM spans WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM resolved WHERE overlap >= 0.99)")
def j2_unresolved_spans(t: Tables) -> DataFrame:
    s = inputs.spans(t)
    return spans.unresolved(s, spans.resolve(s, inputs.windows(t), 0.99)).select("query_id", "doc_id", "char_start", "char_end")


@query(f"WITH {WINDOWS}, {SPANS}, {RESOLVED} SELECT query_id, chunk_id, max(grade) AS grade FROM resolved WHERE overlap >= 0.5 GROUP BY ALL")
def a1_chunk_grades(t: Tables) -> DataFrame:
    return spans.grades(spans.resolve(inputs.spans(t), inputs.windows(t)))


def moved(t: Tables) -> DataFrame:
    """Labels, some moved, some of other documents."""
    s = inputs.spans(t)
    by = F.when(F.col("query_id") % 3 == 1, F.lit(1)).when(F.col("query_id") % 3 == 2, F.lit(1_000_000)).otherwise(0)
    return s.withColumns({"char_start": F.col("char_start") + by, "char_end": F.col("char_end") + by, "doc_id": F.when(F.col("grade") == 1, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))})


MOVED = """moved AS (SELECT query_id, CASE WHEN grade = 1 THEN -doc_id - 1 ELSE doc_id END AS doc_id, (char_start + (CASE query_id % 3 WHEN 1 THEN 1 WHEN 2 THEN 1000000 ELSE 0 END))::INT AS char_start,
  (char_end + (CASE query_id % 3 WHEN 1 THEN 1 WHEN 2 THEN 1000000 ELSE 0 END))::INT AS char_end, quote FROM spans)"""


@query(f"""WITH {SPANS}, {MOVED} SELECT m.query_id, m.doc_id, m.char_start, m.char_end, CASE WHEN d.doc_id IS NULL THEN 'no document' WHEN char_end > length(text) THEN 'past the end'
 WHEN NOT contains(substr(text, char_start + 1, char_end - char_start), quote) THEN 'quote not found' END AS reason FROM moved m LEFT JOIN documents d ON d.doc_id = m.doc_id""")
def j6_verify_anchors(t: Tables) -> DataFrame:
    return spans.verify(moved(t), t.documents).select("query_id", "doc_id", "char_start", "char_end", "reason")


@query(f"WITH {WINDOWS}, {SPANS}, {MOVED} SELECT DISTINCT doc_id FROM moved WHERE doc_id NOT IN (SELECT doc_id FROM chunks)")
def j7_unindexed_documents(t: Tables) -> DataFrame:
    return spans.unindexed(moved(t), inputs.windows(t))


@query("""SELECT doc_id AS chunk_id, 'chunk without vector' AS fault FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
 UNION ALL SELECT vec_id, 'vector without chunk' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT doc_id, 'chunk without postings' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND regexp_matches(text, '[\\p{L}\\p{N}]')
 UNION ALL SELECT DISTINCT doc_id, 'postings without chunk' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def j12_s14_consistency(t: Tables) -> DataFrame:
    """Documents as chunks, labelled documents as those with postings, vectors by their number."""
    return store.disagreements(inputs.as_chunks(t), t.labels.select(F.col("doc_id").alias("chunk_id")), inputs.vectors(t))


@query("""SELECT 'unknown status' AS fault, doc_id::VARCHAR AS "key" FROM documents WHERE lang = 'fr'
 UNION ALL SELECT 'content hash not unique', sha256(text) FROM documents GROUP BY sha256(text) HAVING count(*) > 1
 UNION ALL SELECT 'chunk is empty', doc_id::VARCHAR FROM labels WHERE quality = 0
 UNION ALL SELECT 'ordinal not unique', doc_id || ':' || 0 FROM labels GROUP BY doc_id HAVING count(*) > 1
 UNION ALL SELECT 'chunk without document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'vector of wrong width', vec_id::VARCHAR FROM embeddings WHERE len(embedding) <> 32""")
def l7_constraint_audit(t: Tables) -> DataFrame:
    """French documents get a status that does not exist; labels play chunks, of no length where the quality is 0."""
    docs = t.documents.select("doc_id", F.when(F.col("lang") == "fr", "lost").otherwise("completed").alias("status"), F.sha2("text", 256).alias("content_hash"))
    chunks = t.labels.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("ordinal"), F.lit(0).alias("source_start"), F.col("quality").alias("source_end"))
    return lifecycle.audit(docs, chunks, inputs.vectors(t), 32)


