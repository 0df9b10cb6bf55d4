"""Text functions, identity and duplicates over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.stem import with_stems
from ragspark.operators import evaluate
from ragspark.plans.inputs import PAGES, TOKENS, pages
from ragspark.plans.registry import Tables, query
from ragspark.plans.stem_sql import stems_sql
from ragspark.sources import corpus, store

SQUEEZE = r"regexp_replace(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ ', ''), ' $', '')"
CLEAN_PAGE = SQUEEZE.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(13), chr(10)), '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\s+', ' ', 'g'), ' +([.,;:!?])', '\1', 'g'), '([(\[{{]) +', '\1', 'g'), ' +([)\]}}])', '\1', 'g')")
EXTRACTED = SQUEEZE.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\s+', ' ', 'g'), ' +([.,;:!?%)\]])', '\1', 'g'), '([(\[]) +', '\1', 'g')")
ANSWER = r"regexp_replace(regexp_replace({0}, '^[ ,.;:-]+', ''), '[ ,.;:-]+$', '')".format(SQUEEZE.format(r"regexp_replace(regexp_replace(regexp_replace(replace(replace(text, ' ##', ''), '##', ''), '\s+', ' ', 'g'), ' +([.,;:!?%)\]])', '\1', 'g'), '([(\[]) +', '\1', 'g')"))
SUFFIX = "(['.pdf', '.MD', '.ipynb', '.PNG', '.txt'])[(doc_id % 5 + 1)::INT]"
FOLDER = "(['arXiv', 'Course-2', 'notebooks', 'images', 'misc'])[(doc_id % 5 + 1)::INT]"


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS stripped FROM documents")
def f1_strip(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.strip(F.col("text")).alias("stripped"))


@query(f"SELECT doc_id, {SQUEEZE.format('text')} AS cleaned FROM documents")
def f2_clean_plain(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.clean_plain(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {EXTRACTED.format('text')} AS cleaned FROM documents")
def f3_clean_extracted(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.clean_extracted(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {CLEAN_PAGE.format('text')} AS cleaned FROM documents")
def f4_clean_page(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.clean_page(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {ANSWER} AS answer FROM documents")
def f5_clean_answer(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.clean_answer(F.col("text")).alias("answer"))


@query(rf"WITH {PAGES} SELECT doc_id, page, length(trim(text)) >= 2 AND lower(trim(text)) NOT IN ('[cls]', '[sep]', '[pad]') AS reasonable FROM pages")
def f6_is_reasonable_answer(t: Tables) -> DataFrame:
    return pages(t).select("doc_id", F.col("page").cast("long").alias("page"), tx.is_reasonable_answer(F.col("text")).alias("reasonable"))


#: Ends of sentences are marked by one control character, those after abbreviations unmarked again.
SENTENCES = rf"""marked AS (SELECT doc_id, regexp_replace(regexp_replace({CLEAN_PAGE.format("text")}, '([.!?]) +([A-Z0-9"(\[])', '\1' || chr(30) || '\2', 'g'), '(e\.g\.|i\.e\.|Fig\.|fig\.|Eq\.|eq\.|Dr\.|Mr\.|Ms\.|Prof\.|vs\.|et al\.)' || chr(30), '\1 ', 'g') AS t FROM documents),
 sentences AS (SELECT doc_id, list_filter(string_split(t, chr(30)), lambda x: x <> '') AS s FROM marked)"""


@query(f"WITH {SENTENCES} SELECT doc_id, len(s) AS n_sentences, array_to_string(s, '|') AS sentences FROM sentences")
def f7_sentences(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words, length(text) AS n_characters, substr(text, 1, 300) AS preview FROM documents")
def f8_word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_characters"), tx.preview(F.col("text")).alias("preview"))


@query(r"SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+'), ' ') AS tokens FROM conversations")
def f9_query_tokens(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(tx.query_tokens(F.col("text")), " ").alias("tokens"))


@query(rf"SELECT item_id, term, count(*) AS mult FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL")
def f10_query_bag(t: Tables) -> DataFrame:
    terms = t.benchmark.select("item_id", F.explode(tx.index_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count("*").alias("mult"))


@query(rf"WITH raw AS (SELECT unnest({TOKENS.format('text')}) AS term FROM documents), n AS (SELECT term, count(*) AS n FROM raw GROUP BY term), {stems_sql('SELECT term AS w FROM n')} SELECT s AS term, sum(n)::BIGINT AS n FROM n JOIN stems ON w = term GROUP BY s")
def f11_stemmed_terms(t: Tables) -> DataFrame:
    terms = t.documents.select("doc_id", F.explode(tx.index_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return with_stems(terms).groupBy("term").agg(F.sum("n").alias("n"))


@query(r"SELECT conv_id, turn, text AS completion, false AS failed FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, '', true FROM conversations WHERE turn % 2 = 1")
def f12_strip_reasoning(t: Tables) -> DataFrame:
    """Even turns: reasoning before the text. Odd turns: reasoning only."""
    said = F.concat(F.lit("<think>"), "text", F.lit("\n</THINK> "), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""))
    out = t.conversations.select("conv_id", "turn", tx.strip_reasoning(said).alias("completion"))
    return out.withColumn("failed", F.col("completion") == "")


@query("SELECT conv_id, turn, array_to_string(CASE WHEN turn BETWEEN 1 AND 4 AND turn NOT IN (2, 3) THEN [2, turn, 3] ELSE [2, 3] END, ',') AS cited FROM conversations")
def f13_cited_indices(t: Tables) -> DataFrame:
    said = F.concat(F.lit("a [2] b ["), F.col("turn").cast("string"), F.lit("] c [0][3] d [2] [99999999999]"))
    return t.conversations.select("conv_id", "turn", F.array_join(tx.cited_indices(said, F.lit(4)), ",").alias("cited"))


@query("SELECT conv_id, turn, CASE WHEN length(text) < 1 THEN 'query is empty' WHEN length(text) > 1000 THEN 'query is too long' WHEN turn * 13 NOT BETWEEN 1 AND 50 THEN 'top_k is out of range' END AS reason FROM conversations")
def f16_length_verdict(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.length_verdict(F.col("text"), F.col("turn") * 13).alias("reason"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(source || ' (V' || doc_id || ')!'), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') AS slug FROM documents")
def t2_slug(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.slug(F.concat("source", F.lit(" (V"), "doc_id", F.lit(")!"))).alias("slug"))


def paths(t: Tables) -> DataFrame:
    """Files of the documents' numbers in folders of all kinds."""
    one = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), one("arXiv", "Course-2", "notebooks", "images", "misc"), F.lit("/"), "doc_id", one(".pdf", ".MD", ".ipynb", ".PNG", ".txt"))
    return t.documents.select("doc_id", path.alias("path"), (F.col("n_chars") * 10_000).alias("length"))


@query("SELECT doc_id, (['pdf', 'markdown', 'notebook', 'image', 'unknown'])[(doc_id % 5 + 1)::INT] AS by_suffix, (['arxiv', 'course_notes', 'notebook', 'image', 'unknown'])[(doc_id % 5 + 1)::INT] AS by_folder FROM documents")
def t4_t5_source_types(t: Tables) -> DataFrame:
    return paths(t).select("doc_id", corpus.type_by_suffix(F.col("path")).alias("by_suffix"), corpus.type_by_folder(F.col("path")).alias("by_folder"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'unsupported type; allowed: .pdf, .md, .ipynb, .png, .jpg, .jpeg' WHEN n_chars * 10000 > 104857600 THEN 'larger than 100 MB' END AS reject_reason FROM documents")
def t10_t11_gates(t: Tables) -> DataFrame:
    return corpus.gate(paths(t)).select("doc_id", "reject_reason")


@query("SELECT doc_id, sha256(encode(text || chr(0))) AS content_sha256, sha256(text) AS text_sha256, length(text) AS n_chars FROM documents")
def t6_t7_hashes(t: Tables) -> DataFrame:
    """Of texts as files with a last byte 0, and of texts."""
    content = F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\0")))
    return t.documents.select("doc_id", F.sha2(content, 256).alias("content_sha256"), F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY sha256(text)")
def t8_first_by_hash(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return corpus.first_by_hash(rows, order=("doc_id",)).select("doc_id", "content_hash")


@query("SELECT DISTINCT lang || '-' || n_chars AS doc_id, sha256(text) AS content_hash FROM documents WHERE lang || '-' || n_chars IN (SELECT lang || '-' || n_chars FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1)")
def t9_id_collisions(t: Tables) -> DataFrame:
    """Names of language and length, which different texts share."""
    rows = t.documents.select(F.concat_ws("-", "lang", "n_chars").alias("doc_id"), F.sha2("text", 256).alias("content_hash"))
    return corpus.id_collisions(rows)


@query(rf"WITH {PAGES} SELECT doc_id, page, CASE WHEN length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) >= 100 THEN 'text' ELSE 'ocr' END AS extraction FROM pages")
def s6_route_pages(t: Tables) -> DataFrame:
    return corpus.route_pages(pages(t)).select("doc_id", F.col("page").cast("long").alias("page"), "extraction")


@query("SELECT doc_id FROM documents WHERE contains(text, 'tion')")
def s8_drift(t: Tables) -> DataFrame:
    """Hashes of the texts, against texts that have been edited since."""
    frozen = t.documents.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.replace("text", F.lit("tion"), F.lit("sion")).alias("text"))
    return corpus.drift(frozen).select("doc_id")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, 'xx', n_chars + 1 FROM documents WHERE lang = 'fr'")
def s12_replace(t: Tables) -> DataFrame:
    table = t.documents.select("doc_id", "lang", "n_chars")
    new = table.filter("lang = 'fr'").withColumns({"lang": F.lit("xx"), "n_chars": F.col("n_chars") + 1})
    return store.replaced(table, new)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s13_delete(t: Tables) -> DataFrame:
    return store.without(t.documents.select("doc_id", "lang"), t.labels.filter("toxic = 1"))


@query(rf"WITH {PAGES}, p AS (SELECT * FROM pages WHERE page BETWEEN 2 AND 4) SELECT doc_id, {SQUEEZE.format('string_agg(text, chr(32) ORDER BY page)')} AS text FROM p GROUP BY doc_id")
def s15_page_range(t: Tables) -> DataFrame:
    return corpus.page_range(pages(t), 2, 4)


STRIPPED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
PARTS = f"{PAGES}, parts AS (SELECT * FROM (SELECT doc_id, page, {STRIPPED} AS text FROM pages) WHERE text <> '')"


@query(f"WITH {PARTS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM parts GROUP BY doc_id")
def t1_assembled(t: Tables) -> DataFrame:
    return corpus.assemble(pages(t))[0]


@query(f'WITH {PARTS} SELECT doc_id, page, (coalesce(sum(length(text) + 2) OVER w, 0))::INT AS start, (coalesce(sum(length(text) + 2) OVER w, 0) + length(text))::INT AS "end" FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')
def t1_segments(t: Tables) -> DataFrame:
    return corpus.assemble(pages(t))[1].select("doc_id", F.col("page").cast("long").alias("page"), "start", "end")


@query(f"""WITH {PARTS}, s AS (SELECT doc_id, count(*) AS n_segments, sum(length(text)) + 2 * (count(*) - 1) AS n_chars FROM parts GROUP BY doc_id)
 SELECT doc_id, n_chars::BIGINT AS n_chars, n_segments FROM s UNION ALL SELECT NULL, sum(n_chars)::BIGINT, sum(n_segments)::BIGINT FROM s""")
def a12_corpus_summary(t: Tables) -> DataFrame:
    return evaluate.corpus_summary(*corpus.assemble(pages(t)))


@query(rf"""WITH n AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
 SELECT count(*) AS n_rows, round(avg(n), 6) AS mean, round(stddev(n), 6) AS std, min(n)::INT AS least, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n)::INT AS greatest, count(*) FILTER (n > 512) AS n_over FROM n""")
def a16_length_distribution(t: Tables) -> DataFrame:
    return evaluate.length_distribution(t.documents, 512)


@query(rf"""WITH {PAGES}, c AS (SELECT doc_id, page, text, {CLEAN_PAGE.format("text")} AS t FROM pages)
 SELECT doc_id, page, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS raw_words, length(text)::INT AS raw_chars, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''))::INT AS clean_words, length(t)::INT AS clean_chars FROM c""")
def a17_cleaning_report(t: Tables) -> DataFrame:
    rows = pages(t).withColumn("key", F.struct("doc_id", F.col("page").cast("long").alias("page")))
    return evaluate.cleaning_report(rows, key="key").select("key.doc_id", "key.page", "raw_words", "raw_chars", "clean_words", "clean_chars")


@query(rf"WITH {PAGES} SELECT doc_id, page, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS n_words FROM pages WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 20")
def a15_low_text_pages(t: Tables) -> DataFrame:
    return evaluate.small(pages(t), 20, "text").select("doc_id", F.col("page").cast("long").alias("page"), "n_words")
