"""What the queries derive from the tables before an operator runs, in DataFrames and in SQL.

Lines of documents play pages; fixed windows of characters play chunks where SQL must make them too; passages of
`benchmark` that documents hold play labelled queries; vectors play documents with the same number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.plans.registry import Tables
from ragspark.plans.stem_sql import stems_sql
from ragspark.sources import scratch

WINDOW, STEP = 1000, 800
#: Rows of runs of words that a batch has, about.
AT_ONCE = 100_000

PAGES = r"""pages AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)"""
WORDS = r"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)"""
WINDOWS = f"""windows AS (SELECT doc_id, text AS whole, unnest(range(0, greatest(length(text) - {WINDOW - STEP}, 1), {STEP})) AS source_start FROM documents WHERE length(text) > 0),
 chunks AS (SELECT doc_id * 1000000 + source_start // {STEP} AS chunk_id, doc_id, (source_start // {STEP})::INT AS ordinal, source_start::INT AS source_start,
  least(source_start + {WINDOW}, length(whole))::INT AS source_end, substr(whole, source_start + 1, {WINDOW}) AS text FROM windows)"""
SPANS = """spans AS (SELECT b.item_id AS query_id, d.doc_id, (strpos(d.text, b.text) - 1)::INT AS char_start, (strpos(d.text, b.text) - 1 + length(b.text))::INT AS char_end, b.text AS quote,
  (1 + coalesce(l.quality, 0))::INT AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
TOKENS = r"""list_filter(regexp_extract_all(lower(strip_accents({0})), '[\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""


def pages(t: Tables) -> DataFrame:
    """(doc_id, page, text)"""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_at", "text")).select("doc_id", (F.col("_at") + 1).alias("page"), "text")


def windows(t: Tables) -> DataFrame:
    """(chunk_id, doc_id, ordinal, source_start, source_end, text): windows of WINDOW characters at every STEP."""
    n = F.length("text")
    rows = t.documents.filter(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(n - (WINDOW - STEP), F.lit(1)) - 1, F.lit(STEP))).alias("source_start"))
    ordinal = F.floor(F.col("source_start") / STEP).cast("int")
    return rows.select((F.col("doc_id") * 1_000_000 + ordinal).alias("chunk_id"), "doc_id", ordinal.alias("ordinal"), "source_start", F.least(F.col("source_start") + WINDOW, F.length("text")).alias("source_end"), F.substring("text", F.col("source_start") + 1, F.lit(WINDOW)).alias("text"))


def spans(t: Tables) -> DataFrame:
    """(query_id, doc_id, char_start, char_end, quote, grade): where a passage stands in a document, first place each.

    Candidates are told by a passage's first words, which are looked for at every place of the documents, so no passage meets
    every document; a substring test decides. Words at the passage's ends may be cut, so its second to fifth count. Candidates
    meet texts that are not shuffled, if they are few."""
    w = tx.words(F.col("text"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("quote"), w.alias("_w")).withColumn("_long", F.size("_w") >= 6)
    short = asked.filter("not _long and quote <> ''").select("query_id", "quote")
    asked = asked.filter("_long").select("query_id", F.array_join(F.slice("_w", 2, 4), " ").alias("_g"))
    met = four_words(t.documents.select("doc_id", "text"), asked.select("_g").distinct()).join(asked, "_g").select("doc_id", "query_id")
    q = short.agg(F.min(F.length("quote"))).first()[0]
    if q:  # passages of under six words have no inner words to go by, but as many characters as the shortest of them
        begins = F.transform(F.sequence(F.lit(1), F.length("text") - q + 1), lambda i: F.substring("text", i, F.lit(q)))
        places = t.documents.filter(F.length("text") >= q).select("doc_id", F.explode(F.array_distinct(begins)).alias("_b"))
        met = met.unionByName(places.join(short.withColumn("_b", F.substring("quote", 1, q)), "_b").select("doc_id", "query_id"))
    texts = t.documents.select("doc_id", "text").join(scratch.few(met.distinct(), "met"), "doc_id")
    rows = texts.join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("quote")), "query_id").withColumn("_at", F.instr("text", F.col("quote"))).filter("_at > 0")
    rows = scratch.written(rows.select("query_id", "doc_id", (F.col("_at") - 1).alias("char_start"), (F.col("_at") - 1 + F.length("quote")).alias("char_end"), "quote"), "spans")
    grade = t.labels.select("doc_id", (1 + F.coalesce("quality", F.lit(0))).alias("grade"))
    return rows.join(grade, "doc_id", "left").select("query_id", "doc_id", "char_start", "char_end", "quote", F.coalesce("grade", F.lit(1)).cast("int").alias("grade"))


def four_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, _g): the runs of four words, joined by spaces, that documents (doc_id, text) hold; of these (_g) alone if they have been
    counted as few."""
    wanted = scratch.written(wanted, "runs")
    sent = docs.sparkSession.sparkContext.broadcast({r[0] for r in wanted.collect()} if wanted.count() <= scratch.FEW else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sent.value is None else {tuple(g.split(" ")) for g in sent.value}
        for batch in batches:
            whose, runs = [], []
            for at, text in enumerate(batch.column(1)):
                words = [w for w in text.as_py().split(" ") if w]
                each = zip(words, words[1:], words[2:], words[3:], strict=False)
                found = set(each) if known is None else {g for g in each if g in known}
                whose += [at] * len(found)
                runs += map(" ".join, found)
                if runs and (len(runs) > AT_ONCE or at + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), pa.array(runs)], names=["doc_id", "_g"])
                    whose, runs = [], []

    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(f"(?U){tx.SPACE}+"), F.lit(" "))
    return docs.select("doc_id", spaced.alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _g string")


def passages(t: Tables) -> DataFrame:
    """(query_id, text)"""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def as_chunks(t: Tables) -> DataFrame:
    """(chunk_id, doc_id, text): documents as chunks."""
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(t: Tables) -> DataFrame:
    """Every twentieth vector as a query."""
    return t.embeddings.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def bm25_sql(queries: str = "SELECT item_id AS query_id, text FROM benchmark", chunks: str = "SELECT doc_id AS chunk_id, text FROM documents", prefix: str = "", k: int = 5, stemmed: bool = False) -> str:
    """Common table expressions that end in {prefix}hits (query_id, chunk_id, score, rank)."""
    p = prefix
    words, to_stem, asked_stem = ("tok", "", "") if not stemmed else ("raw", f" {stems_sql(f'SELECT term AS w FROM {p}raw UNION SELECT unnest({TOKENS.format("text")}) FROM {p}qs', p)},\n {p}tok AS (SELECT chunk_id, s AS term FROM {p}raw JOIN {p}stems ON w = term),\n", f" JOIN {p}stems ON w = term")
    asked = "s AS term" if stemmed else "term"
    return rf"""{p}ch AS ({chunks}), {p}qs AS ({queries}),
 {p}{words} AS (SELECT chunk_id, unnest({TOKENS.format("text")}) AS term FROM {p}ch),
{to_stem} {p}tf AS (SELECT chunk_id, term, count(*) AS tf FROM {p}tok GROUP BY ALL),
 {p}len AS (SELECT c.chunk_id, coalesce(sum(tf), 0) AS len FROM {p}ch c LEFT JOIN {p}tf t ON t.chunk_id = c.chunk_id GROUP BY c.chunk_id),
 {p}st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM {p}len),
 {p}bag AS (SELECT query_id, {asked}, count(*) AS mult FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS term FROM {p}qs){asked_stem} GROUP BY ALL),
 {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
 {p}sc AS (SELECT query_id, t.chunk_id, round(sum(mult * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
   * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)))), 9) AS score
  FROM {p}bag b JOIN {p}tf t ON t.term = b.term JOIN {p}df d ON d.term = b.term JOIN {p}len l ON l.chunk_id = t.chunk_id, {p}st GROUP BY ALL),
 {p}hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {p}sc) WHERE rank <= {k})"""


def dense_sql(measure: str, k: int, queries: str = "SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0", vectors: str = "SELECT vec_id AS chunk_id, embedding, label FROM embeddings", prefix: str = "", where: str = "true", ascending: bool = False) -> str:
    """Common table expressions that end in {prefix}hits (query_id, chunk_id, score, rank)."""
    p, q, v = prefix, "q.embedding::DOUBLE[]", "v.embedding::DOUBLE[]"
    d2 = f"list_inner_product({q}, {q}) + list_inner_product({v}, {v}) - 2 * list_inner_product({q}, {v})"
    score = {
        "inner": f"list_inner_product({q}, {v})", "cosine": f"list_inner_product({q}, {v}) / (sqrt(list_inner_product({q}, {q})) * sqrt(list_inner_product({v}, {v})) + 1e-10)",
        "l2": f"greatest({d2}, 0)", "l2_cosine": f"1 - greatest({d2}, 0) / 2",
    }[measure]
    return f"""{p}ds AS (SELECT query_id, chunk_id, round({score}, 9) AS score FROM ({queries}) q, ({vectors}) v WHERE {where}),
 {p}hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {"ASC" if ascending else "DESC"}, chunk_id)::INT AS rank FROM {p}ds) WHERE rank <= {k})"""


def fuse_sql(lists: list[str], k: int, prefix: str = "f") -> str:
    every = " UNION ALL ".join(f"SELECT query_id, chunk_id, rank FROM {x}" for x in lists)
    return f"""{prefix}sum AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM ({every}) GROUP BY ALL),
 {prefix}hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {prefix}sum) WHERE rank <= {k})"""
