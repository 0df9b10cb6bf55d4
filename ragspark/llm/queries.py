"""The registered queries of this subpackage: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import aq, bitslice, bpe, html, langid, multiindex, ogg, packing, pii, quality, secrets, shared, simhash, squares

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: The setting that holds the key of pseudonyms. Where it is unset, as over test tables, the queries take a public key, which
#: hides nothing from those who read this.
KEY_SETTING, PUBLIC_KEY = "spark.ragspark.pseudonyms.key", "public key for test tables"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, PUBLIC_KEY)


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, by this modulus; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % by


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aq.search(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, path, pattern)


def op3_html_mss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(shared.table(spark, sf_dir, "documents"))
    counts = (F.size(F.filter("base", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.length(data)
    padded = F.greatest(F.lit(192), F.ceil(n / 192) * 192)
    payload = F.concat(data, F.encode(F.repeat(F.lit(" "), (padded - n).cast("int")), "UTF-8"))
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("payload"))
    media = ogg.read_back(ogg.encode(docs).drop("payload"))
    return media.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    digests = shared.written(cut.withColumns({"ids_crc32": F.crc32("ids"), "salt": F.monotonically_increasing_id()}).drop("ids"), "pieces")
    return packing.pack(digests, ("doc_id", "start"), "salt").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pseudonym_key(spark), counts="kinds")


def quality_model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on labelled documents outside the held-out part; word contexts are those of all documents. A document
    whose labels clash teaches nothing. Labels are sampled before they meet the texts, so they are few enough to be sent out."""
    marked = labels.filter(remainder("doc_id", 5) != 0).filter("doc_id is not null and quality is not null")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    chosen = marked.filter(shared.share_of(quality.SAMPLE, marked.count(), "doc_id"))
    docs = docs.select("doc_id", "text")
    return quality.fit(docs.join(F.broadcast(chosen), "doc_id"), quality.contexts(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, shared.table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = squares.pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    digests = shared.written(cut.withColumns({"ids_crc32": F.crc32("ids"), "number": F.monotonically_increasing_id()}).drop("ids"), "pieces")
    return squares.pack(digests, "number").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multiindex.mine(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


OP12_SQL = """WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
 QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3"""


def op13_bitsliced_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bitslice.search(docs, shared.table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = rf"""list_filter(regexp_extract_all(translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{bitslice.TERM}'), lambda x: x <> '')"""
OP13_SQL = f"""WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS t FROM documents), docs AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
 st AS (SELECT count(*) AS docs_n, sum(n)::BIGINT AS total FROM docs), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * any_value(docs_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, st GROUP BY term),
 q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
 s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs_n) // total))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term), st GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_additive_quantisation, op2_byte_bpe, op3_html_mss, op4_secret_links, op5_simhash_vptree, op6_ogg_media,
        op7_language_id, op8_bin_slack_packing, op9_feistel_pii, op10_quality, op11_sum_of_squares_packing, op12_inverted_multi_index,
        op13_bitsliced_bloom,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op12_inverted_multi_index": OP12_SQL, "op13_bitsliced_bloom": OP13_SQL}
