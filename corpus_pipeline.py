"""A training corpus from documents: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import langid, packing, pii, quality, shared, simhash
from ragspark.llm.queries import TOKENIZER, pseudonym_key, quality_model, remainder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_model(spark, shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    score = shared.free("_score", docs.columns)
    return quality.score(docs, model, out=score).filter(F.col(score) >= quality.ACCEPT).drop(score)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty. The model is fitted as in the operator's own query."""
    model = langid.fit(shared.table(spark, sf_dir, "documents").filter(remainder("doc_id", 4) != 2))
    names = tuple(shared.free(c, docs.columns) for c in ("_lang", "_score", "_rejected"))
    return langid.predict(docs, model, out=names).filter(~F.col(names[2])).drop(*names)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, by doc_id, then by a row number for repeated rows. Near-duplicates
    have a similarity of 0.8 or more over shingles of five words, as their long fingerprints tell."""
    number, key = (shared.free(c, docs.columns) for c in ("_row", "_key"))
    rows = shared.written(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    keyed = rows.withColumn(key, F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.col(number).alias("row")))
    found = simhash.similar_documents(keyed, key)
    gone = found.filter(F.col(key) != F.col("component")).select(F.col(f"{key}.row").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pii.pseudonymise(docs, pseudonym_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows."""
    cut = packing.pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    digests = shared.written(cut.withColumns({"ids_crc32": F.crc32("ids"), "salt": F.monotonically_increasing_id()}).drop("ids"), "pieces")
    return packing.pack(digests, ("doc_id", "start"), "salt")


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can express neither the classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again as the next one's input. A stage's input is removed
    once its output is written."""
    docs, spent = shared.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name, spent)
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
