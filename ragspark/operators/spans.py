"""Labelled text spans: resolution to chunks, verification against texts, and what can't be resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.sources.scratch import few
from ragspark.operators.intervals import overlapping

MIN_OVERLAP = 0.5
#: Labels of a document that are verified in one row, about.
LABELS = 1_000


def resolve(spans: DataFrame, chunks: DataFrame, least: float = MIN_OVERLAP, doc: str = "doc_id", item: str = "chunk_id", of_span: bool = False) -> DataFrame:
    """spans joined to the chunks that hold at least this share of the shorter of span and chunk (of_span: of the span).

    Both are dealt by document and bucket of offsets."""
    c = chunks.select(F.col(doc).alias("_doc"), item, "source_start", "source_end")
    met = overlapping(spans, c, (doc, "_doc"), ("char_start", "char_end"), ("source_start", "source_end")).drop("_doc")
    shared = F.least("char_end", "source_end") - F.greatest("char_start", "source_start")
    length = F.col("char_end") - F.col("char_start")
    base = length if of_span else F.least(length, F.col("source_end") - F.col("source_start"))
    return met.withColumn("overlap", shared / base).filter(F.col("overlap") >= least)


def grades(resolved: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(query, item, grade): the highest grade of a chunk over spans and documents."""
    return resolved.groupBy(query, item).agg(F.max("grade").alias("grade"))


def unresolved(spans: DataFrame, resolved: DataFrame, keys: tuple[str, ...] = ("query_id", "doc_id", "char_start", "char_end")) -> DataFrame:
    """Spans that no chunk holds."""
    return spans.join(resolved.select(*keys).distinct(), list(keys), "left_anti")


def unindexed(spans: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents with labels but without chunks."""
    return spans.select(doc).distinct().join(chunks.select(doc).distinct(), doc, "left_anti")


def verify(spans: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """spans with reason: null where the text at the offsets holds the quote, else the first thing wrong.

    A text meets the lists of its labels, LABELS at most in each, so it is carried once for many of them."""
    own = [c for c in spans.columns if c != "reason"]
    each = spans.select(F.col(doc).alias("_key"), F.struct(*own).alias("_s"))
    parts = each.groupBy(F.col("_key").alias("_of")).agg(F.ceil(F.count("*") / LABELS).alias("_parts"))
    listed = each.join(parts, F.col("_key").eqNullSafe(F.col("_of"))).withColumn("_part", F.pmod(F.xxhash64(F.to_json("_s")), F.col("_parts")))
    listed = listed.groupBy("_key", "_part").agg(F.collect_list("_s").alias("_all"))
    labelled = few(each.select("_key").distinct(), "labelled")  # texts without labels go no further
    d = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(labelled, F.col("_doc") == F.col("_key"), "left_semi")

    def told(s: Column) -> Column:
        anchored = F.col("_text").substr(s["char_start"] + 1, s["char_end"] - s["char_start"])
        reason = F.when(F.col("_doc").isNull(), "no document").when(s["char_end"] > F.length("_text"), "past the end").when(F.instr(anchored, s["quote"]) == 0, "quote not found")
        return F.struct(s.alias("s"), reason.alias("reason"))

    met = listed.join(d, F.col("_key") == F.col("_doc"), "left")
    return met.select(F.explode(F.transform("_all", told)).alias("_t")).select(*(F.col(f"_t.s.{c}").alias(c) for c in own), "_t.reason")


def require_sound(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans, or an error where any anchor is broken."""
    broken = verify(spans, docs).filter("reason is not null")
    if rows := broken.take(5):
        raise ValueError(f"labels don't match the texts, such as {[r.asDict() for r in rows]}")
    return spans
