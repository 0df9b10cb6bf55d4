"""Data set rules: rows to a table of problems. A sound data set gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a query may be, and the splits.
QUERY_TYPES = ("exact_term", "conceptual", "definitional", "multi_hop", "comparative", "unanswerable")
SPLITS = ("dev", "test")
ID_PATTERN = r"^(ret|gen|judge)-\d{4}$"


def problems(rows: DataFrame, query_types: tuple[str, ...] = QUERY_TYPES, splits: tuple[str, ...] = SPLITS, strict: bool = False) -> DataFrame:
    """(id, problem) of every broken rule, all of a row's rules in one pass. strict: also the form of ids and human checks."""
    n = F.coalesce(F.size("relevant_spans"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    bad = lambda s: s["char_start"].isNull() | (s["char_start"] < 0) | s["char_end"].isNull() | (s["char_end"] <= 0) | (s["char_end"] <= s["char_start"])
    rules = {
        "unknown query_type": ~F.coalesce(F.col("query_type").isin(*query_types), F.lit(False)), "unknown split": ~F.coalesce(F.col("split").isin(*splits), F.lit(False)),
        "answerable without spans": F.col("answerable") & (n == 0), "unanswerable with spans": ~F.col("answerable") & (n > 0),
        "query is empty": F.coalesce(F.length("query"), F.lit(0)) == 0, "span range is wrong": F.coalesce(F.exists("relevant_spans", bad), F.lit(False)),
        "quote is empty": F.coalesce(F.exists("relevant_spans", lambda s: F.coalesce(F.length(s["quote"]), F.lit(0)) == 0), F.lit(False)),
        "grade is not 1 or 2": F.coalesce(F.exists("relevant_spans", lambda s: ~F.coalesce(s["grade"].between(1, 2), F.lit(False))), F.lit(False)),
    }
    if strict:
        rules |= {"id has another form": ~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False)), "not verified by a human": ~F.coalesce(F.col("verified_by") == "human", F.lit(False))}
    listed = F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))
    return rows.select("id", F.explode(F.array_compact(listed)).alias("problem"))


def repeated_ids(rows: DataFrame, key: str = "id", order: str = "line_no") -> DataFrame:
    """All but the first row of each id."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n > 1").drop("_n")


def of_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows of dev or test; all of them for `all`."""
    return rows if split == "all" else rows.filter(F.col("split") == split)


def unverified(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(~F.coalesce(F.col("verified_by") == "human", F.lit(False))).alias("n_unverified"))
