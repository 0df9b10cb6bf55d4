"""Answer assembly in batches: prompts, citations, candidate ranking and span selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import text as tx

#: Blend of retrieval and reader, thresholds and fallback texts, span bounds and context budget.
ALPHA, LEAST_SCORE, TOP_ANSWERS, LONGEST_SPAN, N_BEST = 0.40, 5.0, 5, 40, 20
LEAST_CHARS, MOST_CHARS, CONTEXT_CHARS, WORTH_TRIMMING = 2, 400, 3500, 300
BELOW, NONE = "No reliable answer found in the document.", "No reliable answer found."
EPS = 1e-10

#: Defaults of this library; every function that makes prompts takes others.
SYSTEM_PROMPT = (
    "Answer from the numbered sources below and from nothing else. After each statement name the sources that carry it, as [1] or [1][2]. "
    f"Where the sources leave the question open, say only: {tx.REFUSAL} Keep to the sources' own terms, and be brief."
)
UNCOVERED = "The document does not say."
CONTEXT_HEAD = f"Answer the question from this context alone; if it is not enough, reply: {UNCOVERED}\n\nContext:\n"
STRICT_HEAD = f"Use what the context below states and add nothing to it. If that does not answer the question, reply exactly: {UNCOVERED} Name no source numbers.\n\nContext:\n"


def numbered_sources(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, sources): the hydrated hits of each query in rank order, as (index, chunk_id, doc_id, page, text)."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "page", "text")))
    numbered = F.transform(listed, lambda s, i: F.struct((i + 1).alias("index"), s["chunk_id"].alias("chunk_id"), s["doc_id"].alias("doc_id"), s["page"].alias("page"), s["text"].alias("text")))
    return hits.groupBy(query).agg(numbered.alias("sources"))


def prompts(questions: DataFrame, hits: DataFrame, query: str = "query_id", question: str = "question", system: str = SYSTEM_PROMPT) -> DataFrame:
    """questions with sources, system and prompt; answer is the refusal and prompt null where there are no sources, so the
    scorer sees only the rest."""
    rows = questions.join(numbered_sources(hits, query), query, "left")
    some = F.col("sources").isNotNull()
    return rows.withColumns({"system": F.when(some, system), "prompt": F.when(some, tx.build_prompt(F.col(question), F.col("sources"))), "answer": F.when(~some, tx.REFUSAL)})


def citations(answers: DataFrame, answer: str = "answer", sources: str = "sources") -> DataFrame:
    """answers with the cited sources, their numbers, the numbers never cited, and the invented ones."""
    n = F.coalesce(F.size(sources), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    cited = tx.cited_indices(F.col(answer), n)
    every = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(answer), F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")))
    shown = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    rows = answers.withColumn("cited", cited)
    return rows.withColumns({
        "citations": F.transform("cited", lambda i: F.get(F.col(sources), i - 1)), "uncited": F.array_except(shown, F.col("cited")), "invented": F.array_except(every, shown),
    })


def _blocks(hits: DataFrame, query: str) -> DataFrame:
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" | Page "), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit(" | Chunk "), F.col("chunk_id").cast("string"), F.lit(" | Score "), F.format_string("%.4f", F.col("score").cast("double")), F.lit("]\n"))
    return hits.select(query, "rank", F.concat(head, tx.clean_page(F.col("text"))).alias("block"))


def _context(blocks: DataFrame, questions: DataFrame, head: str, tail: str, query: str, question: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", "block")))
    context = blocks.groupBy(query).agg(F.array_join(F.transform(listed, lambda b: b["block"]), "\n\n").alias("context"))
    asked = tx.clean_page(F.col(question))
    rows = questions.join(context, query, "left").withColumn("context", F.coalesce("context", F.lit("")))
    return rows.withColumn("prompt", tx.strip(F.concat(F.lit(head), F.col("context"), F.lit("\n\nQuestion:\n"), asked, F.lit("\n\n" + tail))))


def budgeted_prompts(questions: DataFrame, hits: DataFrame, most: int = CONTEXT_CHARS, query: str = "query_id", question: str = "question", head: str = CONTEXT_HEAD) -> DataFrame:
    """questions with a context of ranked blocks up to `most` characters. The first block that does not fit is cut at its
    last space if over WORTH_TRIMMING characters are left, and is the last."""
    w = Window.partitionBy(query).orderBy("rank")
    b = _blocks(hits, query).withColumns({"_all": F.sum(F.length("block")).over(w), "_n": F.length("block")}).withColumn("_left", most - F.col("_all") + F.col("_n"))
    b = b.withColumn("_over", F.sum((F.col("_n") > F.col("_left")).cast("int")).over(w)).filter((F.col("_over") == 0) | ((F.col("_over") == 1) & (F.col("_n") > F.col("_left")) & (F.col("_left") > WORTH_TRIMMING)))
    cut = F.col("block").substr(F.lit(1), F.col("_left"))
    cut = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r"(?s) [^ ]*\z", "")).otherwise(cut)
    b = b.withColumn("block", F.when(F.col("_over") == 0, F.col("block")).otherwise(cut))
    return _context(b, questions, head, "Answer:", query, question)


def strict_prompts(questions: DataFrame, hits: DataFrame, most: int = CONTEXT_CHARS, query: str = "query_id", question: str = "question", head: str = STRICT_HEAD) -> DataFrame:
    """As budgeted_prompts with stricter rules, ending before the first block that does not fit: a running sum decides."""
    w = Window.partitionBy(query).orderBy("rank")
    b = _blocks(hits, query).withColumn("_all", F.sum(F.length("block")).over(w)).filter(F.col("_all") <= most)
    return _context(b, questions, head, "Grounded Answer:", query, question)


def min_max(score: Column, query: str = "question") -> Column:
    """Scores of one question's candidates put between 0 and 1."""
    w = Window.partitionBy(query)
    return (score - F.min(score).over(w)) / (F.max(score).over(w) - F.min(score).over(w) + EPS)


def blended(candidates: DataFrame, alpha: float = ALPHA, query: str = "question") -> DataFrame:
    """Valid candidates ranked by alpha * retrieval + (1 - alpha) * reader, both put between 0 and 1 within the question."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    rows = candidates.filter("reader_status = 'valid_answer'").withColumns({"normalized_retrieval_score": min_max(F.col("retrieval_score"), query), "normalized_reader_score": min_max(F.col("reader_span_score"), query)})
    rows = rows.withColumn("final_score", F.round(alpha * F.col("normalized_retrieval_score") + (1 - alpha) * F.col("normalized_reader_score"), 9))
    return rows.withColumn("final_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("final_score"), "retrieval_rank", "chunk_id")))


def outcomes(questions: DataFrame, candidates: DataFrame, least_retrieval: float | None = None, query: str = "question") -> DataFrame:
    """(query, status): retrieval_failed, reader_failed or valid_answer."""
    kept = candidates if least_retrieval is None else candidates.filter(F.col("retrieval_score") >= least_retrieval)
    n = kept.groupBy(query).agg(F.count("*").alias("_n"), F.count_if(F.col("reader_status") == "valid_answer").alias("_valid"))
    status = F.when(F.col("_n").isNull(), "retrieval_failed").when(F.col("_valid") == 0, "reader_failed").otherwise("valid_answer")
    return questions.select(query).join(n, query, "left").select(query, status.alias("status"))


def best_candidates(candidates: DataFrame, n: int = TOP_ANSWERS, query: str = "question") -> DataFrame:
    """The n valid candidates of highest span score of each question."""
    w = Window.partitionBy(query).orderBy(F.desc("reader_span_score"), "chunk_id")
    return candidates.filter("reader_status = 'valid_answer'").withColumn("answer_rank", F.row_number().over(w)).filter(F.col("answer_rank") <= n)


def with_fallback(questions: DataFrame, candidates: DataFrame, least: float = LEAST_SCORE, query: str = "question") -> DataFrame:
    """(query, answer, status, span_score): the best answer, or a fallback below the threshold or without candidates."""
    best = best_candidates(candidates, 1, query).select(query, F.col("answer").alias("_a"), F.col("reader_span_score").alias("span_score"))
    rows = questions.select(query).join(best, query, "left")
    status = F.when(F.col("span_score").isNull(), "no_candidate_answer").when(F.col("span_score") < least, "below_threshold").otherwise("answered")
    answer = F.when(F.col("span_score").isNull(), NONE).when(F.col("span_score") < least, BELOW).otherwise(F.col("_a"))
    return rows.select(query, answer.alias("answer"), status.alias("status"), "span_score")


def spans(logits: DataFrame, longest: int = LONGEST_SPAN, n_best: int | None = N_BEST, keys: tuple[str, ...] = ("question_id", "chunk_id"), chars: tuple[int, int] = (LEAST_CHARS, MOST_CHARS)) -> DataFrame:
    """(keys, start_token, end_token, span_score) of spans from start_token to an end within `longest` tokens. logits: keys,
    token, start_logit, end_logit. With n_best only the highest starts and ends of a context meet; then a context has
    n_best squared pairs at most. Where logits tell of char_start and char_end, a span has so many characters. The join is an
    equi-join on the context and a bucket of `longest` tokens."""
    placed = {"char_start", "char_end"} <= {*logits.columns}

    def some(score: str, place: str) -> DataFrame:
        rows = logits.select(*keys, "token", score, *([place] if placed else []))
        if n_best is None:
            return rows
        w = Window.partitionBy(*keys).orderBy(F.desc(score), "token")
        return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_best).drop("_r")

    s = some("start_logit", "char_start").withColumnRenamed("token", "start_token")
    s = s.withColumn("_b", F.explode(F.array(F.floor(F.col("start_token") / longest), F.floor(F.col("start_token") / longest) + 1)))
    e = some("end_logit", "char_end").withColumnRenamed("token", "end_token").withColumn("_b", F.floor(F.col("end_token") / longest))
    met = s.join(e, [*keys, "_b"]).filter((F.col("end_token") >= F.col("start_token")) & (F.col("end_token") < F.col("start_token") + longest))
    if placed:
        met = met.filter((F.col("char_end") - F.col("char_start")).between(*chars))
    return met.select(*keys, "start_token", "end_token", (F.col("start_logit") + F.col("end_logit")).alias("span_score"))


def best_spans(logits: DataFrame, longest: int = LONGEST_SPAN, n_best: int | None = None, keys: tuple[str, ...] = ("question_id", "chunk_id")) -> DataFrame:
    """The span of highest score of each context; the earliest, then shortest, of equals."""
    every = spans(logits, longest, n_best, keys).withColumn("span_score", F.round("span_score", 9))
    best = every.groupBy(*keys).agg(F.min_by(F.struct("start_token", "end_token", "span_score"), F.struct(-F.col("span_score"), "start_token", "end_token")).alias("_b"))
    return best.select(*keys, "_b.*")


def with_confidence(valid: DataFrame, keys: tuple[str, ...] = ("question_id", "chunk_id")) -> DataFrame:
    """Spans with the softmax of their scores within the context."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col("span_score") - F.max("span_score").over(w))
    return valid.withColumn("_e", e).withColumn("confidence", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def strategies(questions: DataFrame, best: dict[str, DataFrame], query: str = "question") -> DataFrame:
    """questions with each strategy's best answer, its score and status beside the others'."""
    out = questions.select(query)
    for name, table in best.items():
        out = out.join(table.select(query, *(F.col(c).alias(f"{name}_{c}") for c in table.columns if c != query)), query, "left")
    return out
