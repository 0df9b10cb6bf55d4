"""Retrieval for whole tables of queries: dense, lexical, fused."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.stem import stem, with_stems, words_of
from ragspark.sources.scratch import FEW, few, written

#: Candidates of each arm, the fusion constant, hits returned, and the parameters of BM25.
CANDIDATES, RRF_K, TOP_K, RERANK_TOP_K = 40, 60, 5, 4
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
LOW_CONFIDENCE = 0.15
#: Scores are rounded to so many places before they are ranked, so that sums in another order don't change ties.
PLACES = 9
#: Chunks of a block of lexical search, and queries that meet it at once.
CHUNKS, QUERIES = 4_096, 4_096
#: Words that a search looks for, up to which they are sent to all tasks; more are met in a shuffle.
WORDS = FEW
#: Rows of what chunks hold that a batch has, about.
ROWS = 100_000
#: Bytes of vectors or of queries that a task of dense search holds at most, and pairs of both that are worth a task.
BLOCK_BYTES, PAIRS = 32 << 20, 1 << 24


def top_k(scored: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id", score: str = "score", ascending: bool = False) -> DataFrame:
    """The k best of each query with rank from 1; ties to the smaller item. Catalyst limits groups before the shuffle."""
    return ranked(scored, query, item, score, ascending).filter(F.col("rank") <= k)


def ranked(scored: DataFrame, query: str = "query_id", item: str = "chunk_id", score: str = "score", ascending: bool = False) -> DataFrame:
    """All items of each query with rank from 1; ties to the smaller item."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(order, F.col(item).asc())))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-10)


def _inner(a: Iterable[np.ndarray], b: Iterable[np.ndarray]) -> np.ndarray:
    """Inner products of pairs of vectors, given component by component and summed in that order: as SQL does, and the same for equal
    vectors wherever they stand, which a matrix product doesn't hold to."""
    return sum((x * y for x, y in zip(a, b, strict=True)), 0.0)


def _measure(kind: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of every query with every vector, by a matrix product; for l2 the negative squared distance."""
    return _score(kind, q @ x.T, (q**2).sum(axis=1)[:, None], (x**2).sum(axis=1))


def _score(kind: str, inner: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same by inner products and both sides' squared lengths."""
    if kind == "inner":
        return inner
    if kind == "cosine":
        return inner / (np.sqrt(q) * np.sqrt(x) + 1e-10)
    squared = np.maximum(q + x - 2 * inner, 0)
    return -squared if kind == "l2" else 1 - squared / 2


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To PLACES, halves away from zero as SQL rounds them; numpy's go to the even digit."""
    scaled = scores * 10.0**PLACES
    whole = np.trunc(scaled)
    return np.where(np.abs(scaled - whole) >= 0.5, whole + np.copysign(1.0, scaled), whole) / 10.0**PLACES


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, measure: str = "l2_cosine", query: str = "query_id", item: str = "chunk_id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """(query, item, score, rank): the k nearest vectors of every query, exactly. measure: inner, cosine, l2 (the squared
    distance, smaller is better) or l2_cosine (1 - squared distance / 2). within: a column of both, and only vectors that
    have the query's value in it are searched.

    Blocks of queries meet blocks of vectors; each meeting is one matrix product. What may be among its k best by that (within its
    error, and all ties of the last one included, as ids decide) is scored anew, pair by pair, and only the k best leave the
    task. No side is broadcast, so neither need be small. Blocks are as large as a task can hold, because every vector is copied
    once for each block of queries and the other way round."""
    if measure not in ("inner", "cosine", "l2", "l2_cosine"):
        raise ValueError(f"unknown measure {measure}")
    empty = queries.sparkSession.createDataFrame([], f"{query} {queries.schema[query].dataType.simpleString()}, {item} {vectors.schema[item].dataType.simpleString()}, score double, rank int")
    if k <= 0:
        return empty
    if within is not None:  # null is no class
        queries, vectors = (x.filter(F.col(within).isNotNull()).withColumn(within, F.col(within).cast(vectors.schema[within].dataType)) for x in (queries, vectors))
    own = F.lit(0) if within is None else F.col(within)
    sizes = [t.groupBy(own.alias("c")).agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")) for t in (vectors, queries)]
    v, q = (x.agg(F.max("n"), F.min("low"), F.max("high")).first() for x in sizes)
    if not v[0] or not q[0]:
        return empty
    if not v[1] == v[2] == q[1] == q[2]:
        raise ValueError(f"vectors of {min(v[1], q[1])} and {max(v[2], q[2])} components can't be compared")
    most = max(1, BLOCK_BYTES // (8 * v[1]))
    tasks = max(1, min(v[0] * q[0] // PAIRS, 2 * queries.sparkSession.sparkContext.defaultParallelism))
    side = max(1, min(most, int((v[0] * q[0] / tasks) ** 0.5)))
    turns = -(-q[0] // side)
    blocks = max(-(-v[0] // most), -(-tasks // turns))
    # both sides' keys are ints: a cogroup brings no types together, and an int and an equal long are dealt to different tasks
    x = vectors.select(own.alias("c"), F.col(item).alias("i"), F.col(vector).alias("v"), F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int").alias("b")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    y = queries.select(own.alias("c"), F.col(query).alias("i"), F.col(vector).alias("v"), F.pmod(F.xxhash64(query), F.lit(turns)).cast("int").alias("t")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names, ids, out = asked["i"].to_numpy(), block["i"].to_numpy(), []
        if len(asked) and len(block):
            x, every = np.stack(block["v"]).astype(np.float64), np.stack(asked["v"]).astype(np.float64)
            parts, worst = np.ascontiguousarray(x.T), max(0, len(ids) - k)
            lengths = _inner(parts, parts)
            longest = np.sqrt(np.max(lengths, initial=0, where=np.isfinite(lengths)))
            for at in range(0, len(every), step := max(1, 4_000_000 // len(ids))):
                some = np.ascontiguousarray(every[at : at + step].T)
                own = _inner(some, some)
                rough = _measure(measure, every[at : at + step], x)
                reach = {"inner": np.sqrt(own) * longest, "cosine": np.ones(len(own))}.get(measure, (np.sqrt(own) + longest) ** 2)
                slack = 2 * 10.0**-PLACES + 16 * len(parts) * np.finfo(float).eps * np.nan_to_num(reach, posinf=0)
                row, col = np.nonzero(rough >= (np.partition(rough, worst, axis=1)[:, worst] - slack)[:, None])
                score = _rounded(_score(measure, _inner((c[row] for c in some), (c[col] for c in parts)), own[row], lengths[col]))
                order = np.lexsort((ids[col], -score, row))
                order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]  # row ascends before and after
                out.append(pd.DataFrame({query: names[at + row[order]], item: ids[col[order]], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({query: names[:0], item: ids[:0], "score": np.zeros(0)})

    schema = f"{query} {queries.schema[query].dataType.simpleString()}, {item} {vectors.schema[item].dataType.simpleString()}, score double"
    found = y.groupBy("c", "b", "t").cogroup(x.groupBy("c", "b", "t")).applyInPandas(meet, schema)
    best = top_k(found, k, query, item)
    return best.withColumn("score", -F.col("score")) if measure == "l2" else best


def above(hits: DataFrame, least: float, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Hits of at least this score, ranked anew without gaps."""
    return ranked(hits.drop("rank").filter(F.col("score") >= least), query, item)


def norm_audit(vectors: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    n = F.round(norm(F.col(vector)), 6)
    return vectors.agg(F.count("*").alias("n_vectors"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm"), F.round(F.avg(norm(F.col(vector))), 6).alias("avg_norm"), F.count_if(F.size(vector) != width).alias("n_wrong_width"))


def postings(chunks: DataFrame, stemmed: bool = True, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, pos, term): every index term of every chunk with its position."""
    rows = chunks.select(key, F.posexplode(tx.index_tokens(F.col(text))).alias("pos", "term"))
    return with_stems(rows) if stemmed else rows


def lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, len) of every chunk, those without terms too: the size of a chunk's own list of terms, so nothing is shuffled."""
    return chunks.select(key, F.size(tx.index_tokens(F.col(text))).alias("len"))


def corpus_stats(sizes: DataFrame) -> DataFrame:
    """One row: n, avg_len."""
    return sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def term_stats(chunks: DataFrame, stemmed: bool = True, text: str = "text") -> DataFrame:
    """(term, df, tf): chunks that hold each term, and its occurrences. Terms are summed within tasks, so what is shuffled
    grows with the vocabulary; only that is stemmed. A chunk counts once for each stem, whatever the words that have it."""
    tokens = tx.index_tokens(F.col(text))
    if not stemmed:
        held = chunks.select(F.explode_outer(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        every = chunks.select(F.explode_outer(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
        return held.join(every, "term")  # without the null of chunks that have no words
    numbered = chunks.select(F.monotonically_increasing_id().alias("_row"), tokens.alias("_t"))  # numbered before they are exploded
    rows = with_stems(numbered.select("_row", F.explode("_t").alias("term")).groupBy("_row", "term").agg(F.count("*").alias("n")))
    return rows.groupBy("_row", "term").agg(F.sum("n").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def query_terms(queries: DataFrame, stemmed: bool = True, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, term, mult): the bag of a query's index terms. A token of several terms is left to `query_phrases`; one
    without any adds nothing."""
    tokens = queries.select(query, F.explode(tx.query_tokens(F.col(text))).alias("_token")).select(query, tx.index_tokens(F.col("_token")).alias("_t"))
    rows = tokens.filter(F.size("_t") == 1).select(query, F.element_at("_t", 1).alias("term"))
    rows = with_stems(rows) if stemmed else rows
    return rows.groupBy(query, "term").agg(F.count("*").alias("mult"))


def query_phrases(queries: DataFrame, stemmed: bool = True, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, phrase, at, term, n): terms of the query's tokens that hold several, such as those with underscores."""
    tokens = queries.select(query, F.posexplode(tx.query_tokens(F.col(text))).alias("phrase", "_token")).withColumn("_t", tx.index_tokens(F.col("_token")))
    rows = tokens.filter(F.size("_t") > 1).select(query, "phrase", F.size("_t").alias("n"), F.posexplode("_t").alias("at", "term"))
    return with_stems(rows) if stemmed else rows


def phrase_counts(positions: DataFrame, phrases: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(query, phrase, key, tf): where the terms of a phrase stand next to each other. A place counts if all n terms agree
    on where the phrase begins, so one join and one sum do for phrases of any length."""
    met = positions.join(phrases, "term").withColumn("_begin", F.col("pos") - F.col("at"))
    whole = met.groupBy(query, "phrase", key, "_begin", "n").agg(F.count("*").alias("_hits")).filter("_hits = n")
    return whole.groupBy(query, "phrase", key).agg(F.count("*").alias("tf"))


def words_of_chunks(tokens: DataFrame, known: dict[str, str] | None = None, widths: tuple[int, ...] = (), places: bool = False, empty: bool = True, stems: list[str] | None = None) -> DataFrame:
    """(key, len, word, tf, places): what each chunk holds, from a table (key, `tx.spaced_tokens`). known: words to look for, all if it
    is not given, and what stands for each; widths: runs of so many words are words too. places: where words stand,
    else null. empty: a row of an empty word for each chunk. stems: instead of known, stems whose words are looked for.

    Words are counted where the text is read, a text at a time, so no row is made for each place."""
    key, sent = tokens.columns[0], None if known is None and stems is None else tokens.sparkSession.sparkContext.broadcast(known if stems is None else stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent is None or stems is not None else sent.value
        of_stems = None if stems is None else words_of(sent.value)
        for batch in batches:
            whose, sizes, words, counts, spots = [], [], [], [], []
            for at, text in enumerate(map(pa.StringScalar.as_py, batch.column(1))):
                listed = text.split(" ") if text else []
                if not text.isascii():
                    listed = [w if w.isascii() else w.translate(tx.FOLD) for w in listed]
                if places:
                    found = {}
                    for pos, w in enumerate(listed):
                        found.setdefault(w, []).append(pos)
                else:
                    found = Counter(listed)
                    for width in widths:
                        found.update(map(" ".join, zip(*(listed[k:] for k in range(width)), strict=False)))
                if of_stems is not None:
                    wanted = of_stems(found)
                held = list(found if wanted is None else found.keys() & wanted.keys())
                values = [found[w] for w in held]
                if wanted is not None:
                    held = [wanted[w] for w in held]
                    if len(set(held)) < len(held):  # words of one stem
                        sums: dict = {}
                        for w, n in zip(held, values, strict=True):
                            sums[w] = sums[w] + n if w in sums else n
                        held, values = list(sums), list(sums.values())
                words += held
                if empty:
                    words.append("")
                    values.append([0] if places else 1)
                whose += [at] * len(values)
                sizes += [len(listed)] * len(values)
                spots += values if places else ()
                counts += map(len, values) if places else values
                if words and (len(words) > ROWS or at + 1 == batch.num_rows):
                    columns = (pa.array(sizes, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(spots, pa.list_(pa.int32())) if places else pa.nulls(len(words), pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), *columns], names=[key, "len", "word", "tf", "places"])
                    whose, sizes, words, counts, spots = [], [], [], [], []

    return tokens.mapInArrow(run, f"`{key}` {tokens.schema[key].dataType.simpleString()}, len int, word string, tf long, places array<int>")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(word): the words of a table (key, `tx.spaced_tokens`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: set[str] = set()
            for text in batch.column(1):
                words.update(text.as_py().split(" "))
            words = {w if w.isascii() else w.translate(tx.FOLD) for w in words} - {""}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], names=["word"])

    return tokens.mapInArrow(run, "word string").distinct()


def _surface(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, term): the words of the tokens' vocabulary whose stem is one of the terms."""
    return vocabulary(tokens).select("word", stem(F.col("word")).alias("term")).join(terms.select("term").distinct(), "term")


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, stemmed: bool = True, query: str = "query_id", key: str = "chunk_id", query_text: str = "text", text: str = "text") -> DataFrame:
    """(query, key, score, rank): the k chunks of highest BM25 for the bag of each query's terms and phrases. A repeated
    token counts again; a chunk qualifies by any term; a query without terms has no hits.

    Chunks' words are counted within the task that reads them, and meet the queries' terms there if those have been counted as few (stems
    of words that begin as one of the terms are told there too; of many terms the words are found in the vocabulary). That one pass writes what the search goes by, with a row
    of an empty term for each chunk, from which chunks and words are counted; `best_by_bm25` does the rest."""
    bag, phrases = query_terms(queries, stemmed, query, query_text), query_phrases(queries, stemmed, query, query_text)
    units, tokens = named_phrases(phrases, query), chunks.select(key, tx.spaced_tokens(F.col(text)).alias("_s"))
    if not stemmed:
        return _bm25_by_units(bag, units, tokens, k, query, key)
    terms = written(bag.select("term").unionByName(phrases.select("term")).distinct(), "terms")
    plain = phrases.isEmpty()
    if terms.count() <= WORDS:
        met = words_of_chunks(tokens, places=not plain, stems=[r[0] for r in terms.collect()]).withColumnRenamed("word", "term")
    else:  # what costs is to find the words, so it is done once: the vocabulary and the search both go by this table
        tokens = written(tokens, "tokens")
        met = met_words(tokens, _surface(tokens, terms), places=not plain)
    if plain:
        return _bm25_of(bag, _counted(met, key), k, query, key)
    held = written(met.groupBy(key, "len", "term").agg(F.sum("tf").alias("tf"), F.flatten(F.collect_list("places")).alias("places")), "held")
    n, total = _sizes(held)
    return best_by_bm25(bag, phrases, units, held.filter("term <> ''"), n, total, k, query, key)


def _bm25_by_units(bag: DataFrame, units: DataFrame, tokens: DataFrame, k: int, query: str, key: str) -> DataFrame:
    """The search where words are terms. A phrase is met as a run of as many words, one more term, so its words' places, of
    which common ones have very many, are gathered nowhere."""
    named = _units_bag(bag, units, query)
    widths = sorted(r[0] for r in units.select(F.size(F.split("unit", " ")).alias("n")).distinct().collect())  # numbers of words
    wanted = named.select("term").distinct().withColumn("word", F.col("term"))
    return _bm25_of(named, _counted(met_words(tokens, wanted, tuple(widths)), key), k, query, key)


def met_words(tokens: DataFrame, wanted: DataFrame, widths: tuple[int, ...] = (), places: bool = False) -> DataFrame:
    """(key, len, term, tf, places): what chunks hold of the words (word, term), and of the empty term one each. Words that have been counted as
    few are sent to the tasks; more are met in a join."""
    wanted = written(wanted.select("word", "term"), "wanted")
    if wanted.count() <= WORDS:
        return words_of_chunks(tokens, dict(map(tuple, wanted.collect())), widths, places).withColumnRenamed("word", "term")
    wanted = wanted.unionByName(wanted.sparkSession.createDataFrame([("", "")], "word string, term string"))
    met = words_of_chunks(tokens, None, widths, places).join(wanted, "word").groupBy(tokens.columns[0], "len", "term")
    return met.agg(F.sum("tf").alias("tf"), F.flatten(F.collect_list("places")).alias("places"))


def _counted(met: DataFrame, key: str) -> DataFrame:
    """(key, len, term, tf). A chunk's rows are summed in its task already; only where chunks share a key are they shuffled to be summed."""
    met = written(met.select(key, "len", "term", "tf"), "met")
    n, different = met.filter("term = ''").agg(F.count("*"), F.count_distinct(key)).first()
    return met if n == different else written(met.groupBy(key, "len", "term").agg(F.sum("tf").alias("tf")), "held")


def _sizes(held: DataFrame) -> tuple[int, int]:
    """Chunks, and words of all of them, by the rows of the empty term."""
    return tuple(held.filter("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum(F.col("len") * F.col("tf")), F.lit(0))).first())


def _bm25_of(bag: DataFrame, held: DataFrame, k: int, query: str, key: str) -> DataFrame:
    return _best(bag, held.filter("term <> ''"), *_sizes(held), k, query, key)


def _units_bag(bag: DataFrame, units: DataFrame, query: str) -> DataFrame:
    """The bag with each phrase as one more term."""
    return bag.unionByName(units.groupBy(query, F.col("unit").alias("term")).agg(F.count("*").alias("mult")))


def named_phrases(phrases: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, phrase, unit): the words of each phrase, joined by a space."""
    return phrases.groupBy(query, "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda w: w["term"]), " ").alias("unit"))


def best_by_bm25(bag: DataFrame, phrases: DataFrame, units: DataFrame, held: DataFrame, n: int, total: int, k: int = TOP_K, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(query, key, score, rank) of a table (key, len, term, tf, places) of what chunks hold of the queries' terms. n, total:
    chunks, and words of all of them.

    A phrase that occurs is one more term."""
    if not n or not total:
        return _no_hits(bag, held, query, key)
    counts = held.select(key, "len", "term", "tf")
    if not phrases.isEmpty():  # few queries have any
        places = held.select(F.struct(key, "len").alias("_c"), F.explode("places").alias("pos"), "term")
        found = phrase_counts(places, phrases, query, "_c").join(units, [query, "phrase"])
        counts = counts.unionByName(found.groupBy("unit", "_c").agg(F.max("tf").alias("tf")).select(f"_c.{key}", "_c.len", F.col("unit").alias("term"), "tf"))
        bag = _units_bag(bag, units, query)
    return _best(bag, counts, n, total, k, query, key)


def _best(bag: DataFrame, counts: DataFrame, n: int, total: int, k: int, query: str, key: str) -> DataFrame:
    """(query, key, score, rank) of a table (key, len, term, tf) that has phrases as terms.

    Chunks are dealt by their key into blocks. Each block meets the queries' weights: a term's part of a score is a product of
    what the query and what the chunk tells of it, so the scores of a block are a sparse matrix product, and only the k best
    of each query leave the task, whatever share of the chunks a common term is in."""
    if not n or not total:
        return _no_hits(bag, counts, query, key)
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = bag.join(df, "term").select(query, "term", (F.col("mult") * F.when(idf <= 0, IDF_FLOOR).otherwise(idf)).alias("_w"))
    turns = max(1, -(-bag.select(query).distinct().count() // QUERIES))
    blocks = max(1, -(-n // CHUNKS))
    left = asked.withColumn("_turn", F.pmod(F.xxhash64(query), F.lit(turns)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = counts.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    average = total / n

    def meet(some: pa.Table, block: pa.Table) -> pa.Table:
        names, items, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        own, held_keys = some[query].combine_chunks().dictionary_encode(), block[key].combine_chunks().dictionary_encode()
        if some.num_rows and block.num_rows:
            terms = some["term"].combine_chunks().dictionary_encode()
            term = pc.index_in(block["term"].combine_chunks(), value_set=terms.dictionary)
            known = term.is_valid().to_numpy(zero_copy_only=False)
            term, chunk = term.fill_null(0).to_numpy()[known], held_keys.indices.to_numpy()[known]
            tf, size = block["tf"].to_numpy()[known].astype(float), block["len"].to_numpy()[known].astype(float)
            share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
            order = np.lexsort((chunk, term))
            term, chunk, share = term[order], chunk[order], share[order]
            begins = np.searchsorted(term, np.arange(len(terms.dictionary) + 1))
            values = held_keys.dictionary.to_pylist()
            place = np.empty(len(values), np.int64)
            place[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))  # ties go to smaller keys
            who, which, weight = own.indices.to_numpy(), terms.indices.to_numpy(), some["_w"].to_numpy()
            turn = np.lexsort((which, who))
            cuts = np.searchsorted(who[turn], np.arange(len(own.dictionary) + 1))
            for q in range(len(own.dictionary)):
                sums = np.zeros(len(values))
                for x in turn[cuts[q] : cuts[q + 1]]:
                    at = slice(begins[which[x]], begins[which[x] + 1])
                    sums[chunk[at]] += weight[x] * share[at]
                near = np.flatnonzero(sums)
                value = np.round(sums[near], PLACES)
                if len(near) > k:
                    best = value >= np.partition(value, len(near) - k)[len(near) - k]
                    near, value = near[best], value[best]
                first = np.lexsort((place[near], -value))[:k]
                names.append(np.full(len(first), q))
                items.append(near[first])
                scores.append(value[first])
        take = lambda coded, at: coded.dictionary.take(pa.array(np.concatenate(at).astype(np.int64)))
        return pa.table([take(own, names), take(held_keys, items), pa.array(np.concatenate(scores))], names=[query, key, "score"])

    kinds = bag.schema[query].dataType.simpleString(), counts.schema[key].dataType.simpleString()
    found = left.groupBy("_block", "_turn").cogroup(right.groupBy("_block", "_turn")).applyInArrow(meet, f"{query} {kinds[0]}, {key} {kinds[1]}, score double")
    return top_k(found, k, query, key)


def _no_hits(bag: DataFrame, held: DataFrame, query: str, key: str) -> DataFrame:
    return bag.sparkSession.createDataFrame([], f"{query} {bag.schema[query].dataType.simpleString()}, {key} {held.schema[key].dataType.simpleString()}, score double, rank int")


def fuse(rankings: list[DataFrame], k: int = TOP_K, constant: int = RRF_K, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of rankings (query, item, rank); their scores are not read."""
    every = None
    for ranking in rankings:
        one = ranking.select(query, item, "rank")
        every = one if every is None else every.unionByName(one)
    scored = every.groupBy(query, item).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"))
    return top_k(scored, k, query, item)


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = TOP_K, stemmed: bool = True, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Dense and lexical hits, at least CANDIDATES of each, fused. queries: query, text and embedding."""
    return runs(queries, chunks, vectors, ("hybrid",), k, stemmed, query, key).drop("retriever")


def runs(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, names: tuple[str, ...] = ("lexical", "dense", "hybrid"), k: int = TOP_K, stemmed: bool = True, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(retriever, query, key, score, rank) of the lexical, the dense and the hybrid run, with fused scores.

    Each arm is searched once for all runs that it serves: its hits are dealt to them, and every run is a fusion of its arms,
    which keeps the order of a single one."""
    many, arms = max(CANDIDATES, k), []
    for arm, hits in (("dense", lambda: dense_top_k(queries.filter("embedding is not null"), vectors, many, query=query, item=key)), ("lexical", lambda: bm25_top_k(queries, chunks, many, stemmed, query, key))):
        if own := [n for n in names if n in (arm, "hybrid")]:
            run = F.explode(F.array(*map(F.lit, own))).alias("retriever")
            arms.append(hits().select(run, query, key, "rank").select(F.struct("retriever", query).alias("_run"), key, "rank"))
    return fuse(arms, k, query="_run", item=key).select("_run.*", key, "score", "rank")


def rerank(candidates: DataFrame, score: Column, k: int = RERANK_TOP_K, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The k best candidates by a second score, a column of the candidates."""
    return top_k(candidates.drop("rank").withColumn("score", score), k, query, item)


def hydrate(hits: DataFrame, chunks: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """hits with the chunks' columns; ids without a chunk are dropped. Text joins last, for the hits only, and is not shuffled if
    they are few."""
    return few(hits, "hits").join(chunks.drop("score", "rank"), key)


def confidence(queries: DataFrame, hits: DataFrame, least: float = LOW_CONFIDENCE, query: str = "query_id") -> DataFrame:
    """(query, top_score, confidence): empty, low or ok."""
    best = hits.groupBy(query).agg(F.max("score").alias("top_score"))
    told = F.when(F.col("top_score").isNull(), "empty").when(F.col("top_score") < least, "low").otherwise("ok")
    return queries.select(query).join(best, query, "left").withColumn("confidence", told)


def side_by_side(left: DataFrame, right: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Two rankings of the same queries, rank by rank, with same_chunk."""
    a = left.select(query, "rank", F.col(item).alias("left_id"), F.col("score").alias("left_score"))
    b = right.select(query, "rank", F.col(item).alias("right_id"), F.col("score").alias("right_score"))
    return a.join(b, [query, "rank"], "full_outer").withColumn("same_chunk", F.coalesce(F.col("left_id") == F.col("right_id"), F.lit(False)))


def contract_faults(hits: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(query, fault) of rankings that hold over k hits, an item twice, gaps in ranks or scores out of order."""
    w = Window.partitionBy(query).orderBy("rank")
    rows = hits.withColumns({"_above": F.lag("score").over(w), "_id": F.lag(item).over(w), "_at": F.row_number().over(w)})
    order = F.when(F.col("score") > F.col("_above"), "scores ascend").when((F.col("score") == F.col("_above")) & (F.col(item) < F.col("_id")), "ties are out of order").when(F.col("rank") != F.col("_at"), "ranks have gaps").when(F.col("_at") > k, "too many hits")
    twice = hits.groupBy(query, item).count().filter("count > 1").select(query, F.lit("an item stands twice").alias("fault"))
    return rows.select(query, order.alias("fault")).filter("fault is not null").unionByName(twice).distinct()
