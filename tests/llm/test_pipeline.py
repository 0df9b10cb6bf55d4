"""The pipeline, stage by stage, against plain Python over a small table."""

import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ragspark.llm import bpe, langid, quality
from ragspark.llm.queries import quality_model, remainder
from tests.llm.test_queries import shingles


def test_stages(spark, tmp_path):
    r = np.random.default_rng(1)
    pools = {"en": "the of and to in ing tion er that is".split(), "de": "der die und ein schön über nicht ung".split()}
    rows = [(i, " ".join(r.choice(pools[lang], 60)).capitalize() + ".", lang, "src", 1) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(i, " ".join(w + "***" for w in r.choice(pools["en"], 60)), "en", "src", 1) for i in range(200, 240)]
    rows += [(300, rows[4][1], "en", "src", 1), (301, rows[4][1], "en", "src", 1), (4, rows[4][1], "en", "src", 1), (302, rows[6][1] + " Mail a.b12@mail.example.com or 4111111111111111.", "en", "src", 1), (303, None, "en", "src", None), (304, "", "en", "src", 0)]
    rows += [(305, " ".join(r.choice(pools["en"], 60)) + " Mail a.b12@mail.example.com or 4111111111111111.", "en", "src", 1)]
    few = rows[8][1].split()
    few[20] = few[22] = "other"
    rows += [(306, " ".join(few), "en", "src", 1)]
    # columns with the names that the stages could take for themselves
    docs = spark.createDataFrame([(*x, 1, "k", 0.5, "l") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, _key string, _score double, _lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(120), *range(200, 240)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    key = lambda rows: sorted(((x["doc_id"], x["text"]) for x in rows), key=str)

    kept = read("documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_duplicates", "personal_data", "packing"]
    model = quality_model(spark, kept, read("labels"))
    out = stages["quality"](spark, kept, str(tmp_path))
    assert out.columns == docs.columns
    got = out.collect()
    assert key(got) == key(x for x in kept.collect() if model.score(x["text"]) >= quality.ACCEPT)
    assert {x["doc_id"] for x in got} >= set(range(120)) and not {x["doc_id"] for x in got} & set(range(200, 240))

    kept = spark.createDataFrame(got, docs.schema)
    languages = langid.fit(read("documents").filter(remainder("doc_id", 4) != 2))
    got = stages["language"](spark, kept, str(tmp_path)).collect()
    assert key(got) == key(x for x in kept.collect() if not languages.predict(x["text"])[2])

    kept = spark.createDataFrame(got, docs.schema)
    out = stages["near_duplicates"](spark, kept, str(tmp_path))
    before, got = kept.collect(), out.collect()
    assert out.columns == docs.columns
    # near-duplicates: a similarity of 0.8 or more over five words; 302 is document 6 with some words more
    sets = [shingles(x["text"] or "") for x in before]
    similar = lambda a, b: len(a & b) / len(a | b)
    linked = [{j for j in range(len(sets)) if similar(sets[i], sets[j]) >= 0.8} for i in range(len(sets))]
    assert any(0.7 <= similar(sets[i], sets[j]) < 0.8 for i in range(len(sets)) for j in range(i))  # 306, which stays
    stays = {min((before[j]["doc_id"], k) for k, j in enumerate(sorted(x)))[0] for x in linked}
    assert sorted(x["doc_id"] for x in got) == sorted(stays) and {6, 8, 305, 306} <= stays and not stays & {300, 301, 302} and [x["doc_id"] for x in got if x["text"] == rows[4][1]] == [4]

    kept = spark.createDataFrame(got, docs.schema)
    got = stages["personal_data"](spark, kept, str(tmp_path)).collect()
    changed = {x["doc_id"] for x, y in zip(sorted(got), sorted(kept.collect())) if x["text"] != y["text"]}
    assert changed == {305} and not any(re.search("a.b12@|4111111111111111", x["text"] or "") for x in got)

    kept = spark.createDataFrame(got, docs.schema)
    of = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    pieces = stages["packing"](spark, kept, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {p["doc_id"]: p["n"] for p in pieces} == {x["doc_id"]: len(of.encode_ordinary(x["text"] or "")) + 1 for x in got}
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(p["n"] for p in pieces)
