"""Registered corpus queries, and the pipeline's stages on planted cases."""

import __spark_entry__ as entry
import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

import check
from meterlake.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    _, _, verdict = check.compare(spark, check.connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf)
    assert verdict == "ok"


def test_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_stages_drop_what_they_should(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = docs.count()
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    texts = {r.doc_id: r.text for r in docs.where("lang = 'en' and length(text) > 1500").limit(3).collect()}
    first, second, *_ = texts
    planted = spark.createDataFrame(
        [(10**6, texts[first], "en", "x", 1), (10**6 + 1, texts[second] + " " + item, "en", "x", 1), (10**6 + 2, "#$% ZQX!! " * 80, "en", "x", 1), (10**6 + 3, "12 34", "en", "x", 1), (10**6 + 4, None, "en", "x", 1)],
        docs.select("doc_id", "text", "lang", "source", "n_chars").schema,
    )
    rows, counts = docs.unionByName(planted), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{tmp_path}/{i}"
        stage(spark, rows, sf).write.parquet(path)
        rows = spark.read.parquet(path)
        assert rows.columns == docs.columns
        counts.append({r.doc_id for r in rows.select("doc_id").collect()})
    quality, language, unique, clean = counts
    assert 10**6 + 2 not in quality and 10**6 + 4 not in quality and len(quality) > 0.8 * known
    assert 10**6 + 3 not in language and len(language) > 0.9 * len(quality)
    assert 10**6 not in unique and 10**6 + 1 not in clean and clean <= unique <= language <= quality
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()
    assert {r.doc_id for r in pieces} == clean


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = [f"word{i}" for i in range(460)]
    above, below = list(words), list(words)
    above[20:460:44] = [f"new{i}" for i in range(10)]  # 406 of 506 five-word shingles: 0.802; four words: 0.839
    below[20:460:38] = [f"old{i}" for i in range(12)]  # 396 of 516: 0.767
    rows = [(i, " ".join(w), "en", "x", 1) for i, w in enumerate([words, above, below])]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema), sf)
    assert {r.doc_id for r in kept.collect()} == {0, 2}


def test_near_duplicate_stage_shuffles_no_text_that_surely_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("id", F.lit("own"))
    null = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    left = corpus_pipeline.near_duplicate_stage(spark, docs.unionByName(docs.limit(5)).unionByName(null), sf)
    plan = left._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().apply(0).toString()
    got = left.collect()
    assert left.columns == docs.columns and {r.id for r in got} == {"own"} and len(got) == len({r.doc_id for r in got}) + 5


def test_stages_bring_few_megabytes_of_texts_to_a_worker_at_once(spark, sf):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(1).alias("n_chars"))

    def sizes(frames):
        for frame in frames:
            yield pd.DataFrame({"rows": [len(frame)], "size": [int(frame["text"].str.len().sum())]})

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs.limit(20), sf)
            got = docs.mapInPandas(sizes, "rows long, size long").toPandas()
            assert got["rows"].sum() == 3000 and got["size"].max() <= (4 << 20) + 10_000
        spark.conf.set(key, "1m")  # the session's own bound stays
        corpus_pipeline.STAGES[-1][1](spark, docs.limit(20), sf)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
