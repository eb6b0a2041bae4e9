"""Stages of the pipeline on empty tables, clashing columns, maps and rows without ids."""

from pyspark.sql import functions as F

import corpus_pipeline
from hydroseries.llm.dartmin import without_near_copies

from .odd import empty, frame, rows


def landed(path, docs, bench):
    docs.write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_of_empty_tables(spark, tmp_path):
    sf = landed(tmp_path, empty(spark), spark.createDataFrame([], "item_id long, text string"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(spark), sf)
        assert out.count() == 0 and {"doc_id", "text", "source"} <= set(out.columns)
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    sf = landed(tmp_path, frame(spark), spark.createDataFrame([(1, None), (2, ""), (3, "no document holds these words")], "item_id long, text string"))
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert len(out) and set(out["doc_id"].dropna()) <= {r[0] for r in rows()}
    assert {1, 2, 3, 15, 8, 9, 10}.isdisjoint(out["doc_id"]) and 7 in set(out["doc_id"])


def test_repeated_rows_with_a_map(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g"), (3, "other words")], "doc_id long, text string")
    out = without_near_copies(docs.withColumn("more", F.create_map(F.lit("k"), F.lit("v")))).collect()
    assert sorted((r["doc_id"], r["more"]["k"]) for r in out) == [(1, "v"), (3, "v")]
