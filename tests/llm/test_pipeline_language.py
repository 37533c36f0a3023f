"""The pipeline's language stage rejects texts in no learned language and keeps the others."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline as P

OTHER = [(-1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 4), (-2, "敏捷的棕色狐狸跳过懒狗。" * 8), (-4, "12 34 !! 56"), (-5, None)]
GIBBERISH = [(-10 - i, " ".join("".join(random.Random(f"{i} {j}").choices("bcdfghjklmnpqrstvwxz", k=7)) for j in range(60))) for i in range(5)]


def _with(docs, rows):
    more = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    return docs.select("doc_id", "text", "lang").unionByName(more.withColumn("lang", F.lit(None).cast("string")))


def test_unknown_texts_go_and_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = P.quality(spark, docs, sf)
    kept = {r.doc_id for r in P.language(spark, _with(docs, [*OTHER, *GIBBERISH, (-3, "ab")]), sf).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept == lettered | {-3}


def test_a_wrong_label_does_not_save_gibberish(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '[a-z]'")
    got = P.language(spark, _with(docs, GIBBERISH).withColumn("lang", F.coalesce("lang", F.lit("en"))), sf)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}


def test_few_learned_rows_reject_no_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '[a-z]'")
    few = docs.withColumn("lang", F.when(F.col("doc_id") < 12, F.col("lang")))
    assert P.language(spark, few, sf).count() == docs.count()


def test_nothing_learned_keeps_every_text_with_a_letter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '[a-z]'").withColumn("lang", F.lit(None).cast("string"))
    assert docs.count() > 0
    got = P.language(spark, _with(docs, OTHER), sf)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} | {-1, -2}


def test_stages_on_edge_cases(spark, sf):
    import corpus_pipeline as P

    rows = [(1, None, "en", None, 1, "r"), (2, "", None, "s", None, "r"), (2, "", None, "s", None, "r"), (None, "the same few words of text here", "en", "s", 5, "r"), (7, "the same few words of text here", "en", "s", 5, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_ro.w` string")
    for table in (docs, docs.where("doc_id < 0")):
        n = table.count()
        for name, stage in P.STAGES:
            out = stage(spark, table, sf)
            if name == "packing":
                assert out.count() == n
            else:
                assert out.columns == docs.columns and out.count() <= n
    assert sorted(str(r.doc_id) for r in P.near_duplicates(spark, docs, sf).collect()) == ["1", "2", "2", "7", "None"]
