"""Corpus pipeline: documents in, packed token pieces out.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. A document that the quality
classifier or the language identification rejects goes; of a group of near copies (five-word shingles, similarity 0.8)
the row with the smallest id stays; benchmark passages are cut out of the texts; what is left is packed.

In every stage a null text counts as empty, repeated rows are judged each (near copies: all but one go), an empty table
gives an empty table, and further columns come through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.scratch import discard, materialize
from quayside.llm.fm_index import remove_leaks
from quayside.llm.jaccard_join import keep_one_per_group
from quayside.llm.langid import fit_languages, identify
from quayside.llm.packing import pack_documents, public_vocabulary
from quayside.llm.quality import fit_quality, score_quality

QUALITY_LEAST = 0.3
#: Of the trigrams that a text of the language usually has among the learned ones; see the README for how it was chosen.
KNOWN_LEAST = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a quality score of QUALITY_LEAST or more, the model being learned from all labels. A null id
    has no label, but its text is scored."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where(F.col("score") >= QUALITY_LEAST).select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text is in one of the corpus's languages: texts without a letter go, and those of whose
    trigrams the model knows less than KNOWN_LEAST. If no language could be learned, all texts with a letter stay. What
    ``lang`` says is learned from, and left as it is."""
    return identify(docs, fit_languages(docs)).where(F.col("known") >= KNOWN_LEAST).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest id. Texts without words are in no group; a null
    id goes only if its text has another copy."""
    return keep_one_per_group(docs, n=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut ten-word windows of the benchmark out of the texts; ``n_chars`` follows. A text with nothing left goes; one that
    had no word before stays."""
    clean = remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences of 1024; a text without tokens is its end mark alone."""
    return pack_documents(docs, public_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows being written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models, hashes of token ids and packing are beyond SQL; see tests/llm for the brute-force versions.
ORACLE_SQL = None
