"""A training-corpus pipeline of five operators. Each stage reads what its predecessor kept.

Verdicts hold for rows: a null or repeated doc_id is no reason to drop or keep a row. A null text counts as empty, a null source as
a domain of its own; an empty table gives an empty one; columns other than those of documents are ignored, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import jaccard, packing, quality, substrings, toxicity
from changeloom.llm.shared import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to all labels, does not call toxic. Each row is scored by itself; an empty text is kept as clean text is."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(docs, labels, 0.7, keep=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither their own rules nor their domain's verdict reject; each row is judged by itself, whatever its doc_id."""
    return quality.judge(docs, keep=COLUMNS).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates (five words, 0.8): that of least doc_id, a null one last, equal ones by their content.

    Rows are linked by a key of their own, so rows that share a doc_id or have none are linked and kept by their texts only.
    """
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    linked = jaccard.link_documents(rows.select(F.col("row").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS[1:]).alias("content"), "row")
    first = rows.select("row", order.alias("o")).join(linked, "row").groupBy("component_id").agg(F.min("o").alias("o")).select("o.row")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that are found elsewhere too, the first place included. All rows stay; a text of which nothing is left is empty."""
    out = substrings.remove_repeats(docs, with_text=True, keep=["lang", "source"])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of token ids; each row's ids lie in just one piece each, a null or empty text is the closing id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeats), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
