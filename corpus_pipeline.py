"""Corpus preparation over the table documents, stage by stage, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm._common import scratch, table
from quernlake.llm.ngram_join import keep_one
from quernlake.llm.packing import pack_documents
from quernlake.llm.quality import keep_good, train_quality
from quernlake.llm.substring_dedup import deduplicate
from quernlake.llm.toxicity import keep_clean, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the string-kernel machine calls toxic; all columns of the rest as they are.

    Null and empty texts are judged as a word without letters, very long ones whole; repeated rows, equal and null doc_id
    are judged row by row. An empty table stays empty.
    """
    return keep_clean(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the boosted trees call poor; all columns of the rest as they are.

    Null texts are judged as empty ones, very long ones whole; repeated rows, equal and null doc_id row by row. An empty
    table stays empty.
    """
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, the first by doc_id (null last), all columns as they are.

    Texts without words (null, empty) have no duplicates and stay; repeated rows leave one; two different texts with one
    doc_id are judged apart; very long texts are compared whole. Any other columns may be there.
    """
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that an earlier document has; n_chars follows the text.

    Null and empty texts stay as they are, null doc_id neither loses nor takes; rows of equal doc_id take nothing from each
    other. Very long texts are judged whole. Columns named like the operator's own come back as they were.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = deduplicate(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(others)]))
    found = found.select("doc_id", F.col("kept").alias("text"), *[F.col(f"_{k}").alias(c) for k, c in enumerate(others)])
    return (found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences, with their token ids.

    Null and empty texts are a document of the end token alone; repeated rows and null doc_id are packed one by one; very
    long texts are cut into pieces. Columns but doc_id and text are left out. An empty table gives no pieces.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]
#: SQL can express neither the trained classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before kept is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
