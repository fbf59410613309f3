"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the
documents it keeps, with the columns of docs.  Each stage's result is written as Parquet
and read again as the next one's docs.  The last stage adds ``copy`` and ``mix_key``.

Every stage judges exactly the rows its predecessor kept.  Rows with a null id cannot be told
apart by id: they pass the duplicate and passage stages as they are, and are judged by their texts like others by
the toxicity, benchmark and mixing stages.  Null and empty texts are kept by every stage but mixing, which draws for them as for
others.  Repeated rows are judged each; columns of other names are carried along.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, mixing, ngram_join, substring_dedup, toxicity
from quarry.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.5 or more; texts without matches stay."""
    # the fit reads the unfiltered table, as labels name its documents
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked by 5-word shingles at a Jaccard similarity of 0.8 or more.

    Rows that repeat the smallest id stay together; texts without words are no group.
    """
    groups = ngram_join.link_components(docs, n=5, num=80, den=100)
    # only ids travel; a document that is not its group's smallest goes
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 50 words or more that an earlier document has; documents that lose every word go, others keep their row.

    Documents that lose nothing keep their text as it is; n_chars is that of the new text.
    """
    kept = substring_dedup.rewrite_documents(docs, 50).where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("doc.text")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None
    return kept.select(*[
        n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c in docs.columns
    ])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark item within a word edit similarity of 0.8, whatever their ids."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the target weights of their sources and shuffle them globally; null ids draw by text, equal rows by their number."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Learned scores, components and edit distances are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
