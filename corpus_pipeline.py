"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.llm.common import table, written
from progscan.llm.line_dedup import dedup_lines
from progscan.llm.lsh_forest import one_of_each
from progscan.llm.mixing import mixed
from progscan.llm.pieces import encode
from progscan.llm.quality_rules import keep_good

#: Sampling, learned verdicts and byte-pair merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are probably junk go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines stay where they stand first; n_chars follows the text."""
    out = dedup_lines(docs, n_removed="n_removed_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast("long"))
                          .otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights; a document stands in the mix as often as it is taken."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document of the mix."""
    out = encode(docs, ids="ids")
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
