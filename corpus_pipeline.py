"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import jaccard_near, line_dedup, mixing, packing, quality
from tidewatch.llm.common import materialize, only_marked, row_keyed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's adaptive limits reject go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than 1 % of a source's documents (five at least) share go."""
    return line_dedup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more) the row with the smallest doc_id stays (null ones last; of equal ones the first in the table)."""
    keyed = row_keyed(docs, *COLUMNS)
    groups = jaccard_near.near_groups(keyed)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("r")).select("r._k1", "r._k2")
    return only_marked(keyed, first).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's words come near its target; a document stays once for each pass over its source that takes words of it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("simhash near-dedup", near_dedup), ("source mixing", mix), ("best-fit packing", pack)]

#: SimHash groups, pseudorandom mixing and evolved packings are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
