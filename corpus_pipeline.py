"""A corpus preparation pipeline over ``documents``: quality rules, language ID,
line dedup, SimHash near-dedup, best-fit packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
rows its predecessor kept; its result is written as Parquet and read again
before the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlake.llm import langid, line_dedup, packing, quality, simhash
from fraudlake.llm.common import set_aside, table, written
from fraudlake.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return langid.keep_known(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but one; the documents stay, with the
    shorter text and its new length in ``n_chars``."""
    plain, back = set_aside(docs, ["doc_id", "text"])
    out = line_dedup.dedup_lines(plain)
    shorter = F.col("n_dropped") > 0
    out = out.withColumn("text", F.when(shorter, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        name = f"_extra{docs.columns.index('n_chars')}"
        length = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn(name, F.when(shorter, length).otherwise(F.col(name)))
    return back(out)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id."""
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of the remaining documents lies in the packed sequences."""
    return packing.packed(docs).select(F.col("id").alias("doc_id"), "piece", "start", "length",
                                       F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality_rules", quality_stage), ("language_id", language_stage), ("line_dedup", line_stage),
          ("simhash_near_dedup", near_dedup_stage), ("best_fit_packing", packing_stage)]

# tokenization, fingerprints and the language model are beyond SQL; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
