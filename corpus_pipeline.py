"""The training-data pipeline over ``documents``.

STAGES: quality rules, SimHash near-dedup, substring dedup, packing. Each function takes
(spark, docs, sf_dir); its result is written as Parquet and reread as the next one's ``docs``.
All but the last return the columns of ``documents``. Null ids: see each stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deadwire.llm import packing, quality, simhash, substring
from deadwire.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (null and empty texts among them)."""
    return quality.quality(docs.select(*COLUMNS), keep_text=True).where("kept").select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 4 bits or fewer one row stays: that with the smallest id, a row
    without an id only if none has one; then by the hashes of the texts."""
    key = ["unnamed", "id", "th", "tk"]  # equal keys are one document
    docs = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                       F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("tk"))
    found = simhash.near_duplicates(docs, shingle=4, radius=4, carry=tuple(key))
    keep = found.groupBy("root").agg(F.min(F.struct(*key)).alias("lead")).select("lead.*")
    return docs.join(keep, key, "left_semi").dropDuplicates(key).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also stand earlier are cut out of the texts; ``n_chars`` follows. A
    document that loses all its words stays with an empty text."""
    out = substring.remove_repeats(docs.select(*COLUMNS), layout=True, carry=("lang", "source"))
    return out.select(substring.restore_id("doc_id"), "text", "lang", "source",
                      F.length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, each a piece of one document, with their token ids."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", simhash_dedup),
          ("substring dedup", substring_dedup), ("packing", packing_stage)]

#: XXH64 fingerprints and tokenizer ids have no SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
