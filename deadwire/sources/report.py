"""The report as documents with bounded lists.

The report of a repo has three sections: ``endpoints``, ``deadFieldAnalysis`` (a list of dead fields per endpoint) and
``globalDeadFieldAnalysis``. Lists grow with the corpus, so a list is numbered chunks of at most ``CHUNK`` items, one JSON
line each: {repo, section, pattern, chunk, items: [{place, name, side, path, line, wasteScore}]}. Lines stand in
document order: repo, section, patterns in the order of the UNICODE collation, chunk.

Places come from a global rank over range partitions, so neither a hot repo nor a hot endpoint is one task's list.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deadwire.operators.order import global_rank
from deadwire.plans.pipeline import Analysis, materialize

CHUNK = 1000
_ITEM = "place: bigint, name: string, side: string, path: string, line: int, wasteScore: bigint"
SCHEMA = f"repo string, section string, pattern string, chunk bigint, items array<struct<{_ITEM}>>"


def report_rows(a: Analysis) -> DataFrame:
    """(repo, section, pattern, name, side, path, line, waste_score): an item of the report per row; ``pattern`` is '' where
    the section is one list. An endpoint's name is its pattern and its path the backend file."""
    null = F.lit(None)
    endpoints = a.endpoints().select(
        "repo", F.lit("endpoints").alias("section"), F.lit("").alias("pattern"), F.col("pattern").alias("name"),
        null.cast("string").alias("side"), F.col("backend_file").alias("path"), null.cast("int").alias("line"),
        null.cast("bigint").alias("waste_score"))
    found = ["name", "side", "path", "line", "waste_score"]
    dead = a.dead_fields().select("repo", F.lit("deadFieldAnalysis").alias("section"), "pattern", *found)
    rest = a.global_dead().select("repo", F.lit("globalDeadFieldAnalysis").alias("section"), F.lit("").alias("pattern"), *found)
    return endpoints.unionByName(dead).unionByName(rest)


def write_documents(a: Analysis, out_dir: str, chunk: int = CHUNK) -> None:
    """Write the report of every repo. Endpoints stand in collated order, dead fields by path, line and name; a repo without
    any item has no document."""
    endpoint = F.col("section") == "endpoints"
    by = [F.col("repo"), F.col("section"), F.collate(F.col("pattern"), "UNICODE"), F.col("pattern"),
          F.when(~endpoint, F.col("path")), F.col("line"), F.collate(F.col("name"), "UNICODE"), F.col("name")]
    ranked = global_rank(report_rows(a), by, lambda df, name: materialize(a.spark, df, name, written=a.written))
    key = ["repo", "section", "pattern"]
    first = ranked.groupBy(*key).agg(F.min("rank").alias("first"))
    placed = ranked.join(first, key).withColumn("place", F.col("rank") - F.col("first") + 1).withColumn(
        "chunk", F.floor((F.col("place") - 1) / chunk))
    item = F.struct("place", "name", "side", "path", "line", F.col("waste_score").alias("wasteScore"))
    lines = placed.groupBy(*key, "chunk").agg(F.min("rank").alias("at"), F.array_sort(F.collect_list(item)).alias("items"))
    (lines.repartitionByRange("at").sortWithinPartitions("at").select(*key, "chunk", "items")
     .write.mode("overwrite").json(out_dir))


def read_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """(repo, section, pattern, chunk, place, name, side, path, line, wasteScore): the items of written reports."""
    return spark.read.schema(SCHEMA).json(out_dir).select("repo", "section", "pattern", "chunk", F.inline("items"))
