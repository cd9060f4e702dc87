"""Incremental re-analysis (T1) with latest-version-wins state.

Saves arrive as a change feed: parquet records (repo, path, content, version)
appended to a landing folder, many saved files per landing file (thousands
of one-file objects would make listing, not analysis, the cost). A
Structured Streaming file source picks up new landing files
(``maxFilesPerTrigger`` bounds a micro-batch); ``foreachBatch`` extracts the
batch's files with the same rules as the batch job and writes three logs
under the state folder, each batch into its own directory (a replayed batch
overwrites its own output, so the sink is idempotent):

* ``files_log``  (repo, path, lang, version): every file version seen, also
                  those that yield no facts, so a newer empty version retracts
                  the older facts;
* ``facts_log``  extraction facts tagged with their file version;
* ``routes_log`` routes and calls tagged with their file version.

A deletion is a save without text (``deleted``); it takes the file's facts away. A save that is delivered
twice counts once, within a batch and across batches.

The current state keeps, per (repo, path), only the rows of the highest
version (``max`` per key, then a semi-join), and the whole analysis
(registry, diff, global pass, rollups) runs on it unchanged.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deadwire.operators.extract import extract, facts_of, routes_of
from deadwire.plans.pipeline import Analysis
from deadwire.sources.files import lang_of

LANDING_SCHEMA = "repo string, path string, content string, version bigint, deleted boolean"
SAVES_PER_TASK, LEAST_SAVES = 5000, 200


def write_drop(files: DataFrame, landing: str, version: int, deleted: bool = False) -> None:
    """Land a set of saved files(repo, path, ..., content) as one version; with ``deleted`` the
    files(repo, path, ...) are gone from that version on."""
    content = F.lit(None).cast("string") if deleted else F.col("content")
    (files.select("repo", "path", content.alias("content"), F.lit(version).cast("bigint").alias("version"),
                  F.lit(deleted).alias("deleted"))
     .write.mode("append").parquet(landing))


def _saves(df: DataFrame) -> DataFrame:
    """Landing records -> files(repo, path, lang, content, version, deleted), one row per (repo, path):
    within a batch only the newest version counts. If a version was delivered twice, a deletion goes
    before a save and the larger text before the smaller, so a replay picks the same row."""
    best = F.max_by(F.struct("content", "deleted"), F.struct("version", "deleted", "content"))
    return (df.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
            .groupBy("repo", "path").agg(F.max("version").alias("version"), best.alias("best"))
            .select("repo", "path", lang_of(F.col("path")).alias("lang"), "best.content", "version", "best.deleted")
            .filter(F.col("lang").isNotNull()))


def dealt_by_file(rows: DataFrame, saves: int) -> DataFrame:
    """``rows`` of ``saves`` saves by file in tasks of about SAVES_PER_TASK, fewer if cores are free. Input splits and
    adaptive execution count bytes, ``spark.sql.shuffle.partitions`` is set for the whole input; a batch is a part of it,
    and a task costs some tenths of a second for the Python workers and files of its own."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil(saves / SAVES_PER_TASK), min(cores, math.ceil(saves / LEAST_SAVES)), 1)
    return rows.repartition(tasks, "repo", "path")


def _batch_writer(state: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        ex = extract(_saves(dealt_by_file(batch, batch.count())), keep=["version", "deleted"]).persist()
        out, n = f"batch={batch_id}", F.lit(batch_id).cast("bigint").alias("seen")
        ex.select("repo", "path", "lang", "version", "deleted", n).write.mode("overwrite") \
            .parquet(f"{state}/files_log/{out}")
        facts_of(ex, ["version"]).withColumn("seen", n).write.mode("overwrite").parquet(f"{state}/facts_log/{out}")
        routes_of(ex, ["version"]).withColumn("seen", n).write.mode("overwrite").parquet(f"{state}/routes_log/{out}")
        ex.unpersist()
    return write


def run_rescan(spark: SparkSession, landing: str, state: str, checkpoint: str,
               max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start (or resume) the re-analysis stream; with ``available_now`` it
    drains everything landed so far and stops."""
    reader = spark.readStream.format("parquet").schema(LANDING_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(landing)
    w = (stream.writeStream.foreachBatch(_batch_writer(state))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def _latest(state: str, spark: SparkSession) -> DataFrame:
    """(repo, path, version, seen, lang, deleted): the row of each file that counts, that of the highest version
    and, if a version came in several batches, of the first batch that brought it."""
    log = spark.read.parquet(f"{state}/files_log")
    first = F.max_by(F.struct("seen", "lang", "deleted"), F.struct("version", -F.col("seen")))
    return (log.groupBy("repo", "path").agg(F.max("version").alias("version"), first.alias("first"))
            .select("repo", "path", "version", "first.*"))


def current_state(spark: SparkSession, state: str) -> Analysis:
    """Analysis over the latest version of every file seen by the stream; deleted files are
    gone with their facts and routes."""
    latest = _latest(state, spark).where("not deleted")
    keep = ["repo", "path", "version", "seen"]
    facts, routes = (spark.read.parquet(f"{state}/{log}").join(latest, keep, "left_semi")
                     .drop("version", "seen", "batch") for log in ("facts_log", "routes_log"))
    return Analysis(spark, latest.select("repo", "path", "lang"), routes=routes, facts=facts, persist=True)


def compact(spark: SparkSession, state: str, into: str) -> None:
    """Write the rows that still count to the new state folder ``into`` (as its batch -1), so that reading the state
    costs what the files need and not what their history holds. Deletions stay, as they
    outrank saves that arrive late. Give ``into`` to the next ``run_rescan`` with the same checkpoint."""
    latest = _latest(state, spark)
    keep = ["repo", "path", "version", "seen"]
    for log in ("files_log", "facts_log", "routes_log"):
        rows = spark.read.parquet(f"{state}/{log}").join(latest, keep, "left_semi")
        rows.drop("batch").write.parquet(f"{into}/{log}/batch=-1")
