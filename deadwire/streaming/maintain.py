"""Maintained findings (T1): a save recomputes the repos it touches and no other.

The landing feed is that of ``streaming.rescan``. The state folder holds four views and a log of commits, each batch in
a directory of its own:

* ``files``     (repo, path, lang, version, deleted), deletions included, as they outrank saves that come late;
* ``facts``     field facts of the live files;
* ``routes``    routes and calls of the live files;
* ``findings``  what the analysis of the repo reports, endpoint and global;
* ``commits``   (repo, n_files): the repos that a batch has rewritten.

A repo's current version is the last batch that committed it; a batch writes a new version of the repos it touches
and leaves the files of all others as they are. Commits are written last, so a batch that is lost half way is never
seen, and a batch that is delivered again ignores its own commit and overwrites itself. A save counts if
its version is higher than that of the file; what is older or delivered twice touches nothing.

Per batch: the winning save of each file is found on its keys, the winners' texts are dealt to tasks by their number
and extracted there, and the touched repos' old rows are read from the batch directories that hold their
current version. Work follows the touched repos; reading ``commits`` follows the number of rewrites, which
``compact_views`` resets.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deadwire.operators.extract import extract, facts_of, routes_of
from deadwire.plans.pipeline import Analysis, materialize
from deadwire.sources.files import lang_of
from deadwire.streaming.rescan import LANDING_SCHEMA, dealt_by_file

FIELD = "lang string, ext string, side string, rule string, name string, line int, pos int"
SCHEMAS = {
    "files": "repo string, path string, lang string, version long, deleted boolean",
    "facts": f"repo string, path string, {FIELD}",
    "routes": "repo string, path string, lang string, role string, rule string, method string, url string, lang_rank int",
    "findings": "repo string, source string, pattern string, path string, lang string, side string, name string, "
                "line int, pos int, waste_score long",
    "commits": "repo string, n_files long",
}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _columns(view: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[view].split(", ")]


def _log(spark: SparkSession, state: str, view: str) -> DataFrame:
    """All versions of a view, with their ``batch``."""
    schema = f"{SCHEMAS[view]}, batch long"
    if not _exists(spark, f"{state}/{view}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/{view}")


def versions(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """(repo, batch): the batch that holds each repo's current version (of those earlier than ``before``)."""
    log = _log(spark, state, "commits")
    if before is not None:
        log = log.where(F.col("batch") < before)
    return log.groupBy("repo").agg(F.max("batch").alias("batch"))


def view(spark: SparkSession, state: str, name: str, current: DataFrame | None = None) -> DataFrame:
    """The rows of a view in their repos' current versions (or in those of ``current``). Only the batch directories
    that still count are read: the driver asks for their numbers, one per batch."""
    current = versions(spark, state) if current is None else current
    batches = [r.batch for r in current.select("batch").distinct().collect()]
    return (_log(spark, state, name).where(F.col("batch").isin(batches))
            .join(current, ["repo", "batch"], "left_semi").drop("batch"))


def rewritten(spark: SparkSession, state: str) -> DataFrame:
    """(batch, repo, n_files): the repos that each batch has rewritten."""
    return _log(spark, state, "commits").select("batch", "repo", "n_files")


def _put(df: DataFrame, state: str, name: str, batch: int) -> None:
    (df.select(*_columns(name)).sortWithinPartitions("repo").write.mode("overwrite")
     .parquet(f"{state}/{name}/batch={batch}"))


def _winners(batch: DataFrame) -> DataFrame:
    """(repo, path, lang, version, deleted, text_hash): the save of each file that counts, by its keys only. Of one
    version a deletion goes before a save."""
    key = F.struct("version", "deleted", "text_hash")
    return (batch.groupBy("repo", "path").agg(F.max(key).alias("w"))
            .select("repo", "path", lang_of(F.col("path")).alias("lang"), "w.*").where("lang is not null"))


def _maintain(state: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, written = batch.sparkSession, []
        batch = batch.withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("text_hash", F.xxhash64("content"))
        best = _winners(batch.drop("content"))
        before = versions(spark, state, batch_id)
        old = before.join(best.select("repo").distinct(), "repo", "left_semi")
        held = view(spark, state, "files", old).select("repo", "path", F.col("version").alias("held"))
        saves = materialize(spark, best.join(held, ["repo", "path"], "left")
                            .where("held is null or version > held").drop("held"), "saves", written=written)
        touched = saves.groupBy("repo").agg(F.count("*").alias("n_files"))
        if not touched.isEmpty():
            key = ["repo", "path", "version", "deleted", "text_hash"]
            texts = batch.join(saves.where("not deleted").select(*key), key, "left_semi")
            found = extract(dealt_by_file(texts, saves.count()).withColumn("lang", lang_of(F.col("path"))))
            # a save that is delivered twice is one; extracted rows are compared, not texts
            found = materialize(spark, found.dropDuplicates(["repo", "path"]), "saved", written=written)
            old = before.join(touched, "repo", "left_semi")
            for name, new in (("files", saves), ("facts", facts_of(found)), ("routes", routes_of(found))):
                kept = view(spark, state, name, old).join(saves, ["repo", "path"], "left_anti")
                _put(kept.unionByName(new.select(*_columns(name))), state, name, batch_id)
            files, facts, routes = (spark.read.schema(SCHEMAS[v]).parquet(f"{state}/{v}/batch={batch_id}")
                                    for v in ("files", "facts", "routes"))
            analysis = Analysis(spark, files.where("not deleted").select("repo", "path", "lang"), routes, facts)
            _put(analysis.ledger(), state, "findings", batch_id)
            _put(touched, state, "commits", batch_id)
            written += analysis.written
        for path in written:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return write


def run_maintained(spark: SparkSession, landing: str, state: str, checkpoint: str,
                   max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start (or resume) the stream that keeps the views; with ``available_now`` it drains what has landed and stops."""
    reader = spark.readStream.format("parquet").schema(LANDING_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.load(landing).writeStream.foreachBatch(_maintain(state)).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
    if available_now:
        query.awaitTermination()
    return query


def compact_views(spark: SparkSession, state: str, into: str) -> None:
    """The current versions of all repos as batch -1 of the new state folder ``into``, which goes with the
    same checkpoint from then on."""
    current = versions(spark, state)
    for name in ("files", "facts", "routes", "findings"):
        _put(view(spark, state, name, current), into, name, -1)
    last = _log(spark, state, "commits").join(current, ["repo", "batch"], "left_semi").drop("batch")
    _put(last, into, "commits", -1)
