"""Findings of an edited file are withdrawn until its next scan.

Events (repo, path, kind, seq) say what happened to a file: ``scan`` and ``save`` make its findings current, ``edit`` makes
them stale (lines have moved, the text is not the scanned one), ``delete`` ends them. ``seq`` orders a file's events.
A keyed aggregation over the stream holds the last event of every file and its state, and passes on a file only
when its state or sequence moves: a replayed or late event changes nothing and is not written.

Each batch's changes go to a directory of their own (a batch that is delivered again overwrites itself); the state of a
file is that of its highest sequence, and ``visible`` takes the findings of stale and deleted files away.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "repo string, path string, kind string, seq long"
CHANGES = "repo string, path string, state string, seq long"
#: kind of event -> state of the file after it; other kinds are ignored
STATES = {"scan": "scanned", "save": "scanned", "edit": "edited", "delete": "deleted"}
#: of events with one sequence number the later of these counts
_ORDER = {"scanned": 0, "edited": 1, "deleted": 2}


def _now():
    """The time of the running batch, one for all its rows; a batch that is delivered again has the same."""
    return F.unix_micros(F.current_timestamp())


def changes(events: DataFrame) -> DataFrame:
    """Streaming events -> (repo, path, state, seq) of the files whose state has moved in a batch.

    ``since`` is the time of the batch that brought the event that counts. Of events that are alike the earliest counts, so
    a replay keeps its time and only a file that has moved bears that of the running batch."""
    to = F.element_at(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair)), F.col("kind"))
    order = F.element_at(F.create_map(*(F.lit(x) for pair in _ORDER.items() for x in pair)), F.col("state"))
    known = events.select("repo", "path", "seq", to.alias("state"), (-_now()).alias("since")).where("state is not null and seq is not null")
    last = F.max(F.struct("seq", order.alias("order"), "since", "state")).alias("last")
    moved = known.groupBy("repo", "path").agg(last).where(F.col("last.since") == -_now())
    return moved.select("repo", "path", "last.state", "last.seq")


def run_validity(spark: SparkSession, events: str, log: str, checkpoint: str, available_now: bool = True):
    """Start (or resume) the stream over the events landed in a folder; with ``available_now`` it drains them and stops."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    made = changes(spark.readStream.schema(EVENTS).parquet(events))
    writer = made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
    if available_now:
        query.awaitTermination()
    return query


def file_states(spark: SparkSession, log: str) -> DataFrame:
    """(repo, path, state, seq) of every file with an event."""
    moves = spark.read.schema(f"{CHANGES}, batch long").parquet(log)
    last = F.max(F.struct("seq", "batch", "state")).alias("last")
    return moves.groupBy("repo", "path").agg(last).select("repo", "path", "last.state", "last.seq")


def visible(findings: DataFrame, states: DataFrame) -> DataFrame:
    """The findings whose file is as it was scanned; files without any event count as scanned."""
    return findings.join(states.where("state <> 'scanned'").select("repo", "path"), ["repo", "path"], "left_anti")
