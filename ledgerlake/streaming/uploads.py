"""Uploads as a stream: each batch restates its windows and settles, groups and matches again only what these touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.changes import Delta, Stored, upload_changes
from ledgerlake.operators.rounds import settled
from ledgerlake.sources.store import Store

WINDOW = ["user_id", "broker", "period_from", "period_before"]
#: By which each table of the store is dealt into buckets.
KEYS = {"postings": "user_id", "groups": "group_id", "matches": "from_group_id", "routed": "group_id", "uploads": "user_id"}


def newest_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``uploads`` (WINDOW, uploaded_at, and a posting each) that are their window's newest, and newer than what ``known`` (WINDOW, uploaded_at) has of it."""
    last = uploads.withColumn("_last", F.max("uploaded_at").over(Window.partitionBy(*WINDOW))).where("uploaded_at = _last").drop("_last")
    held = known.select(*WINDOW, F.col("uploaded_at").alias("_held"))
    return last.join(held, WINDOW, "left").where("_held is null or uploaded_at > _held").drop("_held")


def apply_batch(store: Store, batch: DataFrame, instruments: DataFrame, derive: Callable[[DataFrame, DataFrame], DataFrame], rematch: Callable[[Stored, DataFrame], DataFrame] | None = None) -> int:
    """Applies one batch of uploads to ``store`` as one commit and returns the version.

    A window is stated whole by its newest upload (uploaded_at), so late, shuffled and repeated uploads leave
    what the newest alone would; windows of a user and broker are equal or apart. An upload without postings
    has one row whose tx_id is null. ``rematch``(tables, touched groups) proposes the matches of groups that
    the batch touched. Nothing is written for a batch that changes nothing.
    """
    version = store.version()
    stored = Stored(*(store.read(n, version) for n in Stored._fields))
    new = settled(newest_uploads(batch, store.read("uploads", version)))
    if new.isEmpty():
        return version
    windows = new.select(*WINDOW).distinct()
    postings = new.where("tx_id is not null").drop("period_from", "period_before", "uploaded_at").dropDuplicates(["tx_id"])
    deltas = upload_changes(stored, windows, postings, instruments, derive)
    said = settled(new.select(*WINDOW, "uploaded_at").distinct())
    before = store.read("uploads", version).join(windows, WINDOW, "left_semi").select(*said.columns)
    deltas["uploads"] = Delta(settled(before), said)
    if rematch:
        touched = settled(deltas["routed"].added.select("group_id").distinct())
        left = stored.matches.exceptAll(deltas["matches"].removed)
        found = rematch(stored._replace(matches=left, routed=deltas["routed"].added), touched)
        deltas["matches"] = Delta(deltas["matches"].removed, settled(found.select(*stored.matches.columns)))
    return store.commit({}, version, KEYS, deltas)


def replay(uploads: DataFrame, store: Store, instruments: DataFrame, derive: Callable, checkpoint: str, rematch: Callable | None = None) -> None:
    """Applies what has arrived on the stream ``uploads`` batch by batch; a batch that is handed on twice changes nothing the second time."""
    step = lambda batch, number: apply_batch(store, batch, instruments, derive, rematch)
    uploads.writeStream.foreachBatch(lambda batch, number: step(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
