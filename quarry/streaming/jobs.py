"""Queues and event folds as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def job_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 10) -> DataFrame:
    """New files of a folder as a stream, oldest first: each row is handed out once, which replaces a polled queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def process_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs work over all rows that are there and stops; rerunning goes on after what is done."""
    return work(jobs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Delivery events, and the state that is kept of a message.
DELIVERY = "message_id string, recipient_id string, contact_id string, status string, arrival long"
_DELIVERY_STATE = "recipient_id string, contact_id string, status string, arrival long"
BOUNCES = ["BOUNCED", "COMPLAINED", "SUPPRESSED"]


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the latest event of a message by arrival, of equal ones the greater status, and tells it if it is new."""
    kept = state.get if state.exists else None
    best = kept
    for batch in batches:
        for row in batch[["recipient_id", "contact_id", "status", "arrival"]].itertuples(index=False, name=None):
            if best is None or (row[3], row[2]) > (best[3], best[2]):
                best = row
    if best is not None and best != kept:
        state.update(best)
        yield pd.DataFrame([(key[0], *best)], columns=["message_id", "recipient_id", "contact_id", "status", "arrival"])


def fold_delivery_events(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Folds events (see DELIVERY) into three tables under folder: deliveries by message, recipients' delivery status, and bounced contacts.

    The latest event of each message stays in the stream's state store, so a batch reads its own events and writes only what they change, however
    many messages there are: a folder batch=<number> of each table, which a batch that runs again writes anew. An event that arrives late, or
    again, changes nothing. read_fold gives the tables as they are now.
    """
    changes = events.groupBy("message_id").applyInPandasWithState(_latest, DELIVERY, _DELIVERY_STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        tables = {
            "deliveries": batch.select("message_id", "status", "arrival"),
            "recipients": batch.where("recipient_id is not null").groupBy("recipient_id").agg(F.max_by("status", F.struct("arrival", "status")).alias("status"), F.max("arrival").alias("arrival")),
            "bounces": batch.where(F.col("contact_id").isNotNull() & F.col("status").isin(*BOUNCES)).groupBy("contact_id").agg(F.max("arrival").alias("arrival")),
        }
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_fold(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The latest row of each key of a table of fold_delivery_events."""
    key = {"deliveries": "message_id", "recipients": "recipient_id", "bounces": "contact_id"}[name]
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    if name == "bounces":
        return rows.groupBy(key).agg(F.max("arrival").alias("arrival"))
    return rows.groupBy(key).agg(F.max_by("status", F.struct("arrival", "status")).alias("status"), F.max("arrival").alias("arrival"))


def once_per_window(claims: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first claim of each key within the watermark, on a stream with an event time ts."""
    return claims.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; beyond the reference."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
