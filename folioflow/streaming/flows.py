"""Streams: lazy loads of asked documents, and hit rates of traces over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.store import CorpusStore, load_plan


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """(start, event_type, events, total): counts and sums in fixed windows; works on streams and tables alike.

    On a stream events later than ``late`` behind the watermark are dropped and a
    window is closed by it; on a table nothing is late.
    """
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    return (
        timed.groupBy(F.window(time_col, width).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "events", "total")
    )


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, events): sessions of users, closed after a gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def lazy_load(
    asked: DataFrame,
    store: Callable[[], CorpusStore],
    parse: Callable[[DataFrame], DataFrame],
    append: Callable[[DataFrame], None],
    checkpoint: str,
    on_batch: Callable[[DataFrame], None] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Loads documents as their ids (doc_id) arrive on a stream.

    Each batch is checked against the store as it then is, what is missing is parsed
    (``parse``: ids to chunk rows with doc_id) and appended; ``on_batch`` sees the
    chunk rows before that, and its errors stop nothing. Ids are dropped when
    they come again, and a batch that is repeated after a failure finds its
    documents loaded, so nothing is loaded twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        now = store()
        wanted = batch.select("doc_id").distinct()
        todo = load_plan(wanted, now, wanted.withColumn("chunks", F.lit(1).cast("long"))).filter("status = 'success'").select("doc_id")
        rows = parse(todo)
        if on_batch is not None:
            try:
                on_batch(rows)
            except Exception as e:  # noqa: BLE001
                print(f"batch {number}: callback failed: {e}")
        append(rows)

    writer = asked.dropDuplicates(["doc_id"]).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
