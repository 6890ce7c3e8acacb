"""Streaming jobs: windows, life cycle, metrics, deduplication, late rows, post-windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstream.functions.distributed import cut_lineage, scalar_struct, scratch
from inkstream.operators import windows as W
from inkstream.operators.events import MAX_RETRIES, RETRY_DELAY, STATUS, replay
from inkstream.streaming.fanout import Output, micros
from inkstream.streaming.store import ChangeStore
from inkstream.streaming.tables import Versioned

#: The windowed outputs of the stream, by name (the eleven outputs minus the row-level ones).
WINDOWED: Mapping[str, Callable[..., DataFrame]] = {
    "performance_metrics": W.performance_metrics,
    "document_type_distribution": W.document_type_distribution,
    "sentiment_trends": W.sentiment_trends,
    "language_analytics": W.language_analytics,
    "error_analysis": W.error_analysis,
    "user_activity": W.user_activity,
    "throughput_analysis": W.throughput_analysis,
    "quality_metrics_window": W.quality_metrics_window,
    "entity_analytics": W.entity_analytics,
    "realtime_alerts": W.realtime_alerts,
}


def stream_outputs(widths: Mapping[str, str], every: str = "1 minute") -> dict[str, Output]:
    """The eleven outputs of the document stream for :class:`SharedOutputs`; ``every`` is the width of those not named."""

    def windowed(name: str) -> Output:
        width = widths.get(name, every)
        return Output(lambda rows: WINDOWED[name](rows, width), width)

    return {name: windowed(name) for name in WINDOWED} | {"duration_anomalies": Output(W.duration_anomalies, before="1 hour")}


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available with ``foreachBatch``."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(fn)
        .start()
    )


def upsert_into(store: ChangeStore) -> Callable[[DataFrame, int], None]:
    """Batch function that stores updated rows by key (for aggregates in update mode)."""
    return store.put


# --- life cycle of documents ---

#: What is kept of a document: the newest event of each kind.
NEWEST = "aggregate_id STRING, event_type STRING, version BIGINT, timestamp TIMESTAMP, event_data STRING"


def newest_events(path: str, expire_after: str | None = None) -> ChangeStore:
    """The table of newest events; with ``expire_after`` (an interval) it drops by and by what :func:`live_events` leaves out."""
    keys, order = ("aggregate_id", "event_type"), ("version", "timestamp", "event_data")
    return ChangeStore(path, NEWEST, keys, order, clock="timestamp", keep=expire_after)


def keep_newest(store: ChangeStore) -> Callable[[DataFrame, int], None]:
    """Batch function that folds life-cycle events into ``store``, in whatever order they arrive.

    The store is all the state there is, and a micro-batch reads none of it: the newest event of a kind wins when rows meet.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("event_type").isin(*STATUS)).select(
            "aggregate_id", "event_type", F.col("version").cast("bigint").alias("version"), "timestamp", "event_data"
        )
        store.put(rows, batch_id)

    return merge


def live_events(newest: DataFrame, expire_after: str) -> DataFrame:
    """Without documents whose newest event is older than that before the newest of all, and without a document's events that are older
    than that before its own newest: whatever the order of arrival, an event that has expired stays so."""
    ago = F.expr(f"INTERVAL {expire_after}")
    last = newest.groupBy("aggregate_id").agg(F.max("timestamp").alias("last"))
    live = last.where(F.col("last") >= newest.select(F.max("timestamp") - ago).scalar())
    return newest.join(live, "aggregate_id").where(F.col("timestamp") >= F.col("last") - ago).drop("last")


def document_records(newest: DataFrame) -> DataFrame:
    """Record of every document, with the next attempt of a failure that may be retried."""
    again = F.col("retry_count") < MAX_RETRIES
    return replay(newest).withColumns(
        {
            "next_retry": F.when(again, F.col("retry_count") + 1),
            "retry_at": F.when(again, F.col("failed_at") + F.expr(f"INTERVAL {RETRY_DELAY}")),
        }
    )


# --- running metrics ---

METRICS = """
    events BIGINT, failures BIGINT, processing_time_avg DOUBLE, first_event TIMESTAMP, last_event TIMESTAMP
"""


def processing_metrics(table: Versioned, keep: float = 0.9) -> Callable[[DataFrame, int], None]:
    """Batch function over ``event_id, event_time, success, seconds``: totals and the moving
    average of all events so far.  A batch is folded by a distributed weighted sum, then
    joined to the one-row state."""

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        one = F.lit(1).alias("_one")
        totals = batch.groupBy(one).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.col("success")).alias("bad"),
            F.min("event_time").alias("a"),
            F.max("event_time").alias("b"),
        )
        folded = W.ewma(
            batch.withColumn("_one", F.lit(1)), ["_one"], ["event_time", "event_id"], "seconds", keep, with_carry=True
        ).withColumnRenamed("n", "timed")
        new = totals.join(folded, "_one", "left")
        old = table.at(spark, batch_id - 1).withColumn("_one", F.lit(1))
        both = new.join(old, "_one", "full_outer")
        zero = F.lit(0)
        was = F.coalesce("processing_time_avg", F.lit(0.0))
        avg = (
            F.when(F.col("timed").isNull(), F.col("processing_time_avg"))
            .when(was == 0, F.col("ewma"))
            .otherwise(was * F.pow(F.lit(keep), F.col("timed")) + F.col("carry"))
        )
        state = both.select(
            (F.coalesce("events", zero) + F.coalesce("n", zero)).alias("events"),
            (F.coalesce("failures", zero) + F.coalesce("bad", zero)).alias("failures"),
            avg.alias("processing_time_avg"),
            F.least("first_event", "a").alias("first_event"),
            F.greatest("last_event", "b").alias("last_event"),
        )
        table.put(state, batch_id)

    return update


def metrics_report(state: DataFrame) -> DataFrame:
    """Success rate and events per minute of event time."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("first_event"), F.col("last_event")) / F.lit(1e6)
    n = F.greatest("events", F.lit(1))
    return state.select(
        "events",
        "failures",
        "processing_time_avg",
        ((F.col("events") - F.col("failures")) / n * 100).alias("success_rate"),
        F.try_divide(F.col("events") * 60, seconds).alias("throughput_per_minute"),
    )


# --- redelivery and lateness ---


def dedupe_events(stream: DataFrame, key: str = "event_id", delay: str = "10 minutes", ts: str = "event_time") -> DataFrame:
    """Drop redeliveries of an event id that come within ``delay`` of event time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def late_rows(
    seen: Versioned, late_path: str, delay: str = "10 minutes", ts: str = "event_time"
) -> Callable[[DataFrame, int], None]:
    """Batch function that keeps rows older than (newest earlier event - ``delay``) aside.

    ``seen`` has ``max_time TIMESTAMP, late BIGINT``, the late rows so far.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        before = scalar_struct(seen.at(batch.sparkSession, batch_id - 1))
        late = F.coalesce(F.col(ts) < before["max_time"] - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(f"{late_path}/v={batch_id}")
        counted = batch.agg(F.max(ts).alias("m"), F.count_if(late).alias("n"))
        state = counted.select(
            F.greatest("m", before["max_time"]).alias("max_time"), (F.col("n") + F.coalesce(before["late"], F.lit(0))).alias("late")
        )
        seen.put(state, batch_id)

    return split


# --- windows that need earlier rows ---

WINDOW_ROWS = "window_end TIMESTAMP, document_type STRING, current_avg DOUBLE, document_count BIGINT"
#: Outputs over the windows before a window of its type: how they are made, and how many windows one window reaches.
POST = {"moving_average": (W.moving_rows, 10), "count_trend": (W.trend_rows, 2)}
HALO = max(reach for _, reach in POST.values()) - 1


@dataclass(frozen=True)
class PostWindows:
    """Moving averages and trends after ``windows.window_averages`` in update mode, under ``root``.

    A micro-batch stores the windows that it has changed, reads them with what follows and the ``HALO`` windows of their type before them, and
    writes only the results that a changed window reaches.
    """

    root: str
    width: str = "1 minute"

    @property
    def windows(self) -> ChangeStore:
        return ChangeStore(f"{self.root}/windows", WINDOW_ROWS, ("window_end", "document_type"), clock="window_end")

    def results(self, spark: SparkSession, name: str) -> ChangeStore:
        schema = POST[name][0](spark.createDataFrame([], WINDOW_ROWS)).schema
        return ChangeStore(f"{self.root}/{name}", schema, ("window_end", "document_type"), clock="window_end")

    def step(self) -> Callable[[DataFrame, int], None]:
        def update(batch: DataFrame, batch_id: int) -> None:
            with scratch():
                self._update(batch, batch_id)

        return update

    def _update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = cut_lineage(batch.select("window_end", "document_type", "current_avg", "document_count"))
        self.windows.put(changed, batch_id)
        rows = cut_lineage(self._range(changed, batch_id))
        by_type = Window.partitionBy("document_type").orderBy("window_end")
        for name, (make, reach) in POST.items():
            near = F.max("changed").over(by_type.rowsBetween(1 - reach, 0))
            touched = rows.withColumn("near", near).where("near").select("window_end", "document_type")
            self.results(spark, name).put(make(rows).join(touched, ["window_end", "document_type"], "left_semi"), batch_id)

    def _range(self, changed: DataFrame, batch_id: int) -> DataFrame:
        """Stored windows from each type's earliest changed one on, and ``HALO`` of its windows before, with ``changed``.

        The store is read from some time on, which goes back further while a type has too few windows since then.
        """
        spark, stored = changed.sparkSession, self.windows.manifest(changed.sparkSession, batch_id)
        first = changed.groupBy("document_type").agg(F.min("window_end").alias("first"))
        low = first.agg(F.min(F.unix_micros("first"))).first()[0]
        marked = changed.select("window_end", "document_type", F.lit(True).alias("changed"))
        span = HALO * micros(self.width)
        while True:
            since = stored["oldest"] if low is None else max(low - span, stored["oldest"])
            known = self.windows.at(spark, batch_id, F.col("window_end") >= F.timestamp_micros(F.lit(since))).join(first, "document_type")
            before = F.col("window_end") < F.col("first")
            lacking = known.groupBy("document_type").agg(F.count_if(before).alias("n")).where(F.col("n") < HALO)
            if low is None or since == stored["oldest"] or lacking.isEmpty():
                break
            span *= 4
        back = F.row_number().over(Window.partitionBy("document_type", before).orderBy(F.desc("window_end")))
        near = known.withColumn("back", back).where(~before | (F.col("back") <= HALO)).drop("back", "first")
        return near.join(marked, ["window_end", "document_type"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
