"""Streaming jobs run over the supplied events until all of them are processed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import windows as W
import inkstream.plans.windows  # noqa: F401  the streams repeat its queries
from inkstream.plans.events import store
from inkstream.plans.registry import REGISTRY, query
from inkstream.session import ensure_checkpoint_dir
from inkstream.sources.streams import fan_out
from inkstream.sources.views import StreamTables, Tables
from inkstream.streaming import jobs as S
from inkstream.streaming.anomalies import TrailingAnomalies
from inkstream.streaming.fanout import SharedOutputs
from inkstream.streaming.store import ChangeStore
from inkstream.streaming.tables import Versioned

EV = ("doc_events",)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _last(job) -> int:
    job.awaitTermination()
    return int(job.lastProgress["batchId"])


def _naive(df: DataFrame) -> DataFrame:
    """Zoned times back to the plain times of the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def _arrivals(t: Tables, root: str) -> DataFrame:
    """The document events as a stream of files, ten days each, one file per micro-batch.

    A tenth of the events of a file's last six hours arrive with the next one.
    """
    rows = _zoned(t.doc_events())
    late = (F.col("document_id") % 10 == 3) & (F.pmod(_days("event_time"), F.lit(10.0)) >= 9.75)
    return _by_part(rows.withColumn("part", _part("event_time") + late.cast("int")), root)


def _days(ts: str) -> Column:
    return F.unix_micros(ts) / 86_400_000_000


def _part(ts: str) -> Column:
    return F.floor(_days(ts) / 10).cast("int")


def _by_part(rows: DataFrame, root: str) -> DataFrame:
    """Rows as a stream with a micro-batch for each ``part``, in order."""
    spark = rows.sparkSession
    rows.write.parquet(f"{root}/all")
    saved = spark.read.schema(rows.schema).parquet(f"{root}/all")
    for part in sorted(r["part"] for r in saved.select("part").distinct().collect()):  # a few for any number of events
        saved.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(saved.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def _zoned(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


@query("sliding", """WITH w AS (SELECT event_time, document_type, processing_duration, unnest([0, 1, 2]) AS i FROM doc_events)
---
SELECT time_bucket(INTERVAL 2 HOUR, event_time) + to_hours(2 * (i + 1)) AS window_end, document_type, count(*) AS document_count,
  avg(processing_duration) AS avg_processing_duration FROM w GROUP BY 1, 2""", EV, floats=("avg_processing_duration",))  # fmt: skip
def _(t: Tables):
    aggs = {"document_count": F.count(F.lit(1)), "avg_processing_duration": F.avg("processing_duration")}
    return W.tumbling(t.doc_events(), "6 hours", ["document_type"], aggs, slide="2 hours")


_SESSIONS = """WITH o AS (SELECT user_id, event_time, event_time >= lag(event_time) OVER (PARTITION BY user_id ORDER BY event_time) + INTERVAL 2 HOUR AS opens FROM doc_events),
s AS (SELECT user_id, event_time, sum(CAST(coalesce(opens, true) AS INT)) OVER (PARTITION BY user_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS k FROM o)
---
SELECT user_id, min(event_time) AS session_start, max(event_time) + INTERVAL 2 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, k"""


@query("sessions", _SESSIONS, EV)
def _(t: Tables):
    return W.sessions(t.doc_events(), "2 hours")


def _windowed(name: str, width: str, keys: list[str]) -> None:
    """A windowed output as a stream: changed windows are stored by key in every micro-batch."""

    @query(f"stream_{name}", same_as=name)
    def _(t: Tables):
        root = _folder(t.spark)
        stream = S.WINDOWED[name](StreamTables(t.spark, t.folder).doc_events(), width, watermark="1 day")
        store = ChangeStore(f"{root}/{name}", stream.schema, tuple(keys))
        job = S.run_batches(stream, S.upsert_into(store), f"{root}/checkpoint", mode="update")
        return _naive(store.at(t.spark, _last(job)))


_windowed("document_type_distribution", "1 hour", ["window_end", "document_type"])
_windowed("performance_metrics", "1 hour", ["window_end"])
_windowed("user_activity", "1 day", ["window_end", "user_id"])
_windowed("sentiment_trends", "6 hours", ["window_end", "sentiment", "document_type"])
_windowed("language_analytics", "6 hours", ["window_end", "detected_language"])
_windowed("error_analysis", "1 hour", ["window_end", "error_code", "error_message", "document_type"])
_windowed("quality_metrics_window", "6 hours", ["window_end", "document_type"])


def _closed_windows(name: str, width: str, end: str = "window_end") -> None:
    """An output written once a window is closed: the windows that end before the watermark."""

    @query(
        f"stream_{name}",
        f"""SELECT * FROM ({REGISTRY[name].sql}) AS b WHERE {end} <= (SELECT max(event_time) - INTERVAL 1 HOUR FROM doc_events)""",
        EV,
        floats=[f"{c}:{d}" for c, d in REGISTRY[name].digits.items()],
    )
    def _(t: Tables):
        root = _folder(t.spark)
        out = S.WINDOWED[name](StreamTables(t.spark, t.folder).doc_events(), width, watermark="1 hour")
        for job in fan_out({name: out}, root, f"{root}/checkpoint").values():
            job.awaitTermination()
        return _naive(t.spark.read.schema(out.schema).parquet(f"{root}/{name}"))


_closed_windows("throughput_analysis", "1 hour")
_closed_windows("entity_analytics", "1 day")
_closed_windows("realtime_alerts", "6 hours", "alert_time")


@query(
    "stream_duration_anomalies",
    f"""SELECT * FROM ({REGISTRY["duration_anomalies"].sql}) AS b
WHERE event_time < (SELECT max(event_time) - INTERVAL 12 HOUR FROM doc_events)""",
    EV,
    floats=("processing_duration",),
)
def _(t: Tables):
    """Slow documents by their trailing hour, over several micro-batches with rows that come late."""
    root = _folder(t.spark)
    stream = _arrivals(t, root)
    job = TrailingAnomalies(f"{root}/anomalies", "12 hours")
    last = _last(S.run_batches(stream, job.step(), f"{root}/checkpoint"))
    return _naive(job.found(t.spark, last))


#: Width and columns of the outputs of the stream; times and floating-point columns are compared as integers.
_FAN = {
    "performance_metrics": ("1 hour", "window_end total_documents avg_processing_duration max_processing_duration min_processing_duration "
        "successful_documents failed_documents avg_confidence avg_file_size success_rate"),
    "document_type_distribution": ("1 hour", "window_end document_type document_count avg_processing_duration avg_confidence success_count "
        "failure_count success_rate"),
    "sentiment_trends": ("6 hours", "window_end sentiment document_type document_count avg_sentiment_score avg_confidence"),
    "language_analytics": ("6 hours", "window_end detected_language document_count avg_processing_duration avg_confidence success_count success_rate"),
    "error_analysis": ("1 hour", "window_end error_code error_message document_type error_count avg_duration_before_error"),
    "user_activity": ("1 day", "window_end user_id documents_processed avg_processing_duration total_file_size unique_document_types avg_confidence"),
    "throughput_analysis": ("1 hour", "window_end documents avg_processing_duration total_data_processed active_users document_types_processed"),
    "quality_metrics_window": ("6 hours", "window_end document_type avg_confidence high_confidence_docs medium_confidence_docs low_confidence_docs "
        "total_docs high_confidence_rate"),
    "entity_analytics": ("1 day", "window_end document_type entity_type entity_count avg_entity_confidence documents_with_entity"),
    "realtime_alerts": ("6 hours", "alert_time alert_type alert_message document_type event_count metric_value"),
    "duration_anomalies": (None, "event_time document_id processing_duration document_type user_id"),
}
_TIMES = ("window_end", "alert_time", "event_time")


def _fan_sql() -> str:
    """Every output over the whole table, up to the watermark, a row of text for each row."""
    parts = []
    for name, (width, columns) in _FAN.items():
        digits, first = REGISTRY[name].digits, columns.split()[0]
        texts = [
            f"epoch_us({c})" if c in _TIMES else f"CAST(round({c} * 1e{digits[c]}) AS BIGINT)" if c in digits else c for c in columns.split()
        ]
        row = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in texts)
        until = f"{first} {'<=' if width else '<'} (SELECT max(event_time) - INTERVAL 12 HOUR FROM doc_events)"
        parts.append(f"SELECT '{name}' AS output, concat_ws('|', {row}) AS row FROM ({REGISTRY[name].sql}) AS b WHERE {until}")
    return " UNION ALL ".join(parts)


@query("stream_fan_out", _fan_sql(), EV)
def _(t: Tables):
    """The eleven outputs of one stream, from one job over several micro-batches with rows that come late."""
    root = _folder(t.spark)
    stream = _arrivals(t, root)
    outputs = S.stream_outputs({name: width for name, (width, _) in _FAN.items() if width})
    shared = SharedOutputs(f"{root}/shared", outputs, stream.schema, "12 hours", "1 day")
    last = _last(S.run_batches(stream, shared.step(), f"{root}/checkpoint"))
    out = None
    for name, (_, columns) in _FAN.items():
        digits = REGISTRY[name].digits
        texts = [
            F.unix_micros(c) if c in _TIMES else F.round(F.col(c) * 10.0 ** digits[c]).cast("bigint") if c in digits else F.col(c)
            for c in columns.split()
        ]
        row = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in texts])
        rows = shared.output(t.spark, name, last).select(F.lit(name).alias("output"), row.alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "stream_sessions",
    f"""SELECT * FROM ({REGISTRY["sessions"].sql}) AS b WHERE session_end <= (SELECT max(event_time) - INTERVAL 12 HOUR FROM doc_events)""",
    EV,
)
def _(t: Tables):
    """Sessions that the watermark has closed, over several micro-batches with rows that come late."""
    root = _folder(t.spark)
    out = W.sessions(_arrivals(t, root), "2 hours", watermark="12 hours")
    fan_out({"sessions": out}, root, f"{root}/checkpoint")["sessions"].awaitTermination()
    return _naive(t.spark.read.schema(out.schema).parquet(f"{root}/sessions"))


@query("stream_sliding", same_as="sliding")
def _(t: Tables):
    """Sliding windows over several micro-batches with rows that come late: changed windows are stored by key."""
    root = _folder(t.spark)
    aggs = {"document_count": F.count(F.lit(1)), "avg_processing_duration": F.avg("processing_duration")}
    stream = W.tumbling(_arrivals(t, root), "6 hours", ["document_type"], aggs, "12 hours", "2 hours")
    store = ChangeStore(f"{root}/sliding", stream.schema, ("window_end", "document_type"))
    job = S.run_batches(stream, S.upsert_into(store), f"{root}/checkpoint", mode="update")
    return _naive(store.at(t.spark, _last(job)))


@query(
    "document_lifecycle",
    f"""SELECT *, CASE WHEN retry_count < 3 THEN retry_count + 1 END AS next_retry,
  CASE WHEN retry_count < 3 THEN failed_at + INTERVAL 5 MINUTE END AS retry_at
FROM ({REGISTRY['replay'].sql}) AS r""",
    floats=("processing_duration",),
)
def _(t: Tables):
    """Versioned events over several micro-batches; the record of every document at the end."""
    root = _folder(t.spark)
    store(t).withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(f"{root}/store")
    saved = t.spark.read.parquet(f"{root}/store")
    stream = t.spark.readStream.schema(saved.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/store")
    events = S.newest_events(f"{root}/newest")
    job = S.run_batches(stream, S.keep_newest(events), f"{root}/checkpoint")
    return _naive(S.document_records(events.at(t.spark, _last(job))).drop("processing_result"))


@query(
    "processing_metrics",
    """WITH r AS (SELECT *, value / 1000 AS x, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events)
---
SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS failures, sum(x * power(CAST(0.9 AS DOUBLE), n - i) * CASE WHEN i = 1 THEN 1 ELSE 1 - CAST(0.9 AS DOUBLE) END)
  AS processing_time_avg, count(*) FILTER (event_type <> 'error') * CAST(100 AS DOUBLE) / count(*) AS success_rate,
  count(*) * 60 / (CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000) AS throughput_per_minute FROM r""",
    floats=("processing_time_avg", "success_rate", "throughput_per_minute"),
)
def _(t: Tables):
    root = _folder(t.spark)
    table = Versioned(f"{root}/state", S.METRICS)
    stream = StreamTables(t.spark, t.folder).events.select(
        "event_id",
        F.col("ts").alias("event_time"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("value") / 1000).alias("seconds"),
    )
    job = S.run_batches(stream, S.processing_metrics(table), f"{root}/checkpoint")
    return S.metrics_report(table.at(t.spark, _last(job)))


@query("dedupe_events", "SELECT event_id, event_type FROM events")
def _(t: Tables):
    """Every event delivered twice comes out once: events of a file's last twelve hours come again with the next file, others with the same."""
    root = _folder(t.spark)
    rows = _zoned(t.events.select("event_id", "event_type", F.col("ts").alias("event_time"))).withColumn("part", _part("event_time"))
    again = F.when(F.pmod(_days("event_time"), F.lit(10.0)) >= 9.5, F.col("part") + 1).otherwise(F.col("part"))
    stream = _by_part(rows.unionByName(rows.withColumn("part", again)), root)
    out = S.dedupe_events(stream, "event_id", "1 day").select("event_id", "event_type")
    fan_out({"events": out}, f"{root}/out", f"{root}/checkpoint")["events"].awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{root}/out/events")


@query(
    "late_rows",
    """SELECT event_id, ts AS event_time FROM events WHERE event_id % 10 = 3
AND ts < (SELECT max(ts) FROM events WHERE event_id % 10 <> 3) - INTERVAL 1 DAY""",
)
def _(t: Tables):
    """Every tenth event arrives in a second delivery, after the newest of the others."""
    root = _folder(t.spark)
    late = F.col("event_id") % 10 == 3
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("event_time"))
    rows.where(~late).write.parquet(f"{root}/in/part=1")
    seen = Versioned(f"{root}/seen", "max_time TIMESTAMP, late BIGINT")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in/*")
    split = S.late_rows(seen, f"{root}/late", "1 day")
    S.run_batches(stream, split, f"{root}/checkpoint").awaitTermination()
    rows.where(late).write.parquet(f"{root}/in/part=2")
    S.run_batches(stream, split, f"{root}/checkpoint").awaitTermination()
    return _naive(t.spark.read.schema(rows.schema).parquet(f"{root}/late/*"))


def _post(name: str) -> None:
    @query(f"stream_{name}", same_as=name)
    def _(t: Tables):
        """Over several micro-batches with rows that come late."""
        root = _folder(t.spark)
        width = "1 hour" if name == "moving_average" else "6 hours"
        stream = W.window_averages(_arrivals(t, root), width, watermark="1 day")
        post = S.PostWindows(f"{root}/post", width)
        last = _last(S.run_batches(stream, post.step(), f"{root}/checkpoint", mode="update"))
        return _naive(post.results(t.spark, name).at(t.spark, last))


_post("moving_average")
_post("count_trend")
