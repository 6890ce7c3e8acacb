"""Event store: append, read, replay and projections.

``store(event_id, event_type, aggregate_id, event_data JSON, timestamp, version)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream import schemas
from inkstream.functions.columns import instant
from inkstream.functions.distributed import number_rows

#: Life-cycle types and the status each one sets (fixed values).
STATUS = {
    schemas.UPLOADED: "uploaded",
    schemas.STARTED: "processing",
    schemas.COMPLETED: "completed",
    schemas.FAILED: "failed",
}
MAX_RETRIES, RETRY_DELAY = 3, "5 MINUTES"


def append_events(new: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """``new`` with the next versions per aggregate, in time order.

    Positions come from the distributed numbering, so one very active aggregate does not
    collect in one task; the current versions are one aggregated row per aggregate.
    """
    cols = [c for c in new.columns if c != "version"]
    numbered = number_rows(new.select(*cols), ["aggregate_id"], ["timestamp", "event_id"], "version")
    numbered = numbered.drop("version_total")
    if store is None:
        return numbered.select(*cols, F.col("version").cast("bigint"))
    last = store.groupBy("aggregate_id").agg(F.max("version").alias("_last"))
    out = numbered.join(last, "aggregate_id", "left")
    version = F.col("version") + F.coalesce("_last", F.lit(0))
    return out.select(*cols, version.cast("bigint").alias("version"))


def events_of(store: DataFrame, aggregate_id: str, from_version: int = 0) -> DataFrame:
    hit = (F.col("aggregate_id") == aggregate_id) & (F.col("version") >= from_version)
    return store.where(hit).orderBy("version")


def events_by_type(store: DataFrame, event_type: str, since=None) -> DataFrame:
    rows = store.where(F.col("event_type") == event_type)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= instant(since))
    return rows.orderBy("timestamp", "event_id")


def _payload(event_type: str, schema: str) -> Column:
    return F.when(F.col("event_type") == event_type, F.from_json("event_data", schema))


def replay(store: DataFrame) -> DataFrame:
    """Latest state of every document: the status of its last life-cycle event, and the
    fields each kind of event sets, from the last event of that kind.

    Each field group is one ``max(struct(version, ...))``, combined on the map side.
    """
    rows = store.where(F.col("event_type").isin(*STATUS))
    parts = {
        "u": _payload(schemas.UPLOADED, schemas.UPLOADED_DATA),
        "s": _payload(schemas.STARTED, schemas.STARTED_DATA),
        "c": _payload(schemas.COMPLETED, "processing_result STRING, processing_duration DOUBLE"),
        "f": _payload(schemas.FAILED, schemas.FAILED_DATA),
    }
    status = F.when(F.lit(False), "")
    for kind, name in STATUS.items():
        status = status.when(F.col("event_type") == kind, name)
    rows = rows.withColumns(parts).withColumn("_status", status)

    def last(part: str, *fields: str) -> Column:
        seen = F.struct("version", "timestamp", *[F.col(f"{part}.{f}").alias(f) for f in fields])
        return F.max(F.when(F.col(part).isNotNull(), seen)).alias(part)

    state = rows.groupBy(F.col("aggregate_id").alias("document_id")).agg(
        F.max(F.struct("version", "_status")).alias("last"),
        last("u", "file_name", "file_size"),
        last("s", "processing_pipeline"),
        last("c", "processing_result", "processing_duration"),
        last("f", "error_message", "error_code", "retry_count"),
    )
    return state.select(
        "document_id",
        F.col("last._status").alias("status"),
        F.col("last.version").cast("bigint").alias("version"),
        "u.file_name",
        "u.file_size",
        F.col("u.timestamp").alias("uploaded_at"),
        "s.processing_pipeline",
        F.col("s.timestamp").alias("processing_started_at"),
        "c.processing_result",
        "c.processing_duration",
        F.col("c.timestamp").alias("completed_at"),
        "f.error_message",
        "f.error_code",
        "f.retry_count",
        F.col("f.timestamp").alias("failed_at"),
    )


def retry_schedule(failures: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Next attempts of failures under three retries, due five minutes later."""
    return failures.where(F.col("retry_count") < MAX_RETRIES).select(
        "document_id",
        (F.col("retry_count") + 1).alias("retry_count"),
        (F.col(ts) + F.expr(f"INTERVAL {RETRY_DELAY}")).alias("scheduled_at"),
    )


def failures(store: DataFrame) -> DataFrame:
    """Failed-processing events with their payload as columns."""
    parsed = store.where(F.col("event_type") == schemas.FAILED).withColumn(
        "f", F.from_json("event_data", schemas.FAILED_DATA)
    )
    return parsed.select("event_id", F.col("aggregate_id").alias("document_id"), "f.*", "timestamp")


def analytics_projection(store: DataFrame) -> DataFrame:
    """One flat analytics row per completed event, with defaults for what is missing."""
    parsed = store.where(F.col("event_type") == schemas.COMPLETED).withColumn(
        "r", F.from_json("event_data", schemas.COMPLETED_DATA)["processing_result"]
    )
    entities = F.col("r.entities.entities")
    return parsed.select(
        "event_id",
        F.col("aggregate_id").alias("document_id"),
        F.coalesce("r.document_type", F.lit("unknown")).alias("document_type"),
        F.coalesce("r.processing_duration", F.lit(0.0)).alias("processing_duration"),
        F.coalesce("r.confidence", F.lit(0.0)).alias("confidence_score"),
        F.coalesce(F.when(entities.isNotNull(), F.size(F.map_keys(entities))), F.lit(0)).alias("entities_count"),
        F.coalesce("r.sentiment.sentiment", F.lit("neutral")).alias("sentiment"),
        F.coalesce("r.language", F.lit("unknown")).alias("language"),
        "timestamp",
    )


def route_events(df: DataFrame) -> dict[str, DataFrame]:
    """The four life-cycle branches and everything else (also on a stream)."""
    kind = F.col("event_type")
    routes = {name: df.where(kind == event) for event, name in STATUS.items()}
    routes["generic"] = df.where(kind.isNull() | ~kind.isin(*STATUS))
    return routes


def status_of_documents(updates: DataFrame, key: str = "document_id", ts: str = "timestamp") -> DataFrame:
    """Latest status row per document."""
    cols = [c for c in updates.columns if c != key]
    last = F.max_by(F.struct(*cols), F.struct(ts, *[c for c in cols if c != ts])).alias("_r")
    return updates.groupBy(key).agg(last).select(key, "_r.*")
