"""Writers checked by reading back what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkstream import schemas
from inkstream.plans.events import store
from inkstream.plans.registry import query
from inkstream.session import ensure_checkpoint_dir
from inkstream.sources import streams, tables
from inkstream.sources.views import Tables


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"


@query(
    "write_table",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem",
    floats=("l_quantity",),
)
def _(t: Tables):
    path = _folder(t.spark)
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
    tables.write_table(t.lineitem.select(*cols), path, partition_by=["l_returnflag", "l_linestatus"])
    return tables.read_table(t.spark, path)


@query(
    "write_zone",
    "SELECT document_id, document_type, confidence, event_time, CAST(event_time AS DATE) AS date FROM doc_events",
    ("doc_events",),
    floats=("confidence",),
)
def _(t: Tables):
    rows = t.doc_events().select("document_id", "document_type", "confidence", "event_time")
    path = tables.write_zone(rows, _folder(t.spark), "processed", "event_time", "documents")
    schema = "document_id BIGINT, document_type STRING, confidence DOUBLE, event_time TIMESTAMP_NTZ, date DATE"
    return t.spark.read.schema(schema).json(path)


@query("write_jsonl", "SELECT doc_id, text, lang FROM documents")
def _(t: Tables):
    path = _folder(t.spark)
    tables.write_jsonl(t.documents.select("doc_id", "text", "lang"), path)
    return t.spark.read.schema("doc_id BIGINT, text STRING, lang STRING").json(path)


@query("export_csv", "SELECT event_id, event_type, value, user_id FROM events", floats=("value",))
def _(t: Tables):
    path = _folder(t.spark)
    tables.export(t.events.select("event_id", "event_type", "value", "user_id"), path, "csv")
    schema = "event_id BIGINT, event_type STRING, value DOUBLE, user_id BIGINT"
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query("export_json", "SELECT event_id, event_type, value, ts FROM events", floats=("value",))
def _(t: Tables):
    path = _folder(t.spark)
    tables.export(t.events.select("event_id", "event_type", "value", "ts"), path, "json")
    return t.spark.read.schema("event_id BIGINT, event_type STRING, value DOUBLE, ts TIMESTAMP_NTZ").json(path)


@query(
    "publish_and_read_events",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, aggregate_id, CAST(version AS INT) AS version, timestamp FROM store",
    ("store",),
)
def _(t: Tables):
    """Events published as JSON lines, then consumed from the start by a second stream."""
    root = _folder(t.spark)
    store(t).withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(f"{root}/store")
    saved = t.spark.read.parquet(f"{root}/store")
    stream = t.spark.readStream.schema(saved.schema).parquet(f"{root}/store")
    streams.publish_events(stream, f"{root}/topic", f"{root}/c1").awaitTermination()
    events = streams.read_event_stream(t.spark, f"{root}/topic", schema=schemas.EVENT_ENVELOPE)
    wanted = events.select("event_id", "event_type", "aggregate_id", "version", "timestamp")
    streams.fan_out({"events": wanted}, root, f"{root}/c2")["events"].awaitTermination()
    out = t.spark.read.parquet(f"{root}/events")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
