"""Streaming sources and sinks: files here, Kafka with the same calls on a cluster."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstream import schemas
from inkstream.sources.tables import JSON_TIMES


def read_event_stream(
    spark: SparkSession,
    source: str,
    fmt: str = "text",
    schema: str = schemas.EVENT_ENVELOPE,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """JSON events from the start of a folder of line files or of a Kafka topic.

    For ``kafka`` the servers and further settings come in ``options``.  Progress is kept by
    the checkpoint of the query that reads this stream.
    """
    if fmt == "kafka":
        raw = (
            spark.readStream.format("kafka")
            .option("subscribe", source)
            .option("startingOffsets", "earliest")
            .options(**(options or {}))
            .load()
            .select(F.col("value").cast("string").alias("value"))
        )
    else:
        raw = spark.readStream.options(**(options or {})).text(source)
    parsed = raw.select(F.from_json("value", schema).alias("e"), "value")
    return parsed.where(F.col("e").isNotNull()).select("e.*")


def envelope(df: DataFrame, key: str = "aggregate_id") -> DataFrame:
    """``key``, ``value`` (JSON of all columns) and the properties type, id and timestamp."""

    def prop(name: str, col: str):
        return F.struct(F.lit(name).alias("key"), F.encode(F.col(col).cast("string"), "UTF-8").alias("value"))

    headers = F.array(prop("event_type", "event_type"), prop("aggregate_id", "aggregate_id"), prop("timestamp", "timestamp"))
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), JSON_TIMES).alias("value"), headers.alias("headers")
    )


def publish_events(
    df: DataFrame,
    target: str,
    checkpoint: str,
    fmt: str = "text",
    key: str = "aggregate_id",
    options: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Write the envelope of a stream to a topic (``kafka``) or a folder of JSON lines."""
    out = envelope(df, key)
    if fmt == "kafka":
        writer = out.writeStream.format("kafka").option("topic", target).options(**(options or {}))
    else:
        writer = out.select("value").writeStream.format("text").option("path", target)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(
    outputs: Mapping[str, DataFrame], root: str, checkpoint: str, fmt: str = "parquet", mode: str = "append"
) -> dict[str, StreamingQuery]:
    """One query per named output, each with its own folder and checkpoint."""
    return {
        name: out.writeStream.format(fmt)
        .outputMode(mode)
        .option("path", f"{root}/{name}")
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .trigger(availableNow=True)
        .queryName(name)
        .start()
        for name, out in outputs.items()
    }
