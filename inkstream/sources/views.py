"""Adapter views: the document-processing shapes derived from the supplied tables.

Every view is a lazy projection (plus, for ``invoices``, one pre-aggregated join), so
filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.sources.tables import read_table

#: All test tables end before this instant.
AS_OF = "2024-01-31 00:00:00"

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _by_mod(col: Column, *values: str | None) -> Column:
    """``values[col % len(values)]`` as CASE."""
    bucket = col % len(values)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, value in enumerate(values):
        if value is not None:
            out = out.when(bucket == i, F.lit(value))
    return out


class Tables:
    """The tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, os.path.join(self.folder, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def _events_k(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        return self.events.withColumn("k", k)

    def doc_events(self) -> DataFrame:
        """The document-processing stream, one row per processed document."""
        e, k, uid = F.col("event_id"), F.col("k"), F.col("user_id")
        failed = F.col("event_type") == "error"
        conf = (k + 1).cast("double") / 100
        entities = F.array(
            *[
                F.struct(F.lit(name).alias("entity_type"), (conf * share).alias("entity_confidence"))
                for name, share in (("person", 0.9), ("organization", 0.8), ("amount", 0.7))
            ]
        )
        return self._events_k.select(
            e.alias("document_id"),
            F.col("ts").alias("event_time"),
            uid.alias("user_id"),
            _by_mod(e, "invoice", "receipt", "contract", "report", "other").alias("document_type"),
            (F.col("value") * 100).alias("processing_duration"),
            (~failed).alias("success"),
            F.when(failed, F.concat(F.lit("E"), (k % 3).cast("string"))).alias("error_code"),
            F.when(failed, F.concat(F.lit("failure "), (k % 3).cast("string"))).alias("error_message"),
            conf.alias("confidence"),
            (uid * 10000 + k * 100000).cast("bigint").alias("file_size"),
            _by_mod(e, "positive", "negative", "neutral", None).alias("sentiment"),
            ((e % 21).cast("double") / 10 - 1).alias("sentiment_score"),
            _by_mod(e, "en", "de", "fr", "es", "en", None).alias("detected_language"),
            (k % 4).alias("n_entities"),
            F.slice(entities, F.lit(1), k % 4).alias("entities"),
        )

    def doc_entities(self) -> DataFrame:
        ent = F.inline("entities")
        return self.doc_events().select("document_id", "event_time", "document_type", ent)

    def files(self) -> DataFrame:
        """Uploaded files with the gaps and odd values a landing table has."""
        e, k = F.col("event_id"), F.col("k")
        ext = _by_mod(e, ".pdf", ".png", ".docx", ".txt")
        name = F.concat(F.lit(" doc-"), e.cast("string"), F.lit(".v"), (k % 3).cast("string"), ext, F.lit(" "))
        size = F.when(k == 7, F.lit(None)).when(k % 3 == 0, k * 10000).otherwise(k * 1200000)
        return self._events_k.select(
            e.alias("document_id"),
            F.when(k != 13, F.col("user_id")).alias("user_id"),
            F.when(e % 17 != 0, name).alias("file_name"),
            size.cast("bigint").alias("file_size"),
            _by_mod(
                e, "application/pdf", "image/jpeg", "image/png", "text/plain",
                "application/msword", "application/zip",
            ).alias("content_type"),
            _by_mod(e, "uploaded", "processing", "completed", "failed", "completed").alias("status"),
            F.col("ts").alias("created_at"),
            (F.col("value") / 10).alias("processing_time"),
        )

    def metrics(self) -> DataFrame:
        """``analytics_metrics(metric_name, metric_value, metric_timestamp)``."""
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("metric_name"),
            F.col("value").alias("metric_value"),
            F.col("ts").alias("metric_timestamp"),
        )

    def requests(self) -> DataFrame:
        """A request log: latency in seconds, status 500 on errors."""
        return self.events.select(
            F.col("event_id").alias("request_id"),
            F.when(F.col("event_type").isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
            F.concat(F.lit("/"), F.col("event_type")).alias("path"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
            (F.col("value") / 1000).alias("latency"),
            F.col("ts").alias("at"),
        )

    def invoices(self) -> DataFrame:
        """One invoice per order; line items arrive as a pre-aggregated summary."""
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        lines = (
            self.lineitem.groupBy(F.col("l_orderkey").alias("document_id"))
            .agg(
                F.count(F.lit(1)).alias("line_count"),
                F.sum(net).alias("subtotal"),
                F.sum(net * F.col("l_tax")).alias("tax_amount"),
            )
        )
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        head = self.orders.join(
            self.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left"
        ).select(
            key.alias("document_id"),
            F.concat(F.lit("INV-"), key.cast("string")).alias("invoice_number"),
            F.when(key % 7 != 0, F.concat(F.lit("Vendor "), (cust % 50).cast("string"))).alias("vendor_name"),
            F.col("c_name").alias("customer_name"),
            F.col("o_orderdate").alias("invoice_date"),
            F.when(key % 11 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("due_date"),
            F.col("o_totalprice").alias("total_amount"),
            (F.lit(0.70) + (key % 31).cast("double") / 100).alias("confidence"),
            (key % 10 != 3).alias("is_valid"),
            F.col("o_orderdate").alias("created_at"),
            F.concat(F.lit("model-"), (key % 3).cast("string")).alias("model_name"),
        )
        return head.join(lines, "document_id", "left").withColumn(
            "line_count", F.coalesce("line_count", F.lit(0).cast("bigint"))
        )

    def lineage_edges(self) -> DataFrame:
        """A tree over parts plus shortcuts, so several paths exist."""
        key = F.col("p_partkey")
        tree = self.part.where(key >= 1).select(
            F.floor(key / 2).cast("bigint").alias("src"), key.alias("dst")
        )
        shortcut = self.part.where((key >= 50) & (key % 50 == 0)).select((key - 10).alias("src"), key.alias("dst"))
        return tree.unionByName(shortcut)

    def assets(self) -> DataFrame:
        """Catalog assets, one per part."""
        key = F.col("p_partkey")
        return self.part.select(
            key.alias("asset_id"),
            F.col("p_name").alias("name"),
            _by_mod(key, "table", "view", "column").alias("asset_type"),
            F.concat(F.lit("made by "), F.col("p_brand")).alias("description"),
            F.array(F.lower("p_type"), F.concat(F.lit("size-"), F.col("p_size").cast("string"))).alias("tags"),
            F.concat(F.lit("team-"), (key % 5).cast("string")).alias("owner"),
            ((key % 101).cast("double") / 100).alias("quality_score"),
            (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), key.cast("int"))).alias("updated_at"),
        )

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        created = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((key % 60).cast("int"))
        return self.customer.select(
            key.alias("id"),
            F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@example.com")).alias("email"),
            F.col("c_name").alias("name"),
            created.alias("created_at"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation"),
        )

    def user_documents(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderstatus").alias("status"),
        )

    def domain_events(self) -> DataFrame:
        """Life-cycle events of 500 aggregates with a JSON payload, not yet versioned."""
        e, k = F.col("event_id"), F.col("k")
        kind = _by_mod(
            k, "DocumentUploaded", "DocumentProcessingStarted",
            "DocumentProcessingCompleted", "DocumentProcessingFailed", "DocumentClassified",
        )
        result = F.struct(
            F.when(k % 10 != 2, _by_mod(e, "invoice", "receipt", "contract")).alias("document_type"),
            F.when(k % 10 != 7, F.col("value")).alias("processing_duration"),
            ((k + 1) / 100).alias("confidence"),
            F.struct(
                F.when(e % 3 == 0, F.create_map(F.lit("person"), k % 4, F.lit("amount"), k % 5)).alias("entities")
            ).alias("entities"),
            F.struct(_by_mod(e, "positive", "negative", None).alias("sentiment")).alias("sentiment"),
            F.when(e % 4 != 0, _by_mod(e, "en", "de")).alias("language"),
        )
        payload = (
            F.when(k % 5 == 0, F.to_json(F.struct(
                F.concat(F.lit("doc-"), e.cast("string"), F.lit(".pdf")).alias("file_name"),
                (k * 1000).alias("file_size"))))
            .when(k % 5 == 1, F.to_json(F.struct(
                F.concat(F.lit("pipe-"), (k % 3).cast("string")).alias("processing_pipeline"))))
            .when(k % 5 == 2, F.to_json(F.struct(
                result.alias("processing_result"), F.col("value").alias("processing_duration"))))
            .when(k % 5 == 3, F.to_json(F.struct(
                F.concat(F.lit("failure "), (k % 3).cast("string")).alias("error_message"),
                F.concat(F.lit("E"), (k % 3).cast("string")).alias("error_code"),
                (k % 6).alias("retry_count"))))
            .otherwise(F.to_json(F.struct(_by_mod(e, "invoice", "receipt").alias("document_type"))))
        )
        return self._events_k.select(
            e.alias("event_id"),
            kind.alias("event_type"),
            F.concat(F.lit("doc-"), (e % 500).cast("string")).alias("aggregate_id"),
            F.lit("document").alias("aggregate_type"),
            payload.alias("event_data"),
            F.col("ts").alias("timestamp"),
        )


class StreamTables(Tables):
    """The same views over streaming reads; times are zoned, as watermarks need them."""

    def table(self, name: str) -> DataFrame:
        static = super().table(name)
        stream = (
            self.spark.readStream.schema(static.schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.folder)
        )
        zoned = {c: F.col(c).cast("timestamp") for c, t in static.dtypes if t == "timestamp_ntz"}
        return stream.withColumns(zoned) if zoned else stream
