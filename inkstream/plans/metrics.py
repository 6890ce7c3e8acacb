"""Grouped metrics, dashboards and reports over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.operators import metrics as G
from inkstream.operators import scoring as A
from inkstream.plans.oracle_views import VIEWS
from inkstream.plans.registry import query
from inkstream.plans.relational import ENRICHED, enriched_files
from inkstream.sources.views import AS_OF, Tables

NOW = f"TIMESTAMP '{AS_OF}'"
EV = ("doc_events",)

# Scores of every invoice, shared by several reports.  Invoice dates end in 1999.
SCORES_AS_OF = "1999-01-01 00:00:00"

VIEWS["scored"] = (
    ("invoices",),
    """
SELECT document_id, vendor_name, model_name, created_at, confidence_score, completeness_score, is_valid AS validation_pass,
  confidence_score * completeness_score * CASE WHEN is_valid THEN 1 ELSE 0.5 END AS automation_score
FROM (SELECT *,
  (confidence + (CAST(coalesce(vendor_name, '') <> '' AS INT) + CAST(coalesce(invoice_number, '') <> '' AS INT)
    + CAST(coalesce(total_amount, 0) <> 0 AS INT) + CAST(invoice_date IS NOT NULL AS INT)
    + CAST(line_count > 0 AS INT)) / CAST(5 AS DOUBLE)) / 2 AS confidence_score,
  (CAST(trim(coalesce(vendor_name, '')) <> '' AS INT) + CAST(trim(coalesce(invoice_number, '')) <> '' AS INT)
    + CAST(coalesce(total_amount, 0) <> 0 AS INT) + CAST(invoice_date IS NOT NULL AS INT)
    + CAST(line_count > 0 AS INT)) / CAST(5 AS DOUBLE) * CAST(0.7 AS DOUBLE)
  + (CAST(trim(coalesce(customer_name, '')) <> '' AS INT) + CAST(due_date IS NOT NULL AS INT)
    + CAST(coalesce(tax_amount, 0) <> 0 AS INT) + CAST(coalesce(subtotal, 0) <> 0 AS INT)) / CAST(6 AS DOUBLE)
    * CAST(0.3 AS DOUBLE) AS completeness_score FROM invoices)""",
)
VIEWS["scores"] = (
    ("scored",),
    """SELECT *, automation_score < 0.85 OR confidence_score < 0.9 OR completeness_score < 0.95 OR NOT validation_pass
  AS requires_review FROM scored""",
)


def scores(t: Tables) -> DataFrame:
    cols = [
        "document_id", "vendor_name", "model_name", "created_at", "confidence_score", "completeness_score",
        "validation_pass", "automation_score", "requires_review",
    ]
    return A.automation_score(t.invoices()).select(*cols)


@query(
    "aggregate",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, avg(l_extendedprice) AS price,
  min(l_discount) AS low, max(l_tax) AS high, stddev_samp(l_quantity) AS spread FROM lineitem GROUP BY 1, 2""",
    floats=("qty", "price:4", "low", "high", "spread"),
)
def _(t: Tables):
    aggs = {
        "n": "COUNT(*)", "qty": "SUM(l_quantity)", "price": "AVG(l_extendedprice)",
        "low": "MIN(l_discount)", "high": "MAX(l_tax)", "spread": "STDEV(l_quantity)",
    }
    return G.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], aggs)


@query(
    "aggregate_whole_table",
    "SELECT count(*) AS n, max(l_quantity) AS top FROM lineitem",
    floats=("top",),
)
def _(t: Tables):
    return G.aggregate(t.lineitem, [], {"n": "COUNT(*)", "top": "MAX(l_quantity)"})


@query(
    "document_aggregates",
    f"""SELECT user_id, file_category, size_category, count(*) AS total_documents, CAST(sum(file_size) AS BIGINT) AS total_size,
  avg(file_size) AS avg_size, max(created_at) AS latest_upload FROM ({ENRICHED}) GROUP BY 1, 2, 3""",
    ("files",),
    floats=("avg_size:4",),
)
def _(t: Tables):
    return G.document_aggregates(enriched_files(t))


@query(
    "metric_aggregates",
    """SELECT metric_name, CAST(metric_timestamp AS DATE) AS metric_date, avg(metric_value) AS avg_value,
  min(metric_value) AS min_value, max(metric_value) AS max_value, count(*) AS count, stddev_samp(metric_value) AS std_value
FROM metrics GROUP BY 1, 2""",
    ("metrics",),
    floats=("avg_value", "min_value", "max_value", "std_value"),
)
def _(t: Tables):
    return G.metric_aggregates(t.metrics())


@query(
    "analytics_rollup",
    """WITH c AS (SELECT document_type, sentiment, detected_language, count(*) AS n, avg(processing_duration) AS d, avg(confidence) AS c
  FROM doc_events GROUP BY 1, 2, 3)
---
SELECT CASE grouping_id(document_type, sentiment, detected_language) WHEN 0 THEN 'cell' WHEN 3 THEN 'document_type'
    WHEN 5 THEN 'sentiment' WHEN 6 THEN 'detected_language' ELSE 'total' END AS level,
  document_type, sentiment, detected_language, CAST(sum(n) AS BIGINT) AS document_count,
  sum(d * n) / sum(n) AS avg_processing_duration, sum(c * n) / sum(n) AS avg_confidence
FROM c GROUP BY GROUPING SETS ((document_type, sentiment, detected_language), (document_type), (sentiment), (detected_language), ())""",
    EV,
    floats=("avg_processing_duration", "avg_confidence"),
)
def _(t: Tables):
    return G.analytics_rollup(t.doc_events())


@query(
    "realtime_summary",
    f"""SELECT count(*) AS total_documents, count(*) / CAST(10080 AS DOUBLE) AS processing_rate,
  coalesce(count(*) FILTER (success) * 100.0 / nullif(count(*), 0), 0) AS success_rate,
  coalesce(avg(processing_duration), 0) AS avg_processing_time FROM doc_events WHERE event_time >= {NOW} - INTERVAL 7 DAY""",
    EV,
    floats=("processing_rate", "success_rate", "avg_processing_time"),
)
def _(t: Tables):
    return G.realtime_summary(t.doc_events(), "7d", AS_OF)


_TYPES = "SELECT document_type, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS percentage FROM doc_events GROUP BY 1"


@query("type_distribution", _TYPES, EV, floats=("percentage",))
def _(t: Tables):
    return G.type_distribution(t.doc_events())


@query(
    "type_distribution_top",
    """SELECT p_brand, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS percentage FROM part GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
    floats=("percentage",),
)
def _(t: Tables):
    return G.type_distribution(t.part, "p_brand", top=10)


@query(
    "performance_percentiles",
    f"""SELECT avg(processing_duration) AS avg_processing_time, avg(confidence) AS avg_confidence,
  count(*) / CAST(168 AS DOUBLE) AS throughput_per_hour, count(*) FILTER (NOT success) * 100.0 / count(*) AS error_rate,
  quantile_cont(processing_duration, 0.95) AS p95_processing_time, quantile_cont(processing_duration, 0.99) AS p99_processing_time
FROM doc_events WHERE event_time >= {NOW} - INTERVAL 7 DAY""",
    EV,
    floats=(
        "avg_processing_time", "avg_confidence", "throughput_per_hour", "error_rate",
        "p95_processing_time:6", "p99_processing_time:6",
    ),
)
def _(t: Tables):
    return G.performance_percentiles(t.doc_events(), "7d", AS_OF)


@query(
    "index_percentiles",
    """WITH r AS (SELECT document_type, processing_duration AS x, row_number() OVER (PARTITION BY document_type
  ORDER BY processing_duration) - 1 AS i, count(*) OVER (PARTITION BY document_type) AS n FROM doc_events
  WHERE processing_duration IS NOT NULL)
---
SELECT document_type, max(x) FILTER (i = least(floor(n * CAST(0.5 AS DOUBLE)), n - 1)) AS p50,
  max(x) FILTER (i = least(floor(n * CAST(0.95 AS DOUBLE)), n - 1)) AS p95,
  max(x) FILTER (i = least(floor(n * CAST(0.99 AS DOUBLE)), n - 1)) AS p99 FROM r GROUP BY 1""",
    EV,
    floats=("p50", "p95", "p99"),
)
def _(t: Tables):
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return G.index_percentiles(t.doc_events(), "processing_duration", probs, ["document_type"])


@query(
    "type_performance",
    f"""SELECT document_type, count(*) AS count, count(*) FILTER (success) AS success_count,
  coalesce(sum(processing_duration), 0) AS total_processing_time, count(*) FILTER (success) * 100.0 / count(*) AS success_rate,
  coalesce(sum(processing_duration), 0) / count(*) AS avg_processing_time, coalesce(sum(confidence), 0) / count(*) AS avg_confidence
FROM doc_events WHERE event_time >= {NOW} - INTERVAL 1 HOUR GROUP BY 1""",
    EV,
    floats=("total_processing_time", "success_rate", "avg_processing_time", "avg_confidence"),
)
def _(t: Tables):
    return G.type_performance(t.doc_events(), AS_OF)


@query(
    "bi_insights",
    """WITH s AS (SELECT avg(processing_duration) / 1000 AS s, avg(confidence) AS c, (SELECT document_type FROM doc_events GROUP BY 1
  ORDER BY count(*) DESC, 1 LIMIT 1) AS top FROM doc_events)
---
SELECT 'insight' AS kind, 'document_type_trend' AS name, 'Most Processed Document Type' AS title, top AS value,
  concat('Most documents processed are of type: ', top) AS description, CAST(NULL AS VARCHAR) AS priority FROM s
UNION ALL SELECT 'insight', 'processing_efficiency', 'Average Processing Time', printf('%.2f seconds', s),
  printf('Documents are processed in %.2f seconds on average', s), NULL FROM s
UNION ALL SELECT 'insight', 'confidence_trend', 'Average Confidence Score', printf('%.3f', c),
  printf('AI models achieve %.3f confidence on average', c), NULL FROM s
UNION ALL SELECT 'recommendation', 'performance', 'Optimize Processing Pipeline', NULL,
  'Consider optimizing the processing pipeline as average processing time is high', 'medium' FROM s WHERE s > 30
UNION ALL SELECT 'recommendation', 'accuracy', 'Improve AI Model Accuracy', NULL,
  'Consider retraining AI models as confidence scores are below optimal levels', 'high' FROM s WHERE c < 0.8""",
    EV,
)
def _(t: Tables):
    return G.bi_insights(t.doc_events().withColumn("processing_duration", F.col("processing_duration") / 1000))


_AUTOMATION = """count(*) FILTER (NOT requires_review) * 100.0 / count(*) AS automation_rate, count(*) AS total_processed,
  count(*) FILTER (NOT requires_review) AS fully_automated, count(*) FILTER (requires_review) AS requires_review,
  count(*) FILTER (automation_score < 0.7) AS manual_intervention, avg(confidence_score) AS average_confidence,
  avg(completeness_score) AS average_completeness, count(*) FILTER (validation_pass) * 100.0 / count(*) AS validation_pass_rate"""
_RATES = ("automation_rate", "average_confidence", "average_completeness", "validation_pass_rate")


@query("automation_metrics", f"SELECT {_AUTOMATION} FROM scores", ("scores",), floats=_RATES)
def _(t: Tables):
    return G.automation_metrics(scores(t))


@query(
    "automation_metrics_range",
    f"SELECT {_AUTOMATION} FROM scores WHERE created_at >= TIMESTAMP '{SCORES_AS_OF}' - INTERVAL 30 DAY",
    ("scores",),
    floats=_RATES,
)
def _(t: Tables):
    return G.automation_metrics(scores(t), "30d", SCORES_AS_OF)


VIEWS["vendor_metrics"] = (("scores",), f"SELECT vendor_name, {_AUTOMATION} FROM scores GROUP BY 1")


def vendor_metrics(t: Tables) -> DataFrame:
    return G.automation_metrics(scores(t), group_by=["vendor_name"])


@query("automation_metrics_by_vendor", "SELECT * FROM vendor_metrics", ("vendor_metrics",), floats=_RATES)
def _(t: Tables):
    return vendor_metrics(t)


_TREND = f"""WITH trend AS (SELECT CAST(created_at AS DATE) AS date, count(*) FILTER (NOT requires_review) * CAST(100 AS DOUBLE) / count(*)
    AS automation_rate, count(*) AS total_processed, count(*) FILTER (NOT requires_review) AS automated_count,
  avg(automation_score) AS average_score, avg(confidence_score) AS average_confidence,
  avg(completeness_score) AS average_completeness
  FROM scores WHERE created_at >= TIMESTAMP '{SCORES_AS_OF}' - INTERVAL 365 DAY GROUP BY 1)
---
"""


@query(
    "automation_trend",
    _TREND + "SELECT * FROM trend",
    ("scores",),
    floats=("automation_rate", "average_score", "average_confidence", "average_completeness"),
)
def _(t: Tables):
    return G.automation_trend(scores(t), "year", SCORES_AS_OF, rounded=False)


@query(
    "automation_trend_summary",
    _TREND
    + """SELECT improvement, CASE WHEN improvement > 1 THEN 'improving' WHEN improvement < -1 THEN 'declining' ELSE 'stable' END
  AS direction FROM (SELECT round(round(arg_max(automation_rate, date), 2) - round(arg_min(automation_rate, date), 2), 2) AS improvement FROM trend)""",
    ("scores",),
    floats=("improvement:4",),
)
def _(t: Tables):
    return G.automation_trend_summary(G.automation_trend(scores(t), "year", SCORES_AS_OF))


@query(
    "cost_savings",
    """WITH c AS (SELECT vendor_name, total_processed AS n, automation_rate, CAST(floor(total_processed * (automation_rate / 100)) AS BIGINT) AS a
  FROM vendor_metrics),
v AS (SELECT n AS documents_processed, automation_rate, a AS manual_processing_avoided, a * CAST(0.5 AS DOUBLE) AS automated_cost,
  (n - a) * CAST(5 AS DOUBLE) AS manual_cost, a * CAST(0.5 AS DOUBLE) + (n - a) * CAST(5 AS DOUBLE) AS total_cost FROM c)
---
SELECT *, round(documents_processed * 5 - total_cost, 2) AS total_savings, round((documents_processed * 5 - total_cost) * 12, 2)
  AS annual_projection, round(total_cost / documents_processed, 2) AS cost_per_document FROM v""",
    ("vendor_metrics",),
    floats=(
        "automation_rate", "automated_cost", "manual_cost", "total_cost", "total_savings:4",
        "annual_projection:4", "cost_per_document:4",
    ),
)
def _(t: Tables):
    return G.cost_savings(vendor_metrics(t))


@query(
    "gateway_summary",
    f"""SELECT d.*, i.* FROM (SELECT count(*) AS total_documents, count(*) FILTER (status = 'processed') AS processed_count,
  count(*) FILTER (status = 'processing') AS processing_count, count(*) FILTER (CAST(created_at AS DATE) = DATE '2024-01-30') AS uploaded_today,
  avg(confidence_score) AS avg_confidence FROM (SELECT f.created_at, e.confidence AS confidence_score,
    CASE status WHEN 'completed' THEN 'processed' ELSE status END AS status FROM files f JOIN doc_events e ON e.document_id = f.document_id)) d,
  (SELECT sum(total_amount) AS total_invoice_amount, avg(total_amount) AS avg_invoice_amount, count(*) AS invoice_count FROM invoices) i""",
    ("files", "doc_events", "invoices"),
    floats=("avg_confidence", "total_invoice_amount:2", "avg_invoice_amount:4"),
)
def _(t: Tables):
    status = F.when(F.col("status") == "completed", "processed").otherwise(F.col("status"))
    conf = t.doc_events().select("document_id", F.col("confidence").alias("confidence_score"))
    docs = t.files().select("document_id", "created_at", status.alias("status")).join(conf, "document_id")
    return G.gateway_summary(docs, t.invoices(), "2024-01-30 12:00:00")


@query(
    "dashboard_stats",
    f"""SELECT user_id, count(*) FILTER (created_at > {NOW} - INTERVAL 24 HOUR) AS documents_today,
  count(*) FILTER (status = 'processing') AS processing_count, count(*) FILTER (status = 'completed') AS completed_count,
  count(*) FILTER (status = 'failed') AS failed_count, avg(processing_time) AS avg_processing_time FROM files GROUP BY 1""",
    ("files",),
    floats=("avg_processing_time",),
)
def _(t: Tables):
    return G.dashboard_stats(t.files(), as_of=AS_OF)


VIEWS["runs"] = (
    ("files",),
    """SELECT document_id AS execution_id, CASE status WHEN 'processing' THEN 'running' ELSE status END AS status,
  created_at AS start_time, CASE WHEN status <> 'processing' THEN created_at + to_seconds(CAST(document_id % 3600 AS DOUBLE)) END AS end_time
FROM files""",
)


def runs(t: Tables) -> DataFrame:
    key = F.col("document_id")
    end = F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), key % 3600)
    return t.files().select(
        key.alias("execution_id"),
        F.when(F.col("status") == "processing", "running").otherwise(F.col("status")).alias("status"),
        F.col("created_at").alias("start_time"),
        F.when(F.col("status") != "processing", end).alias("end_time"),
    )


@query(
    "execution_dashboard",
    f"""SELECT count(*) AS total_executions, count(*) FILTER (status = 'running') AS running_executions,
  count(*) FILTER (status = 'completed') AS completed_executions, count(*) FILTER (status = 'failed') AS failed_executions,
  round(count(*) FILTER (status = 'completed') * CAST(100 AS DOUBLE) / count(*), 2) AS success_rate,
  round(avg(CASE WHEN status = 'completed' THEN epoch_us(end_time) - epoch_us(start_time) END) / 1000000, 2) AS avg_processing_time_seconds,
  count(*) FILTER (start_time >= {NOW} - INTERVAL 24 HOUR) AS last_24h_executions, max(start_time) AS last_execution FROM runs""",
    ("runs",),
    floats=("success_rate:4", "avg_processing_time_seconds:4"),
)
def _(t: Tables):
    return G.execution_dashboard(runs(t), AS_OF)


@query(
    "execution_health",
    f"""WITH h AS (SELECT count(*) FILTER (status = 'running' AND start_time < {NOW} - INTERVAL 1 HOUR) AS n,
  coalesce(count(*) FILTER (status = 'failed' AND start_time >= {NOW} - INTERVAL 1 HOUR) * CAST(100 AS DOUBLE)
    / nullif(count(*) FILTER (start_time >= {NOW} - INTERVAL 1 HOUR), 0), 0) AS rate FROM runs)
---
SELECT CASE WHEN rate > 50 THEN 'critical' WHEN n > 0 THEN 'warning' ELSE 'healthy' END AS status, n AS stuck_executions,
  round(rate, 2) AS recent_failure_rate, concat_ws('; ', CASE WHEN n > 0 THEN concat('Investigate ', CAST(n AS VARCHAR), ' stuck executions') END,
  CASE WHEN rate > 50 THEN 'High failure rate detected - check pipeline configurations'
    WHEN rate > 20 THEN 'Moderate failure rate - monitor pipeline executions' END,
  CASE WHEN n = 0 AND rate <= 20 THEN 'System is healthy - no issues detected' END) AS recommendations FROM h""",
    ("runs",),
    floats=("recent_failure_rate:4",),
)
def _(t: Tables):
    out = G.execution_health(runs(t), AS_OF)
    return out.withColumn("recommendations", F.array_join("recommendations", "; "))


@query(
    "stuck_executions",
    f"SELECT execution_id, start_time FROM runs WHERE status = 'running' AND start_time < {NOW} - INTERVAL 1 HOUR",
    ("runs",),
)
def _(t: Tables):
    return G.stuck_executions(runs(t), AS_OF)


@query(
    "request_metrics",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM requests)
---
SELECT count(*) AS total_requests, count(*) FILTER (status >= 400) AS total_errors,
  round(count(*) FILTER (status >= 400) / CAST(count(*) AS DOUBLE), 4) AS error_rate, round(count(*) / CAST(2592000 AS DOUBLE), 2) AS requests_per_second,
  round(sum(latency) / count(*) * 1000, 2) AS avg_ms,
  round(max(latency) FILTER (i = least(floor(n * CAST(0.5 AS DOUBLE)), n - 1)) * 1000, 2) AS p50_ms,
  round(max(latency) FILTER (i = least(floor(n * CAST(0.95 AS DOUBLE)), n - 1)) * 1000, 2) AS p95_ms,
  round(max(latency) FILTER (i = least(floor(n * CAST(0.99 AS DOUBLE)), n - 1)) * 1000, 2) AS p99_ms FROM r""",
    ("requests",),
    floats=("error_rate:6", "requests_per_second:4", "avg_ms:4", "p50_ms:4", "p95_ms:4", "p99_ms:4"),
)
def _(t: Tables):
    return G.request_metrics(t.requests(), 2592000)


@query(
    "top_endpoints",
    """SELECT concat(method, ':', path) AS endpoint, count(*) AS count, round(sum(latency) / count(*) * 1000, 2) AS avg_latency_ms,
  round(count(*) FILTER (status >= 400) / CAST(count(*) AS DOUBLE), 4) AS error_rate FROM requests GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    ("requests",),
    floats=("avg_latency_ms:4", "error_rate:6"),
)
def _(t: Tables):
    return G.top_endpoints(t.requests())


@query(
    "api_cost",
    """WITH c AS (SELECT CASE event_type WHEN 'view' THEN 'openai' WHEN 'click' THEN 'form_recognizer' ELSE 'cognitive_search' END AS service FROM events),
p AS (SELECT service, count(*) AS calls, count(*) * CASE service WHEN 'openai' THEN CAST(0.002 AS DOUBLE) WHEN 'form_recognizer' THEN 0.01 ELSE 0.001 END
  AS cost FROM c GROUP BY 1)
---
SELECT service, CAST(sum(calls) AS BIGINT) AS calls, round(sum(cost), 2) AS estimated_cost FROM p GROUP BY ROLLUP (service)""",
    floats=("estimated_cost:4",),
)
def _(t: Tables):
    service = (
        F.when(F.col("event_type") == "view", "openai")
        .when(F.col("event_type") == "click", "form_recognizer")
        .otherwise("cognitive_search")
    )
    return G.api_cost(t.events.select(service.alias("service")))


@query(
    "catalog_overview",
    """SELECT level, value, count, CASE WHEN level = 'total' THEN (SELECT count(*) FROM lineage_edges) END AS relationships,
  CASE WHEN level = 'total' THEN round(q, 3) END AS avg_quality_score FROM (
  SELECT 'asset_type' AS level, asset_type AS value, count(*) AS count, avg(quality_score) AS q FROM assets GROUP BY 2
  UNION ALL SELECT 'owner', owner, count(*), avg(quality_score) FROM assets GROUP BY 2
  UNION ALL SELECT 'total', NULL, count(*), avg(quality_score) FROM assets)""",
    ("assets", "lineage_edges"),
    floats=("avg_quality_score:5",),
)
def _(t: Tables):
    return G.catalog_overview(t.assets(), t.lineage_edges())


@query(
    "recent_assets",
    "SELECT asset_id, name, asset_type, updated_at FROM assets ORDER BY updated_at DESC, asset_id LIMIT 5",
    ("assets",),
)
def _(t: Tables):
    return G.recent_assets(t.assets())


@query(
    "workflow_statistics",
    """SELECT count(*) AS total_workflows, count(*) FILTER (status = 'completed') AS completed_workflows,
  count(*) FILTER (status = 'failed') AS failed_workflows, count(*) FILTER (status = 'completed') / CAST(count(*) AS DOUBLE) AS success_rate,
  avg(CASE WHEN status = 'completed' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END) AS average_accuracy
FROM files f JOIN events e ON e.event_id = f.document_id""",
    ("files",),
    floats=("success_rate", "average_accuracy"),
)
def _(t: Tables):
    metrics = t.events.select(
        F.col("event_id").alias("document_id"),
        F.to_json(F.struct((F.get_json_object("props", "$.k").cast("double") / 100).alias("current_accuracy"))).alias("metrics"),
    )
    return G.workflow_statistics(t.files().select("document_id", "status").join(metrics, "document_id"))


VIEWS["model_metrics"] = (
    ("doc_events",),
    """SELECT concat('model-', CAST(document_id % 3 AS VARCHAR)) AS model_name, event_time AS timestamp, confidence * 100 AS automation_rate,
  confidence AS accuracy, confidence, CAST(n_entities AS DOUBLE) / 4 AS completeness, processing_duration / 1000 AS processing_speed,
  CAST(n_entities AS BIGINT) AS documents_processed FROM doc_events""",
)


def model_metrics(t: Tables) -> DataFrame:
    return t.doc_events().select(
        F.concat(F.lit("model-"), (F.col("document_id") % 3).cast("string")).alias("model_name"),
        F.col("event_time").alias("timestamp"),
        (F.col("confidence") * 100).alias("automation_rate"),
        F.col("confidence").alias("accuracy"),
        "confidence",
        (F.col("n_entities") / 4).alias("completeness"),
        (F.col("processing_duration") / 1000).alias("processing_speed"),
        F.col("n_entities").cast("bigint").alias("documents_processed"),
    )


_MODEL_TRENDS = f"""WITH trends AS (SELECT CAST(timestamp AS DATE) AS date, model_name, avg(automation_rate) AS avg_automation_rate, avg(accuracy) AS avg_accuracy,
  avg(confidence) AS avg_confidence, avg(completeness) AS avg_completeness, avg(processing_speed) AS avg_processing_speed,
  CAST(sum(documents_processed) AS BIGINT) AS total_documents FROM model_metrics WHERE timestamp >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2)
---
"""


@query(
    "model_trends",
    _MODEL_TRENDS + "SELECT * FROM trends",
    ("model_metrics",),
    floats=("avg_automation_rate", "avg_accuracy", "avg_confidence", "avg_completeness", "avg_processing_speed"),
)
def _(t: Tables):
    return G.model_trends(model_metrics(t), "30d", AS_OF)


@query(
    "model_dashboard",
    _MODEL_TRENDS
    + """SELECT c AS current_automation_rate, least(c / 90 * 100, 100) AS goal_progress, n AS total_documents_processed, m AS active_models FROM (
  SELECT round(avg(avg_automation_rate) FILTER (date = (SELECT max(date) FROM trends)), 2) AS c, CAST(sum(total_documents) AS BIGINT) AS n,
    count(DISTINCT model_name) AS m FROM trends)""",
    ("model_metrics",),
    floats=("current_automation_rate:4", "goal_progress:6"),
)
def _(t: Tables):
    return G.model_dashboard(G.model_trends(model_metrics(t), "30d", AS_OF))


@query(
    "training_cost",
    """WITH j AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-3.5-turbo' ELSE 'other' END AS m,
  o_orderstatus AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 10 END AS tokens, o_orderkey % 100 AS minutes FROM orders)
---
SELECT avg(CASE WHEN s = 'F' THEN minutes / CAST(60 AS DOUBLE) END) AS avg_training_hours, sum(CASE WHEN tokens <> 0 THEN tokens / CAST(1000 AS DOUBLE)
  * CASE m WHEN 'gpt-4o' THEN CAST(0.003 AS DOUBLE) WHEN 'gpt-4o-mini' THEN 0.0033 WHEN 'gpt-3.5-turbo' THEN 0.008 ELSE 0 END
  + 2 * CASE m WHEN 'gpt-4o' THEN CAST(3 AS DOUBLE) WHEN 'gpt-4o-mini' THEN 1.7 WHEN 'gpt-3.5-turbo' THEN 1 ELSE 0 END END) AS total_cost FROM j""",
    floats=("avg_training_hours", "total_cost:4"),
)
def _(t: Tables):
    key = F.col("o_orderkey")
    model = F.when(key % 4 == 0, "gpt-4o").when(key % 4 == 1, "gpt-4o-mini").when(key % 4 == 2, "gpt-3.5-turbo")
    jobs = t.orders.select(
        model.otherwise("other").alias("model_name"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running").alias("status"),
        F.when(key % 5 != 0, key * 10).alias("training_tokens"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (key % 100).cast("int"))).alias("finished_at"),
    )
    return G.training_cost(jobs)


@query(
    "entity_statistics",
    """SELECT entity_type, count(*) AS total_entities, avg(entity_confidence) AS average_confidence,
  count(*) FILTER (entity_confidence >= 0.9) AS high_confidence,
  count(*) FILTER (entity_confidence >= 0.7 AND entity_confidence < 0.9) AS medium_confidence,
  count(*) FILTER (entity_confidence < 0.7) AS low_confidence FROM doc_entities GROUP BY ROLLUP (entity_type)""",
    ("doc_entities",),
    floats=("average_confidence",),
)
def _(t: Tables):
    return G.entity_statistics(t.doc_entities())


@query(
    "conversation_summary",
    """SELECT conv_id, count(*) AS message_count, max(turn) AS last_message_at, substring(arg_min(text, turn), 1, 50) AS title
FROM conversations GROUP BY 1""",
)
def _(t: Tables):
    return G.conversation_summary(t.conversations, "conv_id", "turn", "text")
