"""Windowed metrics, moving rows and configurable transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstream.operators import windows as W
from inkstream.plans.registry import query
from inkstream.sources.views import AS_OF, Tables

EV = ("doc_events",)


def _end(width: str) -> str:
    return f"time_bucket(INTERVAL {width}, event_time) + INTERVAL {width}"


@query(
    "duration_category",
    """SELECT event_time AS processing_time, document_id, document_type, processing_duration,
  CASE WHEN processing_duration < 5000 THEN 'Fast' WHEN processing_duration < 15000 THEN 'Medium' ELSE 'Slow' END
    AS processing_category, success, error_message, user_id, file_size, confidence FROM doc_events""",
    EV,
    floats=("processing_duration", "confidence"),
)
def _(t: Tables):
    return W.duration_category(t.doc_events())


@query(
    "performance_metrics",
    f"""SELECT {_end('1 HOUR')} AS window_end, count(*) AS total_documents,
  avg(processing_duration) AS avg_processing_duration, max(processing_duration) AS max_processing_duration,
  min(processing_duration) AS min_processing_duration, count(*) FILTER (success) AS successful_documents,
  count(*) FILTER (NOT success) AS failed_documents, avg(confidence) AS avg_confidence,
  avg(file_size) AS avg_file_size, count(*) FILTER (success) * 100.0 / count(*) AS success_rate
FROM doc_events GROUP BY 1""",
    EV,
    floats=(
        "avg_processing_duration", "max_processing_duration", "min_processing_duration",
        "avg_confidence", "avg_file_size:4", "success_rate",
    ),
)
def _(t: Tables):
    return W.performance_metrics(t.doc_events(), "1 hour")


@query(
    "document_type_distribution",
    f"""SELECT {_end('1 HOUR')} AS window_end, document_type, count(*) AS document_count,
  avg(processing_duration) AS avg_processing_duration, avg(confidence) AS avg_confidence,
  count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count,
  count(*) FILTER (success) * 100.0 / count(*) AS success_rate
FROM doc_events GROUP BY 1, 2""",
    EV,
    floats=("avg_processing_duration", "avg_confidence", "success_rate"),
)
def _(t: Tables):
    return W.document_type_distribution(t.doc_events(), "1 hour")


@query(
    "sentiment_trends",
    f"""SELECT {_end('6 HOUR')} AS window_end, sentiment, document_type, count(*) AS document_count,
  avg(sentiment_score) AS avg_sentiment_score, avg(confidence) AS avg_confidence
FROM doc_events WHERE sentiment IS NOT NULL GROUP BY 1, 2, 3""",
    EV,
    floats=("avg_sentiment_score", "avg_confidence"),
)
def _(t: Tables):
    return W.sentiment_trends(t.doc_events(), "6 hours")


@query(
    "language_analytics",
    f"""SELECT {_end('6 HOUR')} AS window_end, detected_language, count(*) AS document_count,
  avg(processing_duration) AS avg_processing_duration, avg(confidence) AS avg_confidence,
  count(*) FILTER (success) AS success_count, count(*) FILTER (success) * 100.0 / count(*) AS success_rate
FROM doc_events WHERE detected_language IS NOT NULL GROUP BY 1, 2""",
    EV,
    floats=("avg_processing_duration", "avg_confidence", "success_rate"),
)
def _(t: Tables):
    return W.language_analytics(t.doc_events(), "6 hours")


@query(
    "error_analysis",
    f"""SELECT {_end('1 HOUR')} AS window_end, error_code, error_message, document_type, count(*) AS error_count,
  avg(processing_duration) AS avg_duration_before_error
FROM doc_events WHERE NOT success GROUP BY 1, 2, 3, 4""",
    EV,
    floats=("avg_duration_before_error",),
)
def _(t: Tables):
    return W.error_analysis(t.doc_events(), "1 hour")


@query(
    "user_activity",
    f"""SELECT {_end('1 DAY')} AS window_end, user_id, count(*) AS documents_processed,
  avg(processing_duration) AS avg_processing_duration, CAST(sum(file_size) AS BIGINT) AS total_file_size,
  count(DISTINCT document_type) AS unique_document_types, avg(confidence) AS avg_confidence
FROM doc_events WHERE user_id IS NOT NULL GROUP BY 1, 2""",
    EV,
    floats=("avg_processing_duration", "avg_confidence"),
)
def _(t: Tables):
    return W.user_activity(t.doc_events(), "1 day")


@query(
    "throughput_analysis",
    f"""SELECT {_end('1 HOUR')} AS window_end, count(*) AS documents,
  avg(processing_duration) AS avg_processing_duration, CAST(sum(file_size) AS BIGINT) AS total_data_processed,
  count(DISTINCT user_id) AS active_users, count(DISTINCT document_type) AS document_types_processed
FROM doc_events GROUP BY 1""",
    EV,
    floats=("avg_processing_duration",),
)
def _(t: Tables):
    return W.throughput_analysis(t.doc_events(), "1 hour")


@query(
    "quality_metrics_window",
    f"""SELECT {_end('6 HOUR')} AS window_end, document_type, avg(confidence) AS avg_confidence,
  count(*) FILTER (confidence >= 0.9) AS high_confidence_docs,
  count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium_confidence_docs,
  count(*) FILTER (confidence < 0.7) AS low_confidence_docs, count(*) AS total_docs,
  count(*) FILTER (confidence >= 0.9) * 100.0 / count(*) AS high_confidence_rate
FROM doc_events WHERE confidence IS NOT NULL GROUP BY 1, 2""",
    EV,
    floats=("avg_confidence", "high_confidence_rate"),
)
def _(t: Tables):
    return W.quality_metrics_window(t.doc_events(), "6 hours")


@query(
    "entity_analytics",
    f"""SELECT {_end('1 DAY')} AS window_end, document_type, entity_type, count(*) AS entity_count,
  avg(entity_confidence) AS avg_entity_confidence, count(DISTINCT document_id) AS documents_with_entity
FROM doc_entities GROUP BY 1, 2, 3""",
    ("doc_entities",),
    floats=("avg_entity_confidence",),
)
def _(t: Tables):
    return W.entity_analytics(t.doc_events(), "1 day")


_ALERTS = f"""
SELECT {_end('6 HOUR')} AS alert_time, 'HighFailureRate' AS alert_type, 'High failure rate detected' AS alert_message,
  document_type, count(*) FILTER (NOT success) AS event_count,
  CAST(count(*) FILTER (NOT success) * 100.0 / count(*) AS DOUBLE) AS metric_value
FROM doc_events GROUP BY 1, 4 HAVING count(*) FILTER (NOT success) * 100.0 / count(*) > 10
UNION ALL
SELECT {_end('6 HOUR')}, 'SlowProcessing', 'Processing duration exceeds threshold', document_type, count(*),
  avg(processing_duration)
FROM doc_events WHERE processing_duration > 30000 GROUP BY 1, 4 HAVING count(*) > 5
UNION ALL
SELECT {_end('6 HOUR')}, 'LowConfidence', 'Low confidence scores detected', document_type, count(*), avg(confidence)
FROM doc_events WHERE confidence < 0.5 GROUP BY 1, 4 HAVING count(*) > 3"""


@query("realtime_alerts", _ALERTS, EV, floats=("metric_value",))
def _(t: Tables):
    return W.realtime_alerts(t.doc_events(), "6 hours")


@query(
    "union_all",
    """SELECT document_type, document_id, 'failed' AS reason FROM doc_events WHERE NOT success
UNION ALL SELECT document_type, document_id, 'slow' FROM doc_events WHERE processing_duration > 30000
UNION ALL SELECT document_type, document_id, 'unsure' FROM doc_events WHERE confidence < 0.5""",
    EV,
)
def _(t: Tables):
    d = t.doc_events()
    tests = {"failed": "NOT success", "slow": "processing_duration > 30000", "unsure": "confidence < 0.5"}
    return W.union_all(
        [d.where(c).select("document_type", "document_id", F.lit(n).alias("reason")) for n, c in tests.items()]
    )


@query(
    "concat_parts",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
    floats=("balance",),
)
def _(t: Tables):
    a = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    b = t.supplier.selectExpr("s_suppkey AS id", "s_acctbal AS balance", "s_name AS name")
    return W.concat_parts([a, b])


@query(
    "throughput_last_hour",
    f"""SELECT count(*) AS documents_last_hour, count(*) FILTER (status IN ('failed', 'error')) AS failed_documents,
  coalesce(count(*) FILTER (status IN ('failed', 'error')) * 100.0 / nullif(count(*), 0), 0) AS error_rate
FROM files WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR""",
    ("files",),
    floats=("error_rate",),
)
def _(t: Tables):
    return W.throughput_last_hour(t.files(), AS_OF)


@query(
    "hourly_mean",
    """WITH m AS (SELECT date_trunc('hour', event_time) AS hour, avg(processing_duration) AS mean_value FROM doc_events GROUP BY 1)
---
SELECT s.hour, m.mean_value FROM (SELECT unnest(generate_series((SELECT min(hour) FROM m), (SELECT max(hour) FROM m),
  INTERVAL 1 HOUR)) AS hour) s LEFT JOIN m ON m.hour = s.hour""",
    EV,
    floats=("mean_value",),
)
def _(t: Tables):
    return W.hourly_mean(t.doc_events(), "processing_duration")


_DAILY = """WITH c AS (SELECT CAST(event_time AS DATE) AS day, count(*) AS n FROM doc_events GROUP BY 1),
days AS (SELECT CAST(d.day AS DATE) AS day, coalesce(n, 0) AS volume FROM (SELECT unnest(generate_series(
  (SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS day) d LEFT JOIN c ON c.day = d.day),
trend AS (SELECT day, volume, lag(volume) OVER (ORDER BY day) AS previous_volume FROM days),
trends AS (SELECT *, CASE WHEN volume > previous_volume THEN 'increasing' WHEN previous_volume IS NOT NULL
  THEN 'decreasing' END AS direction, abs(volume - previous_volume) * 100.0 / nullif(previous_volume, 0) AS change_percent
  FROM trend)
---
"""


@query("daily_volume_trend", _DAILY + "SELECT * FROM trends", EV, floats=("change_percent",))
def _(t: Tables):
    return W.daily_volume_trend(t.doc_events())


@query(
    "volume_change",
    _DAILY + "SELECT 'daily_processing_volume' AS metric, direction, change_percent FROM trends ORDER BY day DESC LIMIT 1",
    EV,
    floats=("change_percent",),
)
def _(t: Tables):
    return W.volume_change(t.doc_events())


@query(
    "moving_average",
    f"""WITH m AS (SELECT {_end('1 HOUR')} AS window_end, document_type, avg(processing_duration) AS current_avg
  FROM doc_events GROUP BY 1, 2)
---
SELECT *, avg(current_avg) OVER (PARTITION BY document_type ORDER BY window_end ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
  AS moving_avg_5, avg(current_avg) OVER (PARTITION BY document_type ORDER BY window_end
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS moving_avg_10 FROM m""",
    EV,
    floats=("current_avg", "moving_avg_5", "moving_avg_10"),
)
def _(t: Tables):
    return W.moving_average(t.doc_events(), "1 hour")


@query(
    "count_trend",
    f"""WITH m AS (SELECT {_end('6 HOUR')} AS window_end, document_type, count(*) AS document_count FROM doc_events GROUP BY 1, 2)
---
SELECT *, lag(document_count) OVER w AS previous_count, document_count - lag(document_count) OVER w AS trend
FROM m WINDOW w AS (PARTITION BY document_type ORDER BY window_end)""",
    EV,
)
def _(t: Tables):
    return W.count_trend(t.doc_events(), "6 hours")


@query(
    "peak_usage",
    f"""WITH m AS (SELECT {_end('1 HOUR')} AS window_end, count(*) AS documents_processed, count(DISTINCT user_id)
  AS active_users, avg(processing_duration) AS avg_processing_duration FROM doc_events GROUP BY 1)
---
SELECT *, CASE WHEN documents_processed > (SELECT avg(documents_processed) FROM m) * 1.5 THEN 'Peak' ELSE 'Normal' END
  AS usage_level FROM m""",
    EV,
    floats=("avg_processing_duration",),
)
def _(t: Tables):
    return W.peak_usage(t.doc_events(), "1 hour")


@query(
    "with_global_stat",
    """SELECT document_id, document_type, processing_duration, (SELECT avg(processing_duration) FROM doc_events)
  AS mean_duration, processing_duration > (SELECT avg(processing_duration) FROM doc_events) AS above_mean FROM doc_events""",
    EV,
    floats=("processing_duration", "mean_duration"),
)
def _(t: Tables):
    d = t.doc_events()
    out = W.with_global_stat(
        d.select("document_id", "document_type", "processing_duration"),
        d.agg(F.avg("processing_duration").alias("mean_duration")),
    )
    return out.withColumn("above_mean", F.col("processing_duration") > F.col("mean_duration"))


@query(
    "duration_anomalies",
    """WITH r AS (SELECT event_time, document_id, processing_duration, document_type, user_id,
  count(processing_duration) OVER w AS n, avg(processing_duration) OVER w AS m, stddev_samp(processing_duration) OVER w AS sd
  FROM doc_events WINDOW w AS (ORDER BY event_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))
---
SELECT event_time, document_id, processing_duration, document_type, user_id FROM r
WHERE processing_duration > 0 AND n > 1 AND processing_duration > m + 2 * sd""",
    EV,
    floats=("processing_duration",),
)
def _(t: Tables):
    return W.duration_anomalies(t.doc_events())


@query(
    "duration_anomalies_global",
    """SELECT event_time, document_id, processing_duration, document_type, user_id FROM doc_events
WHERE processing_duration > (SELECT avg(processing_duration) + 2 * stddev_samp(processing_duration) FROM doc_events)""",
    EV,
    floats=("processing_duration",),
)
def _(t: Tables):
    return W.duration_anomalies(t.doc_events(), scope="global")


@query(
    "normalize",
    """SELECT m.id, m.metric_name, CASE WHEN hi <> lo THEN (metric_value - lo) / (hi - lo) ELSE metric_value END
  AS metric_value FROM metrics m JOIN (SELECT metric_name, min(metric_value) AS lo, max(metric_value) AS hi
  FROM metrics GROUP BY 1) s ON s.metric_name = m.metric_name""",
    ("metrics",),
    floats=("metric_value",),
)
def _(t: Tables):
    rows = t.metrics().select("id", "metric_name", "metric_value")
    return W.normalize(rows, columns=["metric_value"], group_by=["metric_name"])


@query(
    "normalize_whole_table",
    """SELECT id, metric_name, -1 + 2 * (metric_value - (SELECT min(metric_value) FROM metrics)) /
  (SELECT max(metric_value) - min(metric_value) FROM metrics) AS metric_value FROM metrics""",
    ("metrics",),
    floats=("metric_value",),
)
def _(t: Tables):
    rows = t.metrics().select("id", "metric_name", "metric_value")
    return W.normalize(rows, columns=["metric_value"], target_range=(-1.0, 1.0))


def _dedupe_sql(pick: str) -> str:
    return f"""SELECT {pick}(doc_id, doc_id) AS doc_id, text, {pick}(source, doc_id) AS source FROM documents GROUP BY text"""


@query("deduplicate_first", _dedupe_sql("arg_min"))
def _(t: Tables):
    return W.deduplicate(t.documents.select("doc_id", "text", "source"), ["text"], "first", ["doc_id"])


@query("deduplicate_last", _dedupe_sql("arg_max"))
def _(t: Tables):
    return W.deduplicate(t.documents.select("doc_id", "text", "source"), ["text"], "last", ["doc_id"])


@query("deduplicate_none", _dedupe_sql("arg_min") + " HAVING count(*) = 1")
def _(t: Tables):
    return W.deduplicate(t.documents.select("doc_id", "text", "source"), ["text"], "none", ["doc_id"])


@query(
    "train_validation_split",
    """SELECT doc_id, lang, source, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1
  < count(*) OVER (PARTITION BY lang, source) * CAST(0.8 AS DOUBLE) THEN 'train' ELSE 'validation' END AS split
FROM documents""",
)
def _(t: Tables):
    return W.train_validation_split(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])


@query(
    "last_exchanges",
    """SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3""",
)
def _(t: Tables):
    return W.last_exchanges(t.conversations, 3, key="conv_id", order="turn")


@query(
    "ewma",
    """WITH r AS (SELECT metric_name, metric_value AS x, row_number() OVER (PARTITION BY metric_name ORDER BY metric_timestamp, id) AS i,
  count(*) OVER (PARTITION BY metric_name) AS n FROM metrics),
s AS (SELECT metric_name, min(i) FILTER (x <> 0) AS seed FROM r GROUP BY 1)
---
SELECT r.metric_name, count(*) AS n, sum(x * power(CAST(0.9 AS DOUBLE), r.n - i) * CASE WHEN i = seed THEN 1 ELSE
  1 - CAST(0.9 AS DOUBLE) END) AS ewma FROM r JOIN s ON s.metric_name = r.metric_name GROUP BY 1""",
    ("metrics",),
    floats=("ewma",),
)
def _(t: Tables):
    return W.ewma(t.metrics(), ["metric_name"], ["metric_timestamp", "id"], "metric_value")


@query(
    "running_mean",
    """SELECT document_type, document_id, event_time, avg(ln(processing_duration)) OVER w AS mean_log_duration,
  avg(ln(confidence)) OVER w AS mean_log_confidence FROM doc_events
WINDOW w AS (PARTITION BY document_type ORDER BY event_time, document_id ROWS UNBOUNDED PRECEDING)""",
    EV,
    floats=("mean_log_duration", "mean_log_confidence"),
)
def _(t: Tables):
    logs = {"log_duration": F.ln("processing_duration"), "log_confidence": F.ln("confidence")}
    rows = t.doc_events().select(
        "document_type", "document_id", "event_time", *[c.alias(n) for n, c in logs.items()]
    )
    out = W.running_mean(rows, ["document_type"], ["event_time", "document_id"], list(logs))
    return out.drop(*logs)
