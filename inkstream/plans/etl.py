"""The three configured transformation chains, as plain composition of operators.

Each function takes source tables and returns every table it would load, lazily; a sink
decides what to write.  Shared steps are evaluated inside one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkstream.operators import metrics as G
from inkstream.operators import relational as R
from inkstream.operators import windows as W
from inkstream.plans.registry import query
from inkstream.sources.views import AS_OF, Tables


def document_processing(documents: DataFrame) -> dict[str, DataFrame]:
    """Uploaded documents: cleaned, enriched, aggregated per user and category."""
    staged = R.clean(
        documents.where("status = 'uploaded'"),
        ["file_name", "content_type"],
        ["document_id", "user_id", "file_name"],
        {"file_size": "bigint", "created_at": "timestamp_ntz"},
    )
    enriched = R.enrich_documents(staged)
    return {
        "staging_documents": staged,
        "enriched_documents": enriched,
        "document_aggregates": G.document_aggregates(enriched),
    }


def analytics_processing(metrics: DataFrame, as_of=None, label: str = "24h") -> dict[str, DataFrame]:
    """Recent metrics: cleaned, scaled to [0, 1] per metric, aggregated per metric and day."""
    staged = R.clean(
        R.time_range(metrics, "metric_timestamp", label, as_of),
        ["metric_name", "metadata"],
        ["metric_name", "metric_value", "metric_timestamp"],
        {"metric_value": "double", "metric_timestamp": "timestamp_ntz"},
    )
    scaled = W.normalize(staged, columns=["metric_value"], target_range=(0.0, 1.0), group_by=["metric_name"])
    return {
        "staging_metrics": staged,
        "normalized_metrics": scaled,
        "metric_aggregates": G.metric_aggregates(scaled),
    }


def user_analytics(users: DataFrame, documents: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """Users with their document counts, tier and age."""
    staged = R.clean(R.user_document_counts(users, documents), ["email", "name"], ["id", "email"])
    return {"staging_users": staged, "enriched_users": R.enrich_users(staged, as_of)}


@query(
    "uploaded_document_aggregates",
    """SELECT user_id, CASE WHEN content_type LIKE '%pdf%' THEN 'document' WHEN content_type LIKE '%image%' THEN 'image' ELSE 'other' END AS file_category,
  CASE WHEN file_size < 1024000 THEN 'small' WHEN file_size < 10485760 THEN 'medium' ELSE 'large' END AS size_category,
  count(*) AS total_documents, CAST(sum(file_size) AS BIGINT) AS total_size, avg(file_size) AS avg_size, max(created_at) AS latest_upload
FROM files WHERE status = 'uploaded' AND user_id IS NOT NULL AND file_name IS NOT NULL GROUP BY 1, 2, 3""",
    ("files",),
    floats=("avg_size:4",),
)
def _(t: Tables):
    return document_processing(t.files())["document_aggregates"]


@query(
    "scaled_metric_aggregates",
    f"""WITH m AS (SELECT * FROM metrics WHERE metric_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
r AS (SELECT metric_name, min(metric_value) AS lo, max(metric_value) AS hi FROM m GROUP BY 1),
s AS (SELECT m.metric_name, metric_timestamp, CASE WHEN hi <> lo THEN (metric_value - lo) / (hi - lo) ELSE metric_value END AS v FROM m JOIN r ON r.metric_name = m.metric_name)
---
SELECT metric_name, CAST(metric_timestamp AS DATE) AS metric_date, avg(v) AS avg_value, min(v) AS min_value, max(v) AS max_value, count(*) AS count,
  stddev_samp(v) AS std_value FROM s GROUP BY 1, 2""",
    ("metrics",),
    floats=("avg_value", "min_value", "max_value", "std_value"),
)
def _(t: Tables):
    return analytics_processing(t.metrics(), AS_OF, "7d")["metric_aggregates"]


@query(
    "user_tiers",
    """SELECT user_tier, count(*) AS users, CAST(sum(document_count) AS BIGINT) AS documents, CAST(sum(recent) AS BIGINT) AS recent_users FROM (
  SELECT coalesce(n, 0) AS document_count, CASE WHEN coalesce(n, 0) = 0 THEN 'new' WHEN n < 10 THEN 'basic' WHEN n < 50 THEN 'active' ELSE 'power' END AS user_tier,
    CAST(date_diff('day', CAST(created_at AS DATE), DATE '2024-01-31') < 30 AS INT) AS recent FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM user_documents GROUP BY 1) d ON d.user_id = u.id)
GROUP BY 1""",
    ("users", "user_documents"),
)
def _(t: Tables):
    users = user_analytics(t.users(), t.user_documents(), AS_OF)["enriched_users"]
    return G.aggregate(
        users, ["user_tier"], {"users": "COUNT(*)", "documents": "SUM(document_count)", "recent_users": "SUM(is_recent_user)"}
    )
