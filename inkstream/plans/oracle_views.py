"""The adapter views in SQL, for checking results on another engine."""

from __future__ import annotations

#: name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "events_k": (
        (),
        "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events",
    ),
    "doc_events": (
        ("events_k",),
        """
SELECT event_id AS document_id, ts AS event_time, user_id,
  CASE event_id % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract'
       WHEN 3 THEN 'report' ELSE 'other' END AS document_type,
  value * 100 AS processing_duration, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN concat('E', CAST(k % 3 AS VARCHAR)) END AS error_code,
  CASE WHEN event_type = 'error' THEN concat('failure ', CAST(k % 3 AS VARCHAR)) END AS error_message,
  CAST(k + 1 AS DOUBLE) / 100 AS confidence,
  CAST(user_id * 10000 + k * 100000 AS BIGINT) AS file_size,
  CASE event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' END AS sentiment,
  CAST(event_id % 21 AS DOUBLE) / 10 - 1 AS sentiment_score,
  CASE event_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es'
       WHEN 4 THEN 'en' END AS detected_language,
  k % 4 AS n_entities
FROM events_k""",
    ),
    "doc_entities": (
        ("doc_events",),
        """
SELECT d.document_id, d.event_time, d.document_type, n.entity_type,
       d.confidence * n.f AS entity_confidence
FROM doc_events d JOIN (VALUES (0, 'person', CAST(0.9 AS DOUBLE)), (1, 'organization', CAST(0.8 AS DOUBLE)),
       (2, 'amount', CAST(0.7 AS DOUBLE))) n(i, entity_type, f) ON n.i < d.n_entities""",
    ),
    "files": (
        ("events_k",),
        """
SELECT event_id AS document_id, CASE WHEN k <> 13 THEN user_id END AS user_id,
  CASE WHEN event_id % 17 <> 0 THEN concat(' doc-', CAST(event_id AS VARCHAR), '.v', CAST(k % 3 AS VARCHAR),
    CASE event_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' ELSE '.txt' END, ' ') END AS file_name,
  CAST(CASE WHEN k = 7 THEN NULL WHEN k % 3 = 0 THEN k * 10000 ELSE k * 1200000 END AS BIGINT) AS file_size,
  CASE event_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png'
    WHEN 3 THEN 'text/plain' WHEN 4 THEN 'application/msword' ELSE 'application/zip' END AS content_type,
  CASE event_id % 5 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 3 THEN 'failed'
    ELSE 'completed' END AS status,
  ts AS created_at, value / 10 AS processing_time
FROM events_k""",
    ),
    "metrics": (
        (),
        "SELECT event_id AS id, event_type AS metric_name, value AS metric_value, ts AS metric_timestamp FROM events",
    ),
    "requests": (
        (),
        """
SELECT event_id AS request_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
  concat('/', event_type) AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  value / 1000 AS latency, ts AS at FROM events""",
    ),
    "invoices": (
        (),
        """
SELECT o.o_orderkey AS document_id, concat('INV-', CAST(o.o_orderkey AS VARCHAR)) AS invoice_number,
  CASE WHEN o.o_orderkey % 7 <> 0 THEN concat('Vendor ', CAST(o.o_custkey % 50 AS VARCHAR)) END AS vendor_name,
  c.c_name AS customer_name, o.o_orderdate AS invoice_date,
  CASE WHEN o.o_orderkey % 11 <> 0 THEN o.o_orderdate + INTERVAL 30 DAY END AS due_date,
  o.o_totalprice AS total_amount, CAST(0.70 AS DOUBLE) + CAST(o.o_orderkey % 31 AS DOUBLE) / 100 AS confidence,
  o.o_orderkey % 10 <> 3 AS is_valid, o.o_orderdate AS created_at,
  concat('model-', CAST(o.o_orderkey % 3 AS VARCHAR)) AS model_name,
  coalesce(l.line_count, 0) AS line_count, l.subtotal, l.tax_amount
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS line_count, sum(l_extendedprice * (1 - l_discount)) AS subtotal,
                  sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax_amount FROM lineitem GROUP BY l_orderkey) l
  ON o.o_orderkey = l.l_orderkey""",
    ),
    "lineage_edges": (
        (),
        """
SELECT CAST(floor(p_partkey / 2.0) AS BIGINT) AS src, p_partkey AS dst FROM part WHERE p_partkey >= 1
UNION ALL SELECT p_partkey - 10, p_partkey FROM part WHERE p_partkey >= 50 AND p_partkey % 50 = 0""",
    ),
    "assets": (
        (),
        """
SELECT p_partkey AS asset_id, p_name AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'view' ELSE 'column' END AS asset_type,
  concat('made by ', p_brand) AS description,
  [lower(p_type), concat('size-', CAST(p_size AS VARCHAR))] AS tags,
  concat('team-', CAST(p_partkey % 5 AS VARCHAR)) AS owner,
  CAST(p_partkey % 101 AS DOUBLE) / 100 AS quality_score,
  TIMESTAMP '2024-01-31 00:00:00' - to_minutes(CAST(p_partkey AS BIGINT)) AS updated_at
FROM part""",
    ),
    "users": (
        (),
        """
SELECT c_custkey AS id, concat(lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')), '@example.com') AS email,
  c_name AS name, TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(c_custkey % 60 AS INT)) AS created_at,
  c_mktsegment AS segment, c_nationkey AS nation
FROM customer""",
    ),
    "user_documents": (
        (),
        "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders",
    ),
    "domain_events": (
        ("events_k",),
        """
SELECT event_id,
  CASE k % 5 WHEN 0 THEN 'DocumentUploaded' WHEN 1 THEN 'DocumentProcessingStarted'
    WHEN 2 THEN 'DocumentProcessingCompleted' WHEN 3 THEN 'DocumentProcessingFailed'
    ELSE 'DocumentClassified' END AS event_type,
  concat('doc-', CAST(event_id % 500 AS VARCHAR)) AS aggregate_id, ts AS timestamp, k, value
FROM events_k""",
    ),
}
