"""Data quality, profiling and alert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.operators import alerts as M
from inkstream.operators import quality as Q
from inkstream.plans.oracle_views import VIEWS
from inkstream.plans.registry import query
from inkstream.sources.views import AS_OF, Tables

NOW = f"TIMESTAMP '{AS_OF}'"
_TYPES5 = "'application/pdf', 'image/jpeg', 'image/png', 'text/plain', 'application/msword'"

VIEWS["document_results"] = (
    ("files",),
    f"""SELECT document_id, 'user_id' AS field_name, 'required' AS rule_type, false AS passed, 'Required field user_id is missing' AS message, 'error' AS severity
  FROM files WHERE user_id IS NULL
UNION ALL SELECT document_id, 'file_name', 'required', false, 'Required field file_name is missing', 'error' FROM files WHERE file_name IS NULL
UNION ALL SELECT document_id, 'file_size', 'required', false, 'Required field file_size is missing', 'error' FROM files WHERE file_size IS NULL
UNION ALL SELECT document_id, 'file_size', 'data_type', file_size IS NOT NULL, CASE WHEN file_size IS NOT NULL THEN 'File size is valid integer'
  ELSE 'File size must be a valid integer' END, 'error' FROM files
UNION ALL SELECT document_id, 'file_size', 'range', file_size > 0 AND file_size <= 104857600, CASE WHEN file_size <= 0 THEN 'File size must be greater than 0'
  WHEN file_size > 104857600 THEN 'File size exceeds 100MB limit' ELSE 'File size is within acceptable range' END,
  CASE WHEN file_size > 104857600 THEN 'warning' ELSE 'error' END FROM files WHERE file_size IS NOT NULL
UNION ALL SELECT document_id, 'content_type', 'format', false, concat('Invalid content type: ', content_type), 'warning' FROM files
  WHERE content_type NOT IN ({_TYPES5})""",
)


@query("validate_documents", "SELECT * FROM document_results", ("document_results",))
def _(t: Tables):
    return Q.validate_documents(t.files())


@query(
    "validate_metrics",
    """SELECT id, 'metric_value' AS field_name, 'required' AS rule_type, false AS passed, 'Required field metric_value is missing' AS message, 'error' AS severity
  FROM (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NULL
UNION ALL SELECT event_id, 'metric_value', CASE WHEN event_id % 9 = 0 THEN 'data_type' ELSE 'range' END, event_id % 9 <> 0 AND value BETWEEN 0 AND 1,
  CASE WHEN event_id % 9 = 0 THEN 'Metric value must be a valid number' WHEN value BETWEEN 0 AND 1 THEN 'Metric value is within valid range'
    ELSE 'Metric value should be between 0 and 1' END, CASE WHEN event_id % 9 <> 0 AND NOT value BETWEEN 0 AND 1 THEN 'warning' ELSE 'error' END FROM events""",
)
def _(t: Tables):
    value = F.when(F.col("id") % 9 != 0, F.col("metric_value"))
    return Q.validate_metrics(t.metrics().withColumn("metric_value", value))


_SUMMARY = """count(*) AS total_validations, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
  count(*) FILTER (NOT passed AND severity = 'error') AS critical_errors"""


@query(
    "validation_summary",
    f"SELECT document_id, {_SUMMARY} FROM document_results GROUP BY 1",
    ("document_results",),
)
def _(t: Tables):
    return Q.validation_summary(Q.validate_documents(t.files()))


_FILE_COLS = ("document_id", "user_id", "file_name", "file_size", "content_type", "status", "created_at", "processing_time")
_OTHER = tuple(c for c in _FILE_COLS if c not in ("file_size", "created_at"))


def _avg(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN CAST(1 AS DOUBLE) ELSE 0 END)"


_COMPLETE = "(" + " + ".join(f"count({c})" for c in _FILE_COLS) + f") / CAST({len(_FILE_COLS)} AS DOUBLE) / count(*)"
_FILLED = " + ".join(_avg(f"length(CAST({c} AS VARCHAR)) > 0") for c in _OTHER)
_VALID = f"(2 + {_FILLED}) / {len(_FILE_COLS)}"
_CONSISTENT = f"({_avg('file_size IS NOT NULL')} + {_avg('created_at IS NOT NULL')} + {_FILLED}) / {len(_FILE_COLS)}"
_TIMELY = f"avg(greatest(least(1 - (epoch_us({NOW}) - epoch_us(created_at)) / CAST(3600000000 AS DOUBLE) / 24, 1), 0))"
_ACCURATE = f"""({_avg('file_size > 0')} + {_avg("content_type IN ('application/pdf', 'image/jpeg', 'image/png', 'text/plain')")}
  + count(DISTINCT document_id) / CAST(count(*) AS DOUBLE)) / 3"""
_UNIQUE = "(SELECT count(*) FROM (SELECT DISTINCT * FROM files)) / CAST(count(*) AS DOUBLE)"


@query("completeness", f"SELECT {_COMPLETE} AS completeness FROM files", ("files",), floats=("completeness",))
def _(t: Tables):
    return Q.completeness(t.files())


@query("validity", f"SELECT {_VALID} AS validity FROM files", ("files",), floats=("validity",))
def _(t: Tables):
    return Q.validity(t.files())


@query("consistency", f"SELECT {_CONSISTENT} AS consistency FROM files", ("files",), floats=("consistency",))
def _(t: Tables):
    return Q.consistency(t.files())


@query(
    "uniqueness",
    "SELECT (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) / CAST(count(*) AS DOUBLE) AS uniqueness FROM documents",
    floats=("uniqueness",),
)
def _(t: Tables):
    return Q.uniqueness(t.documents.select("text", "lang"))


@query("accuracy", f"SELECT {_ACCURATE} AS accuracy FROM files", ("files",), floats=("accuracy",))
def _(t: Tables):
    return Q.accuracy(t.files(), "documents")


@query(
    "accuracy_metrics",
    f"SELECT ({_avg('metric_value BETWEEN 0 AND 1')} + {_avg('length(metric_name) > 0')}) / 2 AS accuracy FROM metrics",
    ("metrics",),
    floats=("accuracy",),
)
def _(t: Tables):
    return Q.accuracy(t.metrics(), "analytics_metrics")


@query("timeliness", f"SELECT {_TIMELY} AS timeliness FROM files", ("files",), floats=("timeliness",))
def _(t: Tables):
    return Q.timeliness(t.files(), AS_OF)


_M_COLS = ("id", "metric_name", "metric_value", "metric_timestamp")
_M_FILLED = " + ".join(_avg(f"length(CAST({c} AS VARCHAR)) > 0") for c in _M_COLS)
_LEVEL = """CASE WHEN overall_score >= 0.95 THEN 'excellent' WHEN overall_score >= 0.8 THEN 'good' WHEN overall_score >= 0.6 THEN 'fair'
  WHEN overall_score >= 0.4 THEN 'poor' ELSE 'critical' END AS quality_level"""
_OVERALL = "(completeness + accuracy + consistency + validity + timeliness + uniqueness) / 6 AS overall_score"
VIEWS["table_quality"] = (
    ("files", "metrics"),
    f"""SELECT *, {_LEVEL} FROM (SELECT *, {_OVERALL} FROM (
  SELECT 'documents' AS table_name, {_COMPLETE} AS completeness, {_ACCURATE} AS accuracy, {_CONSISTENT} AS consistency, {_VALID} AS validity,
    {_TIMELY} AS timeliness, {_UNIQUE} AS uniqueness FROM files
  UNION ALL SELECT 'analytics_metrics', (count(id) + count(metric_name) + count(metric_value) + count(metric_timestamp)) / CAST(4 AS DOUBLE) / count(*),
    ({_avg('metric_value BETWEEN 0 AND 1')} + {_avg('length(metric_name) > 0')}) / 2, ({_M_FILLED}) / 4, ({_M_FILLED}) / 4,
    {_TIMELY.replace('created_at', 'metric_timestamp')}, (SELECT count(*) FROM (SELECT DISTINCT * FROM metrics)) / CAST(count(*) AS DOUBLE) FROM metrics
  UNION ALL SELECT 'conversations', (count(conv_id) + count(turn) + count(role) + count(text)) / CAST(4 AS DOUBLE) / count(*), 0.5,
    ({' + '.join(_avg(f"length(CAST({c} AS VARCHAR)) > 0") for c in ('conv_id', 'turn', 'role', 'text'))}) / 4,
    ({' + '.join(_avg(f"length(CAST({c} AS VARCHAR)) > 0") for c in ('conv_id', 'turn', 'role', 'text'))}) / 4,
    0.5, (SELECT count(*) FROM (SELECT DISTINCT * FROM conversations)) / CAST(count(*) AS DOUBLE) FROM conversations))""",
)
_DIMS = (*Q.DIMENSIONS, "overall_score")


def quality_tables(t: Tables) -> dict[str, DataFrame]:
    return {"documents": t.files(), "analytics_metrics": t.metrics(), "conversations": t.conversations}


@query("quality_metrics", "SELECT * FROM table_quality WHERE table_name = 'documents'", ("table_quality",), floats=_DIMS)
def _(t: Tables):
    return Q.quality_metrics(t.files(), "documents", AS_OF, rounded=False)


@query("quality_dashboard", "SELECT * FROM table_quality", ("table_quality",), floats=_DIMS)
def _(t: Tables):
    return Q.quality_dashboard(quality_tables(t), AS_OF, rounded=False)


@query(
    "quality_dashboard_failed_table",
    """SELECT * FROM table_quality WHERE table_name = 'documents'
UNION ALL SELECT 'missing', 0, 0, 0, 0, 0, 0, 0, 'critical' UNION ALL SELECT 'malformed', 0, 0, 0, 0, 0, 0, 0, 'critical'""",
    ("table_quality",),
    floats=_DIMS,
)
def _(t: Tables):
    """One good table, one that is not there and one without the columns asked for."""
    broken = {
        "missing": lambda: t.spark.read.parquet(f"{t.folder}/no_such_table.parquet"),
        "malformed": lambda: t.files().select("no_such_column"),
    }
    return Q.quality_dashboard({"documents": t.files(), **broken}, AS_OF, rounded=False)


_ADVICE = """SELECT table_name, 'Improve data completeness by implementing required field validation' AS recommendation FROM table_quality WHERE completeness < 0.8
UNION ALL SELECT table_name, 'Enhance data accuracy by implementing business rule validation' FROM table_quality WHERE accuracy < 0.8
UNION ALL SELECT table_name, 'Improve data consistency by standardizing data formats' FROM table_quality WHERE consistency < 0.8
UNION ALL SELECT table_name, 'Enhance data validity by implementing format validation' FROM table_quality WHERE validity < 0.8
UNION ALL SELECT table_name, 'Improve data timeliness by implementing real-time data processing' FROM table_quality WHERE timeliness < 0.8
UNION ALL SELECT table_name, 'Enhance data uniqueness by implementing duplicate detection' FROM table_quality WHERE uniqueness < 0.8
UNION ALL SELECT table_name, concat('Address ', (SELECT CAST(count(*) AS VARCHAR) FROM document_results WHERE NOT passed AND severity = 'error'), ' critical validation errors')
  FROM table_quality"""


@query("quality_recommendations", _ADVICE, ("table_quality", "document_results"))
def _(t: Tables):
    results = Q.validate_documents(t.files())
    return Q.quality_recommendations(Q.quality_dashboard(quality_tables(t), AS_OF), results)


@query(
    "quality_report",
    f"""WITH a AS ({_ADVICE})
---
SELECT table_quality.*, s.*, (SELECT string_agg(recommendation, '; ' ORDER BY recommendation) FROM a WHERE table_name = 'documents') AS recommendations
FROM table_quality, (SELECT {_SUMMARY} FROM document_results) s WHERE table_name = 'documents'""",
    ("table_quality", "document_results"),
    floats=_DIMS,
)
def _(t: Tables):
    files = t.files()
    out = Q.quality_report(files, "documents", Q.validate_documents(files), AS_OF, rounded=False)
    return out.withColumn("recommendations", F.array_join("recommendations", "; "))


_QALERTS = " UNION ALL ".join(
    f"SELECT table_name, '{d}' AS metric, {d} AS value FROM table_quality WHERE {d} < 0.8" for d in Q.DIMENSIONS
)


@query(
    "quality_alerts",
    f"SELECT *, CAST(0.8 AS DOUBLE) AS threshold, CASE WHEN value <= 0.6 THEN 'critical' ELSE 'warning' END AS severity FROM ({_QALERTS})",
    ("table_quality",),
    floats=("value", "threshold"),
)
def _(t: Tables):
    return Q.quality_alerts(Q.quality_dashboard(quality_tables(t), AS_OF, rounded=False))


@query(
    "quality_alert_counts",
    f"""SELECT count(*) AS total_alerts, count(*) FILTER (value <= 0.6) AS critical_alerts, count(*) FILTER (value > 0.6) AS warning_alerts FROM ({_QALERTS})""",
    ("table_quality",),
)
def _(t: Tables):
    return Q.alert_counts(Q.quality_alerts(Q.quality_dashboard(quality_tables(t), AS_OF, rounded=False)))


@query(
    "rule_set",
    """WITH f AS (SELECT *, concat('doc-', CAST(document_id % 700 AS VARCHAR)) AS alias FROM files)
---
SELECT document_id, 'file_name' AS field_name, 'required' AS rule_type, false AS passed, 'required rule failed for file_name' AS message, 'error' AS severity FROM f WHERE file_name IS NULL
UNION ALL SELECT document_id, 'status', 'data_type', false, 'data_type rule failed for status', 'error' FROM f WHERE TRY_CAST(status AS DOUBLE) IS NULL
UNION ALL SELECT document_id, 'content_type', 'format', false, 'format rule failed for content_type', 'warning' FROM f WHERE content_type NOT IN ('application/pdf', 'image/png')
UNION ALL SELECT document_id, 'file_size', 'range', false, 'range rule failed for file_size', 'error' FROM f WHERE file_size < 1 OR file_size > 100000000
UNION ALL SELECT document_id, 'file_name', 'pattern', false, 'pattern rule failed for file_name', 'error' FROM f WHERE file_name IS NOT NULL AND NOT regexp_matches(file_name, 'v[01][.](pdf|txt)')
UNION ALL SELECT document_id, 'file_size', 'business_logic', false, 'business_logic rule failed for file_size', 'error' FROM f WHERE NOT coalesce(status <> 'failed' OR file_size < 5000000, false)
UNION ALL SELECT document_id, 'alias', 'unique', false, 'unique rule failed for alias', 'error' FROM f WHERE alias IN (SELECT alias FROM f GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT document_id, 'user_id', 'referential', false, 'referential rule failed for user_id', 'error' FROM f WHERE user_id IS NOT NULL
  AND user_id NOT IN (SELECT s_suppkey FROM supplier)""",
    ("files",),
)
def _(t: Tables):
    rows = t.files().withColumn("alias", F.concat(F.lit("doc-"), (F.col("document_id") % 700).cast("string")))
    rules = (
        Q.RuleSet(["document_id"])
        .register("file_name", "required")
        .register("status", "data_type", {"type": "double"})
        .register("content_type", "format", {"values": ["application/pdf", "image/png"]}, "warning")
        .register("file_size", "range", {"min": 1, "max": 100_000_000})
        .register("file_name", "pattern", {"regex": "v[01][.](pdf|txt)"})
        .register("file_size", "business_logic", {"expression": "status <> 'failed' OR file_size < 5000000"})
        .register("alias", "unique")
        .register("user_id", "referential", {"table": "suppliers", "column": "s_suppkey"})
    )
    return rules.apply(rows, {"suppliers": t.supplier})


def _num_profile(c: str, kind: str) -> str:
    return f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
  (count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*) AS null_percentage, count(DISTINCT {c}) AS unique_count,
  count(DISTINCT {c}) * CAST(100 AS DOUBLE) / count(*) AS unique_percentage, avg({c}) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, stddev_samp({c}) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS VARCHAR) AS most_common, CAST(NULL AS BIGINT) AS most_common_count,
  CAST(NULL AS DOUBLE) AS avg_length FROM files"""


def _text_profile(c: str) -> str:
    return f"""SELECT '{c}', 'string', count({c}), count(*) - count({c}), (count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), count(DISTINCT {c}),
  count(DISTINCT {c}) * CAST(100 AS DOUBLE) / count(*), NULL, NULL, NULL, NULL, NULL,
  (SELECT {c} FROM files WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  (SELECT count(*) FROM files WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1), avg(length({c})) FROM files"""


@query(
    "profile",
    " UNION ALL ".join(
        [
            _num_profile("document_id", "bigint"),
            _num_profile("user_id", "bigint"),
            _num_profile("file_size", "bigint"),
            _num_profile("processing_time", "double"),
            _text_profile("file_name"),
            _text_profile("content_type"),
            _text_profile("status"),
        ]
    )
    + """ UNION ALL SELECT 'created_at', 'timestamp_ntz', count(created_at), 0, 0, count(DISTINCT created_at),
  count(DISTINCT created_at) * CAST(100 AS DOUBLE) / count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM files""",
    ("files",),
    floats=("null_percentage", "unique_percentage", "mean:4", "median:4", "std:4", "min", "max", "avg_length"),
)
def _(t: Tables):
    return Q.profile(t.files(), rounded=False)


@query(
    "upload_checks",
    """WITH f AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 0 ELSE document_id // 12 END AS batch_id, trim(file_name) AS file_name, file_size FROM files),
b AS (SELECT batch_id, count(*) AS n FROM f GROUP BY 1),
r AS (SELECT f.*, CASE WHEN n > 15 THEN concat('Too many files. Maximum 15 files allowed per batch. You provided ', CAST(n AS VARCHAR), ' files.')
  WHEN coalesce(file_name, '') = '' THEN 'No filename provided'
  WHEN '.' || lower(list_extract(string_split(file_name, '.'), -1)) NOT IN ('.pdf', '.docx', '.doc', '.txt', '.jpg', '.jpeg', '.png', '.tiff')
    THEN concat('File type not supported: .', lower(list_extract(string_split(file_name, '.'), -1)))
  WHEN file_size > 52428800 THEN concat('File too large: ', CAST(file_size AS VARCHAR), ' bytes (max: 52428800)') END AS reason
  FROM f JOIN b ON b.batch_id = f.batch_id)
---
SELECT document_id, batch_id, file_name, file_size, reason IS NULL AS accepted, reason FROM r""",
    ("files",),
)
def _(t: Tables):
    key = F.col("document_id")
    batch = F.when(key % 3 == 0, 0).otherwise(F.floor(key / 12))
    files = t.files().select("document_id", batch.alias("batch_id"), F.trim("file_name").alias("file_name"), "file_size")
    return Q.upload_checks(files)


_RULED = """WITH i AS (SELECT document_id, CASE WHEN document_id % 40 = 1 THEN 'INV-same' ELSE invoice_number END AS invoice_number, vendor_name, invoice_date,
  CASE WHEN document_id % 17 = 0 THEN invoice_date ELSE due_date END AS due_date, CASE WHEN document_id % 23 = 0 THEN 0 WHEN document_id % 29 = 0 THEN 1000000 ELSE total_amount END
  AS total_amount, CASE WHEN document_id % 2 = 0 THEN total_amount - 10 ELSE subtotal END AS subtotal, CASE WHEN document_id % 2 = 0 THEN 10 ELSE tax_amount END AS tax_amount,
  CASE WHEN document_id % 4 = 0 THEN total_amount ELSE subtotal END AS line_total FROM invoices)
---
"""


@query(
    "invoice_rules",
    _RULED
    + """SELECT document_id, 'vendor_name' AS field_name, 'required' AS rule_type, false AS passed, 'required rule failed for vendor_name' AS message, 'error' AS severity FROM i WHERE vendor_name IS NULL
UNION ALL SELECT document_id, 'invoice_number', 'unique', false, 'unique rule failed for invoice_number', 'error' FROM i WHERE invoice_number IN
  (SELECT invoice_number FROM i GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT document_id, 'vendor_name', 'referential', false, 'referential rule failed for vendor_name', 'warning' FROM i WHERE vendor_name IS NOT NULL
  AND vendor_name NOT IN (SELECT concat('Vendor ', CAST(n_nationkey AS VARCHAR)) FROM nation)
UNION ALL SELECT document_id, 'invoice_date', 'range', false, 'Invoice date is in the future', 'error' FROM i WHERE invoice_date > TIMESTAMP '2001-01-01 00:00:00'
UNION ALL SELECT document_id, 'invoice_date', 'range', false, 'Invoice date is older than 5 years', 'error' FROM i WHERE invoice_date < TIMESTAMP '1996-01-01 00:00:00'
UNION ALL SELECT document_id, 'total_amount', 'range', false, 'Total amount must be positive', 'error' FROM i WHERE total_amount <= 0
UNION ALL SELECT document_id, 'total_amount', 'range', false, 'Total amount must be under 1,000,000', 'error' FROM i WHERE total_amount >= 1000000
UNION ALL SELECT document_id, 'due_date', 'business_logic', false, 'Due date must be after invoice date', 'error' FROM i WHERE due_date <= invoice_date
UNION ALL SELECT document_id, 'total_amount', 'business_logic', false, 'Subtotal plus tax must equal total', 'error' FROM i WHERE abs(subtotal + tax_amount - total_amount) > 0.01
UNION ALL SELECT document_id, 'line_items', 'business_logic', false, 'Line items must sum to total', 'error' FROM i WHERE abs(line_total - total_amount) > 0.01""",
    ("invoices",),
)
def _(t: Tables):
    key, total = F.col("document_id"), F.col("total_amount")
    inv = t.invoices().select(
        "document_id",
        F.when(key % 40 == 1, "INV-same").otherwise(F.col("invoice_number")).alias("invoice_number"),
        "vendor_name",
        "invoice_date",
        F.when(key % 17 == 0, F.col("invoice_date")).otherwise(F.col("due_date")).alias("due_date"),
        F.when(key % 23 == 0, 0.0).when(key % 29 == 0, 1000000.0).otherwise(total).alias("total_amount"),
        F.when(key % 2 == 0, total - 10).otherwise(F.col("subtotal")).alias("subtotal"),
        F.when(key % 2 == 0, 10.0).otherwise(F.col("tax_amount")).alias("tax_amount"),
        F.when(key % 4 == 0, total).otherwise(F.col("subtotal")).alias("line_total"),
    )
    vendors = t.nation.select(F.concat(F.lit("Vendor "), F.col("n_nationkey").cast("string")).alias("vendor_name"))
    return Q.invoice_rules(inv, vendors, "2001-01-01 00:00:00")


@query(
    "standardize_invoice",
    """WITH v AS (SELECT DISTINCT p_name AS v FROM part),
i AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN substring(p_name, 1, 3) || substring(p_name, 5) WHEN l_partkey % 4 = 1 THEN replace(p_name, 'a', 'e')
    WHEN l_partkey % 4 = 2 THEN p_name || ' ltd' ELSE p_name END AS raw, CAST(l_shipdate AS DATE) AS d, l_quantity AS q, l_partkey % 3 AS k FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT raw, min({d: levenshtein(raw, v), v: v}) AS b FROM (SELECT DISTINCT raw FROM i) x, v WHERE levenshtein(raw, v) <= 2 GROUP BY raw)
---
SELECT l_orderkey, l_linenumber, coalesce(n.b.v, i.raw) AS vendor_name, d AS invoice_date, CASE k WHEN 0 THEN q * 1000 WHEN 1 THEN q * 1000000 ELSE q END AS total_amount,
  coalesce(n.b.d, 0) > 0 AS vendor_corrected FROM i LEFT JOIN n ON n.raw = i.raw""",
    floats=("total_amount:4",),
)
def _(t: Tables):
    k, name, d = F.col("l_partkey") % 4, F.col("p_name"), F.col("l_shipdate")
    raw = (
        F.when(k == 0, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100)))
        .when(k == 1, F.translate(name, "a", "e"))
        .when(k == 2, F.concat(name, F.lit(" ltd")))
        .otherwise(name)
    )
    form = F.col("l_linenumber") % 4
    date = (
        F.when(form == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(d, "dd/MM/yyyy"))
        .when((form == 2) & (F.year(d) >= 2000), F.date_format(d, "dd/MM/yy"))
        .otherwise(F.date_format(d, "yyyyMMdd"))
    )
    amount, unit = F.format_string("%.2f", "l_quantity"), F.col("l_partkey") % 3
    text = F.when(unit == 0, F.concat(amount, F.lit("K"))).when(unit == 1, F.concat(F.lit("$"), amount, F.lit(" M")))
    parts = t.part.select("p_partkey", "p_name")
    inv = t.lineitem.join(parts, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", raw.alias("vendor_name"), date.alias("invoice_date"),
        text.otherwise(amount).alias("total_amount"),
    )
    return Q.standardize_invoice(inv, t.part.selectExpr("p_name AS vendor_name"))


_QTREND = """WITH trend AS (SELECT CAST(event_time AS DATE) AS date, avg(1 - confidence / 5) AS quality_score FROM doc_events GROUP BY 1)
---
"""


def history(t: Tables) -> DataFrame:
    return t.doc_events().select(
        F.col("event_time").alias("created_at"), (1 - F.col("confidence") / 5).alias("quality_score")
    )


@query(
    "quality_trend",
    _QTREND + "SELECT *, CASE WHEN quality_score < 0.9 THEN 'Quality dropped below 0.90' END AS alert FROM trend",
    ("doc_events",),
    floats=("quality_score",),
)
def _(t: Tables):
    return Q.quality_trend(history(t))


@query(
    "quality_trend_summary",
    _QTREND
    + """SELECT min(date) AS period_start, max(date) AS period_end, avg(quality_score) AS average_quality,
  arg_max(quality_score, date) - arg_min(quality_score, date) AS quality_improvement, count(*) FILTER (quality_score < 0.9) AS alerts FROM trend""",
    ("doc_events",),
    floats=("average_quality", "quality_improvement"),
)
def _(t: Tables):
    return Q.quality_trend_summary(Q.quality_trend(history(t)))


# --- alerts ---

_RULES = (
    M.AlertRule("ManyErrors", "High error level", "critical", "error", 10.0, ">", 1440),
    M.AlertRule("FewViews", "Low view level", "high", "view", 1000.0, "<", 2880),
    M.AlertRule("ClicksFlat", "Click level", "medium", "click", 0.0, "<=", 600),
    M.AlertRule("Purchases", "Purchase level", "low", "purchase", 1.0, ">=", 10080),
    M.AlertRule("Off", "Disabled", "low", "signup", 0.0, ">", 10080, enabled=False),
)


def _rule_sql(r: M.AlertRule) -> str:
    return f"""SELECT '{r.name}' AS rule_name, '{r.severity}' AS severity, '{r.metric_name}' AS metric_name, avg(metric_value) AS metric_value,
  CAST({r.threshold} AS DOUBLE) AS threshold, '{r.description}: {r.metric_name}' AS message, 'active' AS status, {NOW} AS created_at FROM metrics
WHERE metric_name = '{r.metric_name}' AND metric_timestamp BETWEEN {NOW} - INTERVAL {r.window_minutes} MINUTE AND {NOW} HAVING avg(metric_value) {r.operator} {r.threshold}"""


@query(
    "evaluate_alerts",
    " UNION ALL ".join(_rule_sql(r) for r in _RULES if r.enabled),
    ("metrics",),
    floats=("metric_value", "threshold"),
)
def _(t: Tables):
    return M.evaluate_alerts(t.metrics(), _RULES, AS_OF)


#: Metric names of the default rules, spread over the events.
_DEFAULT_NAMES = tuple(r.metric_name for r in M.DEFAULT_RULES)
VIEWS["service_metrics"] = (
    (),
    "SELECT event_id AS id, CASE event_id % 8 "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_DEFAULT_NAMES))
    + " END AS metric_name, value AS metric_value, to_timestamp(CAST(event_id % 3600 AS DOUBLE))::TIMESTAMP AS metric_timestamp FROM events",
)


def service_metrics(t: Tables) -> DataFrame:
    key = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(n) for n in _DEFAULT_NAMES]), (key % 8 + 1).cast("int"))
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), key % 3600)
    return t.events.select(
        key.alias("id"),
        name.alias("metric_name"),
        F.col("value").alias("metric_value"),
        (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + second).alias("metric_timestamp"),
    )


@query(
    "evaluate_default_alerts",
    " UNION ALL ".join(
        _rule_sql(r).replace("FROM metrics", "FROM service_metrics").replace(NOW, "TIMESTAMP '1970-01-01 01:00:00'")
        for r in M.DEFAULT_RULES
    ),
    ("service_metrics",),
    floats=("metric_value", "threshold"),
)
def _(t: Tables):
    return M.evaluate_alerts(service_metrics(t), as_of="1970-01-01 01:00:00")


@query(
    "alert_history",
    """SELECT event_id AS id, value AS metric_value, ts AS created_at FROM events WHERE event_type = 'error'
AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
    floats=("metric_value",),
)
def _(t: Tables):
    rows = t.events.where("event_type = 'error'").selectExpr("event_id AS id", "value AS metric_value", "ts AS created_at")
    return M.alert_history(rows, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query(
    "resource_trend",
    """WITH c AS (SELECT metric_name, round(arg_max(metric_value, {t: metric_timestamp, i: id}), 2) AS current_value FROM metrics GROUP BY 1)
---
SELECT *, CASE WHEN current_value > 80 THEN 'increasing' WHEN current_value < 20 THEN 'decreasing' ELSE 'stable' END AS trend,
  CAST(80 AS DOUBLE) AS threshold, 'healthy' AS status FROM c""",
    ("metrics",),
    floats=("current_value:4", "threshold"),
)
def _(t: Tables):
    return M.resource_trend(t.metrics())
