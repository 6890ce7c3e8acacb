"""Event store, lineage, experiments and migration over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream import schemas
from inkstream.operators import events as E
from inkstream.operators import experiments as B
from inkstream.operators import lineage as N
from inkstream.operators import migration as Z
from inkstream.operators import relational as R
from inkstream.plans.oracle_views import VIEWS
from inkstream.plans.registry import query
from inkstream.plans.relational import FK_EDGES, constraint_tables
from inkstream.session import ensure_checkpoint_dir
from inkstream.sources.views import Tables

DE = ("domain_events",)

VIEWS["store"] = (
    DE,
    "SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY timestamp, event_id) AS version FROM domain_events",
)


def store(t: Tables) -> DataFrame:
    return E.append_events(t.domain_events())


@query("append_events", "SELECT event_id, event_type, aggregate_id, timestamp, version FROM store", ("store",))
def _(t: Tables):
    """Append the newer part of the events to a store that holds the older part."""
    rows = t.domain_events()
    cut = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    old = E.append_events(rows.where(F.col("timestamp") < cut))
    new = E.append_events(rows.where(F.col("timestamp") >= cut), old)
    return old.unionByName(new).select("event_id", "event_type", "aggregate_id", "timestamp", "version")


@query(
    "events_of",
    "SELECT event_id, event_type, timestamp, version FROM store WHERE aggregate_id = 'doc-7' AND version >= 2",
    ("store",),
)
def _(t: Tables):
    return E.events_of(store(t), "doc-7", 2).select("event_id", "event_type", "timestamp", "version")


@query(
    "events_by_type",
    """SELECT event_id, aggregate_id, timestamp FROM domain_events WHERE event_type = 'DocumentProcessingFailed'
AND timestamp >= TIMESTAMP '2024-01-20 00:00:00'""",
    DE,
)
def _(t: Tables):
    return E.events_by_type(t.domain_events(), schemas.FAILED, "2024-01-20 00:00:00").select(
        "event_id", "aggregate_id", "timestamp"
    )


@query(
    "replay",
    """SELECT aggregate_id AS document_id,
  arg_max(CASE event_type WHEN 'DocumentUploaded' THEN 'uploaded' WHEN 'DocumentProcessingStarted' THEN 'processing'
    WHEN 'DocumentProcessingCompleted' THEN 'completed' ELSE 'failed' END, version) AS status, max(version) AS version,
  arg_max(concat('doc-', CAST(event_id AS VARCHAR), '.pdf'), version) FILTER (k % 5 = 0) AS file_name,
  CAST(arg_max(k * 1000, version) FILTER (k % 5 = 0) AS BIGINT) AS file_size,
  max(timestamp) FILTER (k % 5 = 0) AS uploaded_at,
  arg_max(concat('pipe-', CAST(k % 3 AS VARCHAR)), version) FILTER (k % 5 = 1) AS processing_pipeline,
  max(timestamp) FILTER (k % 5 = 1) AS processing_started_at,
  arg_max(value, version) FILTER (k % 5 = 2) AS processing_duration, max(timestamp) FILTER (k % 5 = 2) AS completed_at,
  arg_max(concat('failure ', CAST(k % 3 AS VARCHAR)), version) FILTER (k % 5 = 3) AS error_message,
  arg_max(concat('E', CAST(k % 3 AS VARCHAR)), version) FILTER (k % 5 = 3) AS error_code,
  arg_max(k % 6, version) FILTER (k % 5 = 3) AS retry_count, max(timestamp) FILTER (k % 5 = 3) AS failed_at
FROM store WHERE k % 5 <> 4 GROUP BY 1""",
    ("store",),
    floats=("processing_duration",),
)
def _(t: Tables):
    return E.replay(store(t)).drop("processing_result")


@query(
    "retry_schedule",
    """SELECT aggregate_id AS document_id, k % 6 + 1 AS retry_count, timestamp + INTERVAL 5 MINUTE AS scheduled_at FROM domain_events
WHERE event_type = 'DocumentProcessingFailed' AND k % 6 < 3""",
    DE,
)
def _(t: Tables):
    return E.retry_schedule(E.failures(t.domain_events()))


@query(
    "analytics_projection",
    """SELECT event_id, aggregate_id AS document_id, CASE WHEN k % 10 = 2 THEN 'unknown' ELSE CASE event_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt'
    ELSE 'contract' END END AS document_type, CASE WHEN k % 10 = 7 THEN 0 ELSE value END AS processing_duration, CAST(k + 1 AS DOUBLE) / 100 AS confidence_score,
  CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS entities_count, CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN event_id % 4 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'en' ELSE 'de' END AS language, timestamp
FROM domain_events WHERE event_type = 'DocumentProcessingCompleted'""",
    DE,
    floats=("processing_duration", "confidence_score"),
)
def _(t: Tables):
    return E.analytics_projection(t.domain_events())


@query(
    "route_events",
    """SELECT event_id, aggregate_id, CASE k % 5 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed'
  ELSE 'generic' END AS route FROM domain_events""",
    DE,
)
def _(t: Tables):
    out = None
    for name, rows in E.route_events(t.domain_events()).items():
        part = rows.select("event_id", "aggregate_id", F.lit(name).alias("route"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "status_of_documents",
    """SELECT aggregate_id AS document_id, max(timestamp) AS timestamp, arg_max(event_type, {t: timestamp, e: event_id}) AS event_type,
  arg_max(event_id, {t: timestamp, e: event_id}) AS event_id FROM domain_events GROUP BY 1""",
    DE,
)
def _(t: Tables):
    rows = t.domain_events().select(F.col("aggregate_id").alias("document_id"), "timestamp", "event_id", "event_type")
    return E.status_of_documents(rows)


# --- lineage ---

ED = ("lineage_edges",)


@query(
    "lineage_edges",
    f"""SELECT concat('fk_', constraint_name) AS relationship_id, concat('table_', source_table) AS source_asset_id,
  concat('table_', target_table) AS target_asset_id, 'direct' AS lineage_type,
  concat('Foreign key relationship: ', source_column, ' -> ', target_column) AS description FROM ({FK_EDGES})
WHERE source_table IN (SELECT concat('t_', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size <= 40)
  AND target_table IN (SELECT concat('t_', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size <= 40)""",
    ED,
)
def _(t: Tables):
    catalog = t.part.where("p_size <= 40").select(F.concat_ws("_", F.lit("t"), "p_partkey").alias("table_name"))
    return N.lineage_edges(catalog, R.fk_edges(*constraint_tables(t)))


@query(
    "neighbors",
    """WITH hub AS (SELECT src AS h FROM lineage_edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
---
SELECT 'upstream' AS direction, src AS asset, src, dst FROM lineage_edges, hub WHERE dst = h
UNION ALL SELECT 'downstream', dst, src, dst FROM lineage_edges, hub WHERE src = h""",
    ED,
)
def _(t: Tables):
    edges = t.lineage_edges()
    hub = edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]
    return N.neighbors(edges, hub)


_ROOTS = "SELECT DISTINCT src AS s FROM lineage_edges WHERE src NOT IN (SELECT dst FROM lineage_edges)"
_HUBS = "SELECT DISTINCT dst AS s FROM lineage_edges GROUP BY dst HAVING count(*) > 1"


def roots(t: Tables) -> DataFrame:
    edges = t.lineage_edges()
    return edges.select(F.col("src").alias("s")).distinct().join(edges.select(F.col("dst").alias("s")), "s", "left_anti")


def merges(t: Tables) -> DataFrame:
    """Assets with more than one source."""
    return t.lineage_edges().groupBy(F.col("dst").alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s")


def _closure(starts: str) -> str:
    """Both closures of a start set with shortest distances and smallest shortest paths."""
    return f"""WITH starts AS ({starts}),
e AS (SELECT DISTINCT src, dst FROM lineage_edges),
down AS (SELECT s AS start, s AS node, 0 AS d, [s] AS path FROM starts
  UNION SELECT down.start, e.dst, d + 1, list_append(path, e.dst) FROM down JOIN e ON e.src = down.node),
up AS (SELECT s AS start, s AS node, 0 AS d, [s] AS path FROM starts
  UNION SELECT up.start, e.src, d + 1, list_append(path, e.src) FROM up JOIN e ON e.dst = up.node),
dn AS (SELECT start, node, min(d) AS distance, arg_min(path, {{d: d, p: path}}) AS path FROM down WHERE d > 0 GROUP BY 1, 2),
un AS (SELECT start, node, min(d) AS distance, list_reverse(arg_min(path, {{d: d, p: path}})) AS path FROM up WHERE d > 0 GROUP BY 1, 2),
both_ways AS (SELECT 'downstream' AS direction, * FROM dn UNION ALL SELECT 'upstream', * FROM un)
---
"""


@query(
    "reachable",
    _closure(_ROOTS) + "SELECT start, node, distance FROM dn",
    ED,
)
def _(t: Tables):
    return N.reachable(t.lineage_edges(), roots(t))


@query("reachable_upstream", _closure(_HUBS) + "SELECT start, node, distance FROM un", ED)
def _(t: Tables):
    return N.reachable(t.lineage_edges(), merges(t), "upstream")


@query(
    "data_flow",
    _closure(_ROOTS)
    + """SELECT distance AS path_length, i AS step, path[i] AS src, path[i + 1] AS dst
FROM (SELECT distance, path, unnest(range(1, distance + 1)) AS i FROM dn WHERE start = (SELECT min(s) FROM starts) AND node = (SELECT max(dst) FROM e))""",
    ED,
)
def _(t: Tables):
    edges = t.lineage_edges()
    last = edges.agg(F.max("dst")).first()[0]
    return N.data_flow(edges, roots(t).agg(F.min("s")).first()[0], last)


@query(
    "lineage_depth",
    _closure(_HUBS) + "SELECT s AS start, CAST(coalesce(max(distance), 0) AS INT) AS lineage_depth FROM starts LEFT JOIN both_ways ON start = s GROUP BY 1",
    ED,
)
def _(t: Tables):
    return N.lineage_depth(t.lineage_edges(), merges(t))


@query(
    "impact_score",
    _closure(_HUBS)
    + "SELECT s AS start, least(count(node) / CAST((SELECT count(*) FROM assets) AS DOUBLE), 1) AS impact_score FROM starts LEFT JOIN both_ways ON start = s GROUP BY 1",
    ("lineage_edges", "assets"),
    floats=("impact_score",),
)
def _(t: Tables):
    return N.impact_score(t.lineage_edges(), merges(t), t.assets())


@query(
    "impact_analysis",
    _closure(_HUBS)
    + """SELECT s AS start, count(*) FILTER (direction = 'downstream') AS total_downstream_assets, count(*) FILTER (direction = 'upstream') AS total_upstream_assets,
  coalesce(max(distance) FILTER (direction = 'downstream'), 0) AS max_downstream_depth, coalesce(max(distance) FILTER (direction = 'upstream'), 0) AS max_upstream_depth,
  count(node) AS total_impact_score FROM starts LEFT JOIN both_ways ON start = s GROUP BY 1""",
    ED,
)
def _(t: Tables):
    return N.impact_analysis(t.lineage_edges(), merges(t))


@query(
    "critical_paths",
    _closure(_HUBS) + "SELECT direction, start, node, distance, array_to_string(path, '>') AS path FROM both_ways",
    ED,
)
def _(t: Tables):
    rows = N.critical_paths(t.lineage_edges(), merges(t))
    return rows.select("direction", "start", "node", "distance", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    "graph_export",
    """WITH t AS (SELECT (SELECT count(*) FROM assets) AS total_nodes, (SELECT count(*) FROM lineage_edges) AS total_edges)
---
SELECT 'node' AS kind, CAST(asset_id AS VARCHAR) AS id, name AS label, asset_type AS type, owner, quality_score, CAST(NULL AS VARCHAR) AS source,
  CAST(NULL AS VARCHAR) AS target, t.* FROM assets, t
UNION ALL SELECT 'edge', concat(CAST(src AS VARCHAR), '-', CAST(dst AS VARCHAR)), NULL, 'direct', NULL, NULL, CAST(src AS VARCHAR), CAST(dst AS VARCHAR), t.* FROM lineage_edges, t""",
    ("assets", "lineage_edges"),
    floats=("quality_score",),
)
def _(t: Tables):
    return N.graph_export(t.assets(), t.lineage_edges())


# --- experiments ---

_ALLOCATION = {"control": 0.4, "treatment": 0.4, "second": 0.1}
_AUDIENCE = {"user_attributes": {"segment": "BUILDING"}, "geographic": ["1", "2", "3", "5", "8", "13", "21"]}


def _hash_sql(user: str, experiment: str) -> str:
    return f"CAST(CAST('0x' || substring(md5(concat(CAST({user} AS VARCHAR), ':{experiment}')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


def _variant_sql(ratio: str) -> str:
    return f"CASE WHEN {ratio} <= 0.4 THEN 'control' WHEN {ratio} <= CAST(0.4 AS DOUBLE) + 0.4 THEN 'treatment' WHEN {ratio} <= CAST(0.4 AS DOUBLE) + 0.4 + 0.1 THEN 'second' ELSE 'control' END"


def audience_users(t: Tables) -> DataFrame:
    return t.users().select(
        F.col("id").alias("user_id"), "segment", F.col("nation").cast("string").alias("location")
    )


@query("eligible", "SELECT id AS user_id, segment, CAST(nation AS VARCHAR) AS location FROM users WHERE segment = 'BUILDING' AND nation IN (1, 2, 3, 5, 8, 13, 21)", ("users",))
def _(t: Tables):
    return B.eligible(audience_users(t), _AUDIENCE)


@query(
    "assign_variants",
    f"SELECT id AS user_id, {_variant_sql(_hash_sql('id', 'layout'))} AS variant FROM users",
    ("users",),
)
def _(t: Tables):
    return B.assign_variants(audience_users(t).select("user_id"), "layout", _ALLOCATION)


@query(
    "assign_variants_audience",
    f"""SELECT id AS user_id, CASE WHEN segment = 'BUILDING' AND nation IN (1, 2, 3, 5, 8, 13, 21) THEN {_variant_sql(_hash_sql('id', 'layout'))} ELSE 'control' END
  AS variant FROM users""",
    ("users",),
)
def _(t: Tables):
    return B.assign_variants(audience_users(t), "layout", _ALLOCATION, _AUDIENCE).select("user_id", "variant")


VIEWS["experiment_events"] = (
    (),
    f"""SELECT event_type AS metric, user_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value, {_variant_sql('ratio')} AS variant
FROM (SELECT *, {_hash_sql('user_id', 'layout')} AS ratio FROM events)""",
)


def experiment_events(t: Tables) -> DataFrame:
    people = t.events.select("user_id").distinct()
    assigned = B.assign_variants(people, "layout", _ALLOCATION)
    value = F.when(F.col("event_id") % 50 != 0, F.col("value"))
    rows = t.events.select(F.col("event_type").alias("metric"), "user_id", value.alias("value"))
    return R.attach_variant(rows, assigned)


@query("attach_variant", "SELECT metric, user_id, value, variant FROM experiment_events", ("experiment_events",), floats=("value",))
def _(t: Tables):
    return experiment_events(t)


VIEWS["variants"] = (
    ("experiment_events",),
    """SELECT metric, variant, count(*) AS n, avg(coalesce(value, 0)) AS mean, stddev_pop(coalesce(value, 0)) AS std, quantile_cont(coalesce(value, 0), 0.5) AS median
FROM experiment_events GROUP BY 1, 2""",
)


@query("variant_stats", "SELECT * FROM variants", ("variants",), floats=("mean", "std", "median"))
def _(t: Tables):
    return B.variant_stats(experiment_events(t))


@query("confidence_interval")
def _(t: Tables):
    return B.confidence_interval(B.variant_stats(experiment_events(t)))


@query(
    "effect_size",
    """SELECT c.metric, (t.mean - c.mean) / sqrt(((c.n - 1) * c.std * c.std + (t.n - 1) * t.std * t.std) / (c.n + t.n - 2)) AS effect_size
FROM variants c JOIN variants t ON t.metric = c.metric WHERE c.variant = 'control' AND t.variant = 'treatment'""",
    ("variants",),
    floats=("effect_size",),
)
def _(t: Tables):
    return B.effect_size(B.variant_stats(experiment_events(t)))


@query("significance")
def _(t: Tables):
    return B.significance(experiment_events(t))


@query("experiment_report")
def _(t: Tables):
    return B.experiment_report(experiment_events(t))


@query(
    "rank_sums",
    """WITH e AS (SELECT metric, variant, coalesce(value, 0) AS v FROM experiment_events WHERE variant IN ('control', 'treatment')),
c AS (SELECT metric, v, count(*) AS n, count(*) FILTER (variant = 'control') AS c FROM e GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY v) - n + (n + 1) / CAST(2 AS DOUBLE) AS rank FROM c)
---
SELECT metric, sum(c * rank) AS r1, CAST(sum(c) AS BIGINT) AS n1, CAST(sum(n - c) AS BIGINT) AS n2, CAST(sum(n * n * n - n) AS DOUBLE) AS ties FROM r GROUP BY 1""",
    ("experiment_events",),
    floats=("r1:2", "ties:2"),
)
def _(t: Tables):
    return B._rank_sums(experiment_events(t), "control", "treatment")


# --- migration ---

VIEWS["source_columns"] = (
    (),
    """SELECT concat('t', CAST(l_partkey AS VARCHAR)) AS table_name, concat('c', CAST(l_orderkey AS VARCHAR), '_', CAST(l_linenumber AS VARCHAR)) AS column_name,
  CASE l_orderkey % 12 WHEN 0 THEN 'varchar' WHEN 1 THEN 'CHAR' WHEN 2 THEN 'NUMERIC' WHEN 3 THEN 'DOUBLE PRECISION' WHEN 4 THEN 'MONEY' WHEN 5 THEN 'TIMESTAMPTZ'
    WHEN 6 THEN 'JSONB' WHEN 7 THEN 'UUID' WHEN 8 THEN 'INTERVAL' WHEN 9 THEN 'BYTEA' WHEN 10 THEN 'POINT' ELSE 'DECIMAL' END AS data_type,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS INT) END AS length, CASE WHEN l_linenumber % 3 = 0 THEN 12 END AS precision,
  CASE WHEN l_linenumber % 3 = 0 THEN 4 END AS scale FROM lineitem""",
)


def source_columns(t: Tables) -> DataFrame:
    """Column metadata derived from the line items: one table per part, one column per line."""
    kinds = ["varchar", "CHAR", "NUMERIC", "DOUBLE PRECISION", "MONEY", "TIMESTAMPTZ", "JSONB", "UUID", "INTERVAL", "BYTEA", "POINT", "DECIMAL"]
    line = F.col("l_linenumber")
    return t.lineitem.select(
        F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("table_name"),
        F.concat(F.lit("c"), F.concat_ws("_", "l_orderkey", "l_linenumber")).alias("column_name"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_orderkey") % 12 + 1).cast("int")).alias("data_type"),
        F.when(line % 2 == 0, F.col("l_quantity").cast("int")).alias("length"),
        F.when(line % 3 == 0, 12).alias("precision"),
        F.when(line % 3 == 0, 4).alias("scale"),
    )


@query(
    "schema_inventory",
    """WITH c AS (SELECT table_name, count(*) AS n FROM source_columns GROUP BY 1),
t AS (SELECT concat('t', CAST(p_partkey AS VARCHAR)) AS table_name, CAST(p_size AS BIGINT) * 100 AS row_count, CAST(p_size AS DOUBLE) * 512 AS size_kb FROM part),
j AS (SELECT t.table_name, coalesce(n, 0) AS column_count, row_count, size_kb / 1024 AS size_mb FROM t LEFT JOIN c ON c.table_name = t.table_name)
---
SELECT table_name, 1 AS tables, column_count, row_count, size_mb, size_mb * CAST(0.1 AS DOUBLE) AS estimated_minutes FROM j
UNION ALL SELECT NULL, count(*), CAST(sum(column_count) AS BIGINT), CAST(sum(row_count) AS BIGINT), sum(size_mb), floor(sum(size_mb) * CAST(0.1 AS DOUBLE)) FROM j""",
    ("source_columns",),
    floats=("size_mb", "estimated_minutes"),
)
def _(t: Tables):
    size = F.col("p_size")
    tables = t.part.select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table_name"),
        (size.cast("bigint") * 100).alias("row_count"),
        (size.cast("double") * 512).alias("size_kb"),
    )
    return Z.schema_inventory(tables, source_columns(t))


@query(
    "map_types",
    """SELECT *, CASE upper(data_type) WHEN 'VARCHAR' THEN concat('NVARCHAR(', coalesce(CAST(length AS VARCHAR), '255'), ')') WHEN 'CHAR' THEN concat('NCHAR(', coalesce(CAST(length AS VARCHAR), '1'), ')')
  WHEN 'NUMERIC' THEN CASE WHEN precision IS NULL THEN 'NUMERIC(18,2)' ELSE 'NUMERIC(12,4)' END WHEN 'DECIMAL' THEN CASE WHEN precision IS NULL THEN 'DECIMAL(18,2)' ELSE 'DECIMAL(12,4)' END
  WHEN 'DOUBLE PRECISION' THEN 'FLOAT' WHEN 'MONEY' THEN 'DECIMAL(19,4)' WHEN 'TIMESTAMPTZ' THEN 'DATETIMEOFFSET' WHEN 'JSONB' THEN 'NVARCHAR(MAX)' WHEN 'UUID' THEN 'UNIQUEIDENTIFIER'
  WHEN 'INTERVAL' THEN 'NVARCHAR(50)' WHEN 'BYTEA' THEN 'VARBINARY(MAX)' ELSE 'NVARCHAR(MAX)' END AS target_type FROM source_columns""",
    ("source_columns",),
)
def _(t: Tables):
    return Z.map_types(source_columns(t), "postgresql")


_EVENT_COLUMNS = {"event_id": "BIGINT", "ts": "TIMESTAMP", "user_id": "INTEGER", "event_type": "VARCHAR", "value": "DECIMAL", "props": "JSON"}


@query(
    "copy_table",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS ts, user_id, event_type, value, props FROM events""",
    floats=("value",),
)
def _(t: Tables):
    return Z.copy_table(t.events, _EVENT_COLUMNS)


@query(
    "copy_table_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice, o_orderpriority FROM orders""",
    floats=("o_totalprice:4",),
)
def _(t: Tables):
    return Z.copy_table(
        t.orders, {"o_orderkey": "INTEGER", "o_orderdate": "DATE", "o_totalprice": "NUMERIC", "o_orderpriority": "CHAR"}
    )


@query(
    "reconcile",
    """SELECT 'orders' AS table_name, count(*) AS total_rows, count(*) AS migrated_rows, CAST(100 AS DOUBLE) AS progress_percentage, true AS identical FROM orders
UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_custkey % 5 <> 0), count(*) FILTER (c_custkey % 5 <> 0) * CAST(100 AS DOUBLE) / count(*), false FROM customer""",
    floats=("progress_percentage",),
)
def _(t: Tables):
    return Z.reconcile(
        {"orders": (t.orders, t.orders.select("*")), "customer": (t.customer, t.customer.where("c_custkey % 5 <> 0"))}
    )


@query(
    "migrate_and_reconcile",
    """SELECT 'events' AS table_name, count(*) AS total_rows, count(*) AS migrated_rows, CAST(100 AS DOUBLE) AS progress_percentage, true AS identical FROM events
UNION ALL SELECT 'events_changed', count(*), count(*), 100, false FROM events
UNION ALL SELECT 'events_short', count(*), count(*) FILTER (event_id % 5 <> 0), count(*) FILTER (event_id % 5 <> 0) * CAST(100 AS DOUBLE) / count(*), false FROM events""",
    floats=("progress_percentage",),
)
def _(t: Tables):
    """The right copy of the events, one with a changed value, and one with rows missing."""
    converted = Z.copy_table(t.events, _EVENT_COLUMNS)
    folder = f"{ensure_checkpoint_dir(t.spark)}/migrated-{uuid.uuid4().hex}"
    target, report = Z.migrate_and_reconcile(t.events, _EVENT_COLUMNS, "events", folder)
    changed = target.withColumn("value", F.when(F.col("event_id") == 7, -1.0).otherwise(F.col("value")))
    short = target.where("event_id % 5 <> 0")
    return report.unionByName(Z.reconcile({"events_changed": (converted, changed), "events_short": (converted, short)}))
