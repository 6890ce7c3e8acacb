"""Sources, filters, joins, paging and top-k over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.operators import relational as R
from inkstream.plans.registry import query
from inkstream.sources.tables import read_table
from inkstream.sources.views import AS_OF, Tables

NOW = f"TIMESTAMP '{AS_OF}'"


@query("read_table", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem", floats=("l_quantity",))
def _(t: Tables):
    return read_table(t.spark, f"{t.folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")


def _updates(t: Tables) -> DataFrame:
    """Two updates for some customers and one insert per nation, newest last."""
    c = t.customer
    first = c.where("c_custkey % 3 = 0").selectExpr(
        "c_custkey", "'first' AS c_mktsegment", "c_acctbal + 1 AS c_acctbal", "1 AS seq"
    )
    second = c.where("c_custkey % 6 = 0").selectExpr(
        "c_custkey", "'second' AS c_mktsegment", "c_acctbal + 2 AS c_acctbal", "2 AS seq"
    )
    new = t.nation.selectExpr(
        "CAST(-1 - n_nationkey AS BIGINT) AS c_custkey", "n_name AS c_mktsegment",
        "CAST(0 AS DOUBLE) AS c_acctbal", "1 AS seq",
    )
    return first.unionByName(second).unionByName(new)


@query(
    "upsert",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'second' WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_mktsegment
  END AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 2 WHEN c_custkey % 3 = 0 THEN c_acctbal + 1
  ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT CAST(-1 - n_nationkey AS BIGINT), n_name, CAST(0 AS DOUBLE) FROM nation""",
    floats=("c_acctbal:4",),
)
def _(t: Tables):
    target = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return R.upsert(target, _updates(t), ["c_custkey"], ["seq"])


def _range(label: str, width: str):
    @query(
        f"time_range_{label}",
        f"SELECT document_id, event_time FROM doc_events WHERE event_time >= {NOW} - INTERVAL {width}",
        ("doc_events",),
    )
    def _(t: Tables):
        return R.time_range(t.doc_events(), "event_time", label, AS_OF).select("document_id", "event_time")


for _label, _width in (("1h", "1 HOUR"), ("24h", "24 HOUR"), ("7d", "7 DAY"), ("30d", "30 DAY"), ("unknown", "1 HOUR")):
    _range(_label, _width)


_STAGED = "file_name IS NOT NULL AND user_id IS NOT NULL"
_NAME = "trim(file_name)"


@query(
    "clean",
    f"""SELECT document_id, user_id, {_NAME} AS file_name, CAST(file_size AS DOUBLE) AS file_size, content_type, created_at
FROM files WHERE {_STAGED}""",
    ("files",),
    floats=("file_size",),
)
def _(t: Tables):
    cols = ["document_id", "user_id", "file_name", "file_size", "content_type", "created_at"]
    return R.clean(
        t.files().select(*cols),
        ["file_name", "content_type"],
        ["document_id", "user_id", "file_name"],
        {"file_size": "double", "created_at": "timestamp_ntz"},
    )


@query(
    "clean_failed_cast",
    "SELECT event_id, props, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events",
)
def _(t: Tables):
    rows = t.events.select(
        "event_id", "props", F.regexp_extract("props", "([0-9]+)", 1).alias("k"), F.col("event_type").alias("bad")
    )
    return R.clean(rows, ["props"], ["event_id", "props"], {"k": "bigint", "bad": "double"})


ENRICHED = f"""SELECT document_id, user_id, {_NAME} AS file_name, file_size, content_type, created_at,
  list_extract(string_split({_NAME}, '.'), -1) AS file_extension,
  CASE WHEN content_type LIKE '%pdf%' THEN 'document' WHEN content_type LIKE '%image%' THEN 'image' ELSE 'other' END
    AS file_category,
  CASE WHEN file_size < 1024000 THEN 'small' WHEN file_size < 10485760 THEN 'medium' ELSE 'large' END AS size_category
FROM files WHERE {_STAGED}"""


def enriched_files(t: Tables) -> DataFrame:
    cols = ["document_id", "user_id", "file_name", "file_size", "content_type", "created_at"]
    staged = R.clean(t.files().select(*cols), ["file_name", "content_type"], ["document_id", "user_id", "file_name"])
    return R.enrich_documents(staged)


@query("enrich_documents", ENRICHED, ("files",))
def _(t: Tables):
    return enriched_files(t)


@query(
    "enrich_users",
    f"""SELECT u.id, u.email, u.created_at, coalesce(n, 0) AS document_count,
  CASE WHEN coalesce(n, 0) = 0 THEN 'new' WHEN n < 10 THEN 'basic' WHEN n < 50 THEN 'active' ELSE 'power' END AS user_tier,
  date_diff('day', CAST(created_at AS DATE), DATE '2024-01-31') AS days_since_created,
  CAST(date_diff('day', CAST(created_at AS DATE), DATE '2024-01-31') < 30 AS BIGINT) AS is_recent_user
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM user_documents GROUP BY 1) d ON d.user_id = u.id""",
    ("users", "user_documents"),
)
def _(t: Tables):
    users = t.users().select("id", "email", "created_at")
    return R.enrich_users(R.user_document_counts(users, t.user_documents()), AS_OF)


@query(
    "enrich",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
  CASE WHEN l_quantity < 10 THEN 'few' ELSE 'many' END AS amount FROM lineitem""",
    floats=("net:4",),
)
def _(t: Tables):
    cols = {"net": "l_extendedprice * (1 - l_discount)", "amount": "CASE WHEN l_quantity < 10 THEN 'few' ELSE 'many' END"}
    return R.enrich(t.lineitem, cols).select("l_orderkey", "l_linenumber", "net", "amount")


@query(
    "query_table",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
ORDER BY o_orderkey LIMIT 100""",
    floats=("o_totalprice:4",),
)
def _(t: Tables):
    return R.query_table(
        t.orders, "o_orderstatus = 'F' AND o_totalprice > 100000", ["o_orderkey", "o_custkey", "o_totalprice"], 100
    )


@query(
    "list_page",
    """WITH h AS (SELECT document_id, status, created_at FROM files WHERE status = 'completed')
---
SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY created_at DESC, document_id LIMIT 50 OFFSET 50""",
    ("files",),
)
def _(t: Tables):
    rows = t.files().select("document_id", "status", "created_at")
    return R.list_page(rows, {"status": "completed", "document_id": None}, "created_at", "document_id", 50, 50)


@query(
    "search_assets",
    """SELECT asset_id, name, description, CASE WHEN contains(lower(name), 'small') THEN 0
  WHEN contains(lower(description), 'small') THEN 1 ELSE 2 END AS relevance FROM assets
WHERE contains(lower(name), 'small') OR contains(lower(description), 'small')
  OR contains(array_to_string(tags, chr(1)), 'small')""",
    ("assets",),
)
def _(t: Tables):
    return R.search_assets(t.assets(), "Small").select("asset_id", "name", "description", "relevance")


@query(
    "metrics_since",
    f"""SELECT id, metric_name, metric_value, metric_timestamp FROM metrics
WHERE metric_name = 'error' AND metric_timestamp >= {NOW} - INTERVAL 240 HOUR""",
    ("metrics",),
    floats=("metric_value",),
)
def _(t: Tables):
    return R.metrics_since(t.metrics(), "error", 240, AS_OF)


_ALERT_ROWS = """SELECT event_id AS id, event_type AS rule_name, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'active' END
  AS status, value AS current_value, ts AS created_at FROM events WHERE event_type = 'error'"""


def alert_rows(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").selectExpr(
        "event_id AS id", "event_type AS rule_name",
        "CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'active' END AS status",
        "value AS current_value", "ts AS created_at",
    )


@query("active_alerts", f"SELECT * FROM ({_ALERT_ROWS}) WHERE status = 'active'", floats=("current_value",))
def _(t: Tables):
    return R.active_alerts(alert_rows(t))


@query(
    "acknowledge",
    f"""WITH a AS ({_ALERT_ROWS}), newest AS (SELECT max(id) AS id FROM a)
---
SELECT a.id, rule_name, CASE WHEN a.id = n.id THEN 'acknowledged' ELSE status END AS status, current_value, created_at,
  CASE WHEN a.id = n.id THEN 'operator' END AS acknowledged_by FROM a, newest n""",
    floats=("current_value",),
)
def _(t: Tables):
    rows = alert_rows(t)
    newest = rows.agg(F.max("id")).first()[0]
    return R.acknowledge(rows, newest, "operator")


# --- joins ---


@query(
    "documents_with_results",
    """SELECT d.doc_id AS document_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(t: Tables):
    docs = t.documents.selectExpr("doc_id AS document_id", "lang", "n_chars")
    return R.documents_with_results(docs, t.labels.withColumnRenamed("doc_id", "document_id"))


@query(
    "documents_with_results_hot_key",
    """SELECT c.c_custkey AS user_id, c.c_mktsegment, o.id, o.status FROM customer c LEFT JOIN
  (SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE user_id END AS user_id, status FROM user_documents) o ON o.user_id = c.c_custkey""",
    ("user_documents",),
)
def _(t: Tables):
    docs = t.user_documents().select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("user_id")).alias("user_id"), "status"
    )
    users = t.customer.selectExpr("c_custkey AS user_id", "c_mktsegment")
    return R.documents_with_results(users, docs, "user_id")


@query(
    "documents_with_invoice",
    """SELECT d.id AS document_id, d.status, i.invoice_number, i.vendor_name, i.customer_name, i.invoice_date, i.due_date,
  i.total_amount, i.subtotal, i.tax_amount, i.created_at AS invoice_created_at, d.created_at
FROM user_documents d LEFT JOIN invoices i ON i.document_id = d.id""",
    ("user_documents", "invoices"),
    floats=("total_amount:4", "subtotal:4", "tax_amount:7"),
)
def _(t: Tables):
    docs = t.user_documents().selectExpr("id AS document_id", "status", "created_at")
    inv = t.invoices().drop("confidence", "is_valid", "model_name", "line_count")
    return R.documents_with_invoice(docs, inv)


@query(
    "user_document_counts",
    """SELECT u.id, u.email, count(d.id) AS document_count FROM users u LEFT JOIN user_documents d ON d.user_id = u.id
GROUP BY 1, 2""",
    ("users", "user_documents"),
)
def _(t: Tables):
    return R.user_document_counts(t.users().select("id", "email"), t.user_documents())


@query(
    "entities_with_documents",
    """SELECT e.document_id, e.entity_type, e.entity_confidence, e.event_time AS extracted_at, f.file_name, f.content_type
FROM doc_entities e JOIN files f ON f.document_id = e.document_id WHERE e.entity_type = 'person'
ORDER BY extracted_at DESC, e.document_id, entity_type LIMIT 50 OFFSET 25""",
    ("doc_entities", "files"),
    floats=("entity_confidence",),
)
def _(t: Tables):
    ent = t.doc_entities().select(
        "document_id", "entity_type", "entity_confidence", F.col("event_time").alias("extracted_at")
    )
    docs = t.files().select("document_id", "file_name", "content_type")
    return R.entities_with_documents(ent, docs, "person", limit=50, offset=25)


@query(
    "document_with_entities",
    """SELECT f.document_id, f.status, e.entity_type, e.entity_confidence, e.ordinal, coalesce(e.n, 0) AS n_entities FROM files f LEFT JOIN
  (SELECT *, count(*) OVER (PARTITION BY document_id) AS n, row_number() OVER (PARTITION BY document_id ORDER BY entity_type, entity_confidence) AS ordinal
   FROM doc_entities) e ON e.document_id = f.document_id""",
    ("files", "doc_entities"),
    floats=("entity_confidence",),
)
def _(t: Tables):
    ent = t.doc_entities().select("document_id", "entity_type", "entity_confidence")
    return R.document_with_entities(
        t.files().select("document_id", "status"), ent, ["entity_type", "entity_confidence"]
    )


@query(
    "holdout_documents",
    """SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 200""",
)
def _(t: Tables):
    return R.holdout_documents(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id", "n_chars", 200)


def constraint_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Constraint metadata derived from the lineage edges: every edge is a foreign key."""
    edges = t.lineage_edges()
    fk = F.concat_ws("_", F.lit("fk"), "dst", "src")
    pk = F.concat_ws("_", F.lit("pk"), "src")
    rc = edges.select(fk.alias("constraint_name"), pk.alias("unique_constraint_name"))

    def column(name: Column, table: str, col: str) -> list[Column]:
        return [
            name.alias("constraint_name"),
            F.concat_ws("_", F.lit("t"), table).alias("table_name"),
            F.lit(col).alias("column_name"),
            F.lit(1).alias("ordinal_position"),
        ]

    child = edges.select(*column(fk, "dst", "parent_id"))
    parent = edges.select(*column(pk, "src", "id")).distinct()
    return rc, child.unionByName(parent)


FK_EDGES = """SELECT concat('fk_', CAST(dst AS VARCHAR), '_', CAST(src AS VARCHAR)) AS constraint_name,
  concat('t_', CAST(dst AS VARCHAR)) AS source_table, 'parent_id' AS source_column,
  concat('t_', CAST(src AS VARCHAR)) AS target_table, 'id' AS target_column FROM lineage_edges"""


@query("fk_edges", FK_EDGES, ("lineage_edges",))
def _(t: Tables):
    return R.fk_edges(*constraint_tables(t))


def true_fields(t: Tables) -> DataFrame:
    """Long form of four invoice fields: one filled value column per row."""
    inv = t.invoices()
    none_t, none_n = F.lit(None).cast("string"), F.lit(None).cast("double")

    def field(name: str, text: Column, number: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), text.alias("text_value"), number.alias("number_value"))

    fields = F.array(
        field("vendor_name", F.col("vendor_name"), none_n),
        field("customer_name", F.col("customer_name"), none_n),
        field("total_amount", none_t, F.col("total_amount")),
        field("line_count", none_t, F.col("line_count").cast("double")),
    )
    rows = inv.select("document_id", F.inline(fields))
    return rows.where("text_value IS NOT NULL OR number_value IS NOT NULL")


def predicted_fields(t: Tables) -> DataFrame:
    """What an imperfect model extracts: blanks, case changes, small and large number errors, gaps."""
    rows, key = true_fields(t), F.col("document_id")
    text = F.when(key % 5 == 0, F.concat(F.lit("  "), F.upper("text_value"), F.lit(" "))).when(
        key % 7 == 1, F.concat("text_value", F.lit("x"))
    )
    number = F.when(key % 4 == 0, F.col("number_value") + 0.004).when(key % 9 == 2, F.col("number_value") + 1)
    return rows.select(
        "document_id", "field",
        text.otherwise(F.col("text_value")).alias("text_value"),
        number.otherwise(F.col("number_value")).alias("number_value"),
    ).where((key % 13 != 5) | (F.col("field") == "total_amount"))


FIELD_MATCH_CTES = """truth AS (SELECT * FROM (
  SELECT document_id, 'vendor_name' AS field, vendor_name AS text_value, CAST(NULL AS DOUBLE) AS number_value FROM invoices
  UNION ALL SELECT document_id, 'customer_name', customer_name, NULL FROM invoices
  UNION ALL SELECT document_id, 'total_amount', NULL, total_amount FROM invoices
  UNION ALL SELECT document_id, 'line_count', NULL, CAST(line_count AS DOUBLE) FROM invoices)
  WHERE text_value IS NOT NULL OR number_value IS NOT NULL),
pred AS (SELECT document_id, field, CASE WHEN document_id % 5 = 0 THEN '  ' || upper(text_value) || ' '
    WHEN document_id % 7 = 1 THEN text_value || 'x' ELSE text_value END AS text_value,
  CASE WHEN document_id % 4 = 0 THEN number_value + 0.004 WHEN document_id % 9 = 2 THEN number_value + 1
    ELSE number_value END AS number_value FROM truth WHERE document_id % 13 <> 5 OR field = 'total_amount'),
matches AS (SELECT t.document_id, t.field, t.text_value, t.number_value, p.text_value AS predicted_text, p.number_value AS predicted_number,
  p.document_id IS NOT NULL AS extracted, coalesce(CASE WHEN t.number_value IS NOT NULL
    THEN abs(p.number_value - t.number_value) < 0.01 ELSE lower(trim(p.text_value)) = lower(trim(t.text_value)) END, false) AS matched
  FROM truth t LEFT JOIN pred p ON p.document_id = t.document_id AND p.field = t.field)"""


@query(
    "field_match",
    f"WITH {FIELD_MATCH_CTES}\n---\nSELECT * FROM matches",
    ("invoices",),
    floats=("number_value:4", "predicted_number:4"),
)
def _(t: Tables):
    return R.field_match(predicted_fields(t), true_fields(t))


# --- limits and top-k ---


@query(
    "latest_for_user",
    """SELECT id, user_id, created_at, status FROM user_documents
WHERE user_id = (SELECT min(user_id) FROM user_documents) ORDER BY created_at DESC, id LIMIT 10""",
    ("user_documents",),
)
def _(t: Tables):
    docs = t.user_documents()
    return R.latest_for_user(docs, docs.agg(F.min("user_id")).first()[0], 10)


@query(
    "latest_per_key",
    """SELECT * FROM (SELECT id, user_id, created_at, status, CAST(row_number() OVER (PARTITION BY user_id
  ORDER BY created_at DESC, id) AS INT) AS rank FROM user_documents) WHERE rank <= 3""",
    ("user_documents",),
)
def _(t: Tables):
    return R.latest_per_key(t.user_documents(), ["user_id"], [F.desc("created_at"), F.col("id")], 3)


@query(
    "slowest",
    """SELECT doc_id, substring(text, 1, 200) AS text, n_chars FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)""",
)
def _(t: Tables):
    return R.slowest(t.documents.select("doc_id", "text", "n_chars"), "n_chars", "text", "doc_id", 10)


@query(
    "top_predictions",
    """SELECT vec_id, list_extract(o, 1) AS best, list_extract(o, 2) AS second, list_extract(o, 3) AS third FROM (
  SELECT vec_id, list_transform(list_slice(list_reverse_sort(list_zip(embedding, range(len(embedding)))), 1, 3),
    lambda x: CAST(x[2] AS INT)) AS o FROM embeddings)""",
)
def _(t: Tables):
    probs = t.embeddings.select(
        "vec_id",
        F.col("embedding").alias("probability"),
        F.sequence(F.lit(0), F.size("embedding") - 1).alias("labels"),
    )
    top = F.col("top_predictions")
    return R.top_predictions(probs, 3).select(
        "vec_id", top[0]["label"].alias("best"), top[1]["label"].alias("second"), top[2]["label"].alias("third")
    )


@query(
    "evaluations_latest",
    """SELECT document_id AS id, model_name, total_amount, created_at FROM invoices WHERE model_name = 'model-1'
ORDER BY created_at DESC, document_id LIMIT 20""",
    ("invoices",),
    floats=("total_amount:4",),
)
def _(t: Tables):
    rows = t.invoices().select(F.col("document_id").alias("id"), "model_name", "total_amount", "created_at")
    return R.evaluations_latest(rows, "model-1", 20)


@query(
    "training_curve",
    """SELECT user_id AS job_id, event_id AS step, value AS loss FROM events WHERE user_id = (SELECT min(user_id) FROM events)""",
    floats=("loss",),
)
def _(t: Tables):
    job = t.events.agg(F.min("user_id")).first()[0]
    return R.training_curve(t.events.selectExpr("user_id AS job_id", "event_id AS step", "value AS loss"), job)
