"""Projections, filters, joins, paging and top-k over document tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.functions.columns import ago, as_bigint, instant, strip
from inkstream.functions.distributed import number_rows, skew_left_join

#: Time-range labels and their lengths (fixed values).
RANGES = {"1h": "1 HOUR", "24h": "1 DAY", "7d": "7 DAY", "30d": "30 DAY"}

# Size classes in bytes, user tiers by document count.
SMALL_BYTES, MEDIUM_BYTES = 1_024_000, 10_485_760
BASIC_DOCUMENTS, ACTIVE_DOCUMENTS, RECENT_USER_DAYS = 10, 50, 30


# --- filters and projections ---


def time_range(df: DataFrame, ts: str, label: str, as_of=None, default: str = "1h") -> DataFrame:
    """Rows not older than the labelled range; an unknown label means ``default``."""
    return df.where(F.col(ts) >= ago(instant(as_of), RANGES.get(label, RANGES[default])))


def clean(
    df: DataFrame,
    clean_columns: Sequence[str] = (),
    required: Sequence[str] = (),
    dtypes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Trim text, drop rows with a NULL in a required column, cast (a failed cast is NULL).

    Configured columns the table does not have are skipped.
    """
    has = set(df.columns)
    out = df.withColumns({c: strip(F.col(c).cast("string")) for c in clean_columns if c in has})
    need = [c for c in required if c in has]
    if need:
        out = out.dropna(subset=need)
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in (dtypes or {}).items() if c in has})


def enrich(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Computed columns from SQL expressions."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def enrich_documents(df: DataFrame) -> DataFrame:
    kind, size = F.col("content_type"), F.col("file_size")
    return df.withColumns(
        {
            "file_extension": F.element_at(F.split("file_name", "[.]"), -1),
            "file_category": F.when(kind.contains("pdf"), "document")
            .when(kind.contains("image"), "image")
            .otherwise("other"),
            "size_category": F.when(size < SMALL_BYTES, "small")
            .when(size < MEDIUM_BYTES, "medium")
            .otherwise("large"),
        }
    )


def enrich_users(df: DataFrame, as_of=None) -> DataFrame:
    n, days = F.col("document_count"), F.datediff(instant(as_of), "created_at")
    return df.withColumns(
        {
            "user_tier": F.when(n == 0, "new")
            .when(n < BASIC_DOCUMENTS, "basic")
            .when(n < ACTIVE_DOCUMENTS, "active")
            .otherwise("power"),
            "days_since_created": as_bigint(days),
            "is_recent_user": F.when(days < RECENT_USER_DAYS, 1).otherwise(0).cast("bigint"),
        }
    )


def query_table(
    df: DataFrame,
    where: str | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """WHERE, column list and an ordered row limit (by the first column)."""
    out = df.where(where) if where else df
    if columns:
        out = out.select(*columns)
    return out.orderBy(out.columns[0]).limit(limit) if limit is not None else out


def list_page(
    df: DataFrame,
    filters: Mapping[str, object],
    order: str,
    key: str,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Rows matching all equality filters, newest first, one page, with the total count."""
    hits = df
    for name, value in filters.items():
        if value is not None:
            hits = hits.where(F.col(name) == value)
    total = hits.select(F.count(F.lit(1))).scalar()
    page = hits.orderBy(F.desc(order), key).offset(offset).limit(limit)
    return page.withColumn("total", total)


def search_assets(df: DataFrame, text: str, asset_type: str | None = None) -> DataFrame:
    """Case-insensitive substring search; ``relevance`` 0 is a name hit, 1 description, 2 tag."""
    needle = text.lower()
    name = F.lower("name").contains(needle)
    about = F.coalesce(F.lower("description").contains(needle), F.lit(False))
    tag = F.coalesce(F.exists("tags", lambda x: F.lower(x).contains(needle)), F.lit(False))
    rows = df.where(F.col("asset_type") == asset_type) if asset_type else df
    return (
        rows.where(name | about | tag)
        .withColumn("relevance", F.when(name, 0).when(about, 1).otherwise(2))
        .orderBy("relevance", ~about, ~tag, "asset_id")
    )


def metrics_since(df: DataFrame, name: str, hours: int, as_of=None) -> DataFrame:
    recent = F.col("metric_timestamp") >= ago(instant(as_of), f"{int(hours)} HOUR")
    return df.where((F.col("metric_name") == name) & recent).orderBy(F.desc("metric_timestamp"))


def active_alerts(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "active").orderBy(F.desc("created_at"))


def acknowledge(df: DataFrame, alert_id: object, user: str) -> DataFrame:
    """Mark one alert as acknowledged by ``user``."""
    hit = F.col("id") == F.lit(alert_id)
    by = F.col("acknowledged_by") if "acknowledged_by" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "status": F.when(hit, "acknowledged").otherwise(F.col("status")),
            "acknowledged_by": F.when(hit, user).otherwise(by),
        }
    )


# --- joins ---


def documents_with_results(docs: DataFrame, results: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents with their processing results; documents without one are kept."""
    return skew_left_join(docs, results, [key])


def documents_with_invoice(docs: DataFrame, invoices: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents with extracted invoice fields; clashing column names get ``invoice_``."""
    clash = {c: f"invoice_{c}" for c in invoices.columns if c in docs.columns and c != key}
    return skew_left_join(docs, invoices.withColumnsRenamed(clash), [key])


def user_document_counts(users: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents per user, zero kept.  Counting before the join removes any hot user."""
    counts = docs.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("id").alias("document_count"))
    joined = users.join(counts, users["id"] == counts["user_id"], "left").drop("user_id")
    return joined.withColumn("document_count", F.coalesce("document_count", F.lit(0).cast("bigint")))


def entities_with_documents(
    entities: DataFrame,
    docs: DataFrame,
    entity_type: str | None = None,
    order: str = "extracted_at",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of entities joined to their documents, newest first."""
    rows = entities.where(F.col("entity_type") == entity_type) if entity_type else entities
    joined = rows.join(docs, "document_id")
    return joined.orderBy(F.desc(order), "document_id", "entity_type").offset(offset).limit(limit)


def document_with_entities(
    docs: DataFrame, entities: DataFrame, order: Sequence[str], key: str = "document_id"
) -> DataFrame:
    """One row per document and entity in long form, at every size.

    ``ordinal`` counts a document's entities from 1 in ``order`` and ``n_entities`` is their
    number; a document without any has one row with NULLs and 0.  Positions come from
    distributed ranks and the join is split, so no task holds all entities of a document.
    """
    numbered = number_rows(entities, [key], order, "ordinal").withColumnRenamed("ordinal_total", "n_entities")
    joined = skew_left_join(docs, numbered, [key])
    return joined.withColumn("n_entities", F.coalesce("n_entities", F.lit(0).cast("bigint")))


def requested_document(docs: DataFrame, entities: DataFrame, document: object, key: str = "document_id") -> DataFrame:
    """One requested document with its entities as a sorted array, empty if there are none."""
    item = F.struct(*[c for c in entities.columns if c != key])
    own = entities.where(F.col(key) == document).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("entities"))
    found = docs.where(F.col(key) == document).join(own, key, "left")
    return found.withColumn("entities", F.coalesce("entities", F.array()))


def holdout_documents(docs: DataFrame, used: DataFrame, key: str, order: str, n: int = 200) -> DataFrame:
    """Newest ``n`` documents that were not used before."""
    fresh = docs.join(used.select(key), key, "left_anti")
    return fresh.orderBy(F.desc(order), key).limit(n)


def fk_edges(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Source and target column of every foreign key.

    ``constraints(constraint_name, unique_constraint_name)`` and
    ``key_columns(constraint_name, table_name, column_name, ordinal_position)``.
    """
    src = key_columns.select(
        "constraint_name",
        F.col("table_name").alias("source_table"),
        F.col("column_name").alias("source_column"),
        "ordinal_position",
    )
    dst = key_columns.select(
        F.col("constraint_name").alias("unique_constraint_name"),
        F.col("table_name").alias("target_table"),
        F.col("column_name").alias("target_column"),
        "ordinal_position",
    )
    return (
        constraints.join(src, "constraint_name")
        .join(dst, ["unique_constraint_name", "ordinal_position"])
        .select("constraint_name", "source_table", "source_column", "target_table", "target_column")
    )


def field_match(
    predicted: DataFrame, truth: DataFrame, keys: Sequence[str] = ("document_id", "field")
) -> DataFrame:
    """Every true field with whether it was extracted and whether the value matches.

    Both inputs have ``text_value`` and ``number_value``, one of them filled.  Text compares
    trimmed and case-blind, numbers within 0.01 (fixed value).
    """
    pred = predicted.select(
        *keys,
        F.col("text_value").alias("predicted_text"),
        F.col("number_value").alias("predicted_number"),
        F.lit(True).alias("extracted"),
    )
    joined = truth.join(pred, list(keys), "left")
    number = F.abs(F.col("predicted_number") - F.col("number_value")) < 0.01
    text = F.lower(strip(F.col("predicted_text"))) == F.lower(strip(F.col("text_value")))
    same = F.when(F.col("number_value").isNotNull(), number).otherwise(text)
    return joined.select(
        *keys,
        "text_value",
        "number_value",
        "predicted_text",
        "predicted_number",
        F.coalesce("extracted", F.lit(False)).alias("extracted"),
        F.coalesce(same, F.lit(False)).alias("matched"),
    )


def attach_variant(events: DataFrame, assignments: DataFrame, key: str = "user_id") -> DataFrame:
    """Events of assigned users with their variant (assignments are unique per user)."""
    return events.join(assignments.select(key, "variant"), key)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert or update on key; of several updates to a key the last in ``order`` wins."""
    payload = [c for c in target.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_new"))
    old = target.select(*keys, F.struct(*payload).alias("_old"))
    merged = old.join(last, list(keys), "full_outer")
    row = F.coalesce("_new", "_old")
    return merged.select(*keys, *[row[c].alias(c) for c in payload]).select(*target.columns)


# --- limits and top-k ---


def latest_for_user(df: DataFrame, user: object, n: int, ts: str = "created_at", key: str = "id") -> DataFrame:
    return df.where(F.col("user_id") == user).orderBy(F.desc(ts), key).limit(n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of every key in ``order``.

    ``row_number() <= n`` becomes a group limit ahead of the shuffle, so even a very large
    key ships at most ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def slowest(df: DataFrame, value: str, text: str, key: str, n: int = 10, width: int = 200) -> DataFrame:
    """The ``n`` slowest rows, their text cut to ``width`` characters for display."""
    top = df.orderBy(F.desc(value), key).limit(n)
    return top.withColumn(text, F.substring(text, 1, width))


def top_predictions(
    df: DataFrame, n: int = 3, probability: str = "probability", labels: str = "labels"
) -> DataFrame:
    """The ``n`` most probable classes per row as an array of (probability, label)."""
    pairs = F.arrays_zip(F.col(probability).alias("probability"), F.col(labels).alias("label"))
    best = F.slice(F.sort_array(pairs, asc=False), 1, n)
    return df.withColumn("top_predictions", best)


def evaluations_latest(df: DataFrame, model: str, n: int, ts: str = "created_at", key: str = "id") -> DataFrame:
    return df.where(F.col("model_name") == model).orderBy(F.desc(ts), key).limit(n)


def training_curve(df: DataFrame, job: object) -> DataFrame:
    return df.where(F.col("job_id") == job).orderBy("step")
