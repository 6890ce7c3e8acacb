"""Hand-computed answers, gaps, ties and empty inputs."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkstream.operators import alerts as M
from inkstream.operators import events as E
from inkstream.operators import lineage as N
from inkstream.operators import metrics as G
from inkstream.operators import migration as Z
from inkstream.operators import quality as Q
from inkstream.operators import relational as R
from inkstream.operators import scoring as A
from inkstream.operators import search as V
from inkstream.operators import textprep as X
from inkstream.operators import windows as W


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


# --- scoring: the worked example and the four documented products ---


def test_worked_invoice(rows):
    inv = rows(
        [("d", "Test Corp", "INV-001", 1000.0, 0.95, True)],
        "document_id string, vendor_name string, invoice_number string, total_amount double, confidence double, is_valid boolean",
    )
    r = one(A.automation_score(inv))
    assert r.confidence_score == pytest.approx(0.775)
    assert r.completeness_score == pytest.approx(0.42)
    assert r.automation_score == pytest.approx(0.3255)
    assert r.requires_review is True


def test_invoice_gaps(rows):
    inv = rows(
        [(" ", 0.0, None, [], None)],
        "vendor_name string, total_amount double, invoice_date date, line_items array<string>, is_valid boolean",
    ).withColumn("confidence", F.lit(None).cast("double"))
    r = one(A.automation_score(inv))
    # a blank vendor counts as present for confidence but not for completeness
    assert (r.confidence_score, r.completeness_score, r.validation_pass) == (pytest.approx(0.1), 0.0, False)


@pytest.mark.parametrize(
    "rate,status,met", [(90.0, "on_track", True), (86.0, "on_track", False), (85.0, "on_track", False),
                        (84.9, "needs_attention", False), (80.0, "needs_attention", False), (79.9, "critical", False)],
)
def test_goal_classes(rows, rate, status, met):
    r = one(A.goal_check(rows([(rate,)], "automation_rate double")))
    assert (r.status, r.is_met, r.gap) == (status, met, pytest.approx(max(90 - rate, 0)))


@pytest.mark.parametrize(
    "tables,pages,score", [(0, 1, 15), (1, 1, 5), (3, 1, 10), (4, 1, 20), (4, 3, 25), (1, 2, 10), (1, 9, 15)]
)
def test_structure(rows, tables, pages, score):
    df = rows([(tables, pages)], "t int, p int")
    assert one(df.select(A.structure_complexity(F.col("t"), F.col("p")).alias("s"))).s == score


def test_keyword_ties_and_boosts(rows):
    df = rows(
        [("nothing here", 0), ("INVOICE receipt", 0), ("tel: phone: x", 0), ("", 1), (None, 0)], "text string, n int"
    )
    got = [(r.document_type, r.type_confidence) for r in A.classify_by_keywords(df, "text", "n").collect()]
    assert got == [("general", 0.5), ("invoice", 0.65), ("business_card", 0.95), ("invoice", 0.75), ("general", 0.5)]


def test_response_quality(rows):
    good = "This is a complete sentence. And here comes another full sentence."
    df = rows([(good,), ("short.",), ("x" * 60 + "...",), ("",)], "text string")
    got = [round(r.quality_score, 2) for r in A.response_quality(df).collect()]
    assert got == [1.0, 0.3, 0.5, 0.3]


# --- transforms ---


def test_clean_keeps_null_and_drops_required(rows):
    df = rows([(" a ", "1"), (None, "2"), ("\tb\n", "x")], "name string, n string")
    got = R.clean(df, ["name", "missing"], ["name", "missing"], {"n": "bigint"}).collect()
    assert [(r.name, r.n) for r in got] == [("a", 1), ("b", None)]


def test_deduplicate(rows):
    df = rows([(1, "a", 5), (2, "a", 3), (3, None, 1), (4, None, 2), (5, "b", 9)], "i int, k string, o int")
    pick = lambda keep: sorted(r.i for r in W.deduplicate(df, ["k"], keep, ["o"]).collect())
    assert (pick("first"), pick("last"), pick("none")) == ([2, 3, 5], [1, 4, 5], [5])
    with pytest.raises(ValueError):
        W.deduplicate(df, ["k"], "some")


def test_normalize(rows):
    df = rows([("a", 1.0), ("a", 3.0), ("b", 7.0), (None, 2.0), (None, 6.0), ("a", None)], "g string, v double")
    got = sorted((r.g or "", r.v) for r in W.normalize(df, group_by=["g"]).collect() if r.v is not None)
    assert got == [("", 0.0), ("", 1.0), ("a", 0.0), ("a", 1.0), ("b", 7.0)]


def test_split_sizes(rows):
    df = rows([("a", i) for i in range(9)] + [("b", 1)], "g string, i int")
    out = W.train_validation_split(df, ["g"], ["i"], min_samples=2).collect()
    assert sum(r.split == "train" for r in out) == 8
    assert [r.split for r in out if r.g == "b"] == ["insufficient"]
    assert max(r.i for r in out if r.split == "train") == 7


def test_ewma_seeds_at_first_nonzero(rows):
    values = [0.0, 0.0, 10.0, 20.0, 0.0]
    df = rows([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    state = 0.0
    for v in values:
        state = v if state == 0 else state * 0.9 + v * 0.1
    assert one(W.ewma(df, ["k"], ["i"], "v")).ewma == pytest.approx(state)


def test_sessions_break_at_the_gap(rows):
    base = [dt(2024, 1, 1, 0, 0), dt(2024, 1, 1, 0, 4, 59), dt(2024, 1, 1, 0, 9, 59), dt(2024, 1, 1, 0, 14, 58)]
    df = rows([(1, t) for t in base], "user_id int, event_time timestamp_ntz")
    got = sorted((r.session_start, r.session_end, r.events) for r in W.sessions(df).collect())
    # exactly five minutes apart opens a new session
    assert got == [
        (dt(2024, 1, 1, 0, 0), dt(2024, 1, 1, 0, 9, 59), 2),
        (dt(2024, 1, 1, 0, 9, 59), dt(2024, 1, 1, 0, 19, 58), 2),
    ]


def test_anomaly_window_crosses_midnight(rows):
    quiet = [(i, dt(2024, 1, 1, 23, 30 + i), 10.0 + i % 2) for i in range(20)]
    spike = [(99, dt(2024, 1, 2, 0, 5), 500.0)]
    alone = [(100, dt(2024, 1, 2, 5, 0), 900.0)]
    df = rows(quiet + spike + alone, "document_id int, event_time timestamp_ntz, processing_duration double")
    df = df.withColumns({"document_type": F.lit("x"), "user_id": F.lit(1)})
    assert [r.document_id for r in W.duration_anomalies(df).collect()] == [99]


def test_empty_hours_and_days(rows):
    df = rows([(dt(2024, 1, 1, 0, 5), 1.0), (dt(2024, 1, 3, 2, 0), 3.0)], "event_time timestamp_ntz, v double")
    hours = W.hourly_mean(df, "v").collect()
    assert len(hours) == 51 and sum(r.mean_value is not None for r in hours) == 2
    days = sorted((str(r.day), r.volume, r.direction) for r in W.daily_volume_trend(df).collect())
    assert days == [("2024-01-01", 1, None), ("2024-01-02", 0, "decreasing"), ("2024-01-03", 1, "increasing")]


def test_an_anomaly_looks_back_only(rows):
    """Later rows of the same minute do not hide an outlier; an hour back counts, more does not."""
    quiet = [(i, dt(2024, 1, 1, 0, i), 10.0 + i % 2) for i in range(30)]
    spike = [(99, dt(2024, 1, 1, 0, 40, 40), 100.0)]
    after = [(200 + i, dt(2024, 1, 1, 0, 40, 50 + i), 100.0) for i in range(9)]
    schema = "document_id int, event_time timestamp_ntz, processing_duration double"
    more = {"document_type": F.lit("x"), "user_id": F.lit(1)}
    for extra in ([], after):
        found = W.duration_anomalies(rows(quiet + spike + extra, schema).withColumns(more)).collect()
        assert 99 in {r.document_id for r in found}
    edge = [(1, dt(2024, 1, 1, 0, 0), 1000.0), *[(i, dt(2024, 1, 1, 1, 0), 10.0 + i) for i in range(2, 9)], (50, dt(2024, 1, 1, 1, 0, 0), 100.0)]
    assert {r.document_id for r in W.duration_anomalies(rows(edge, schema).withColumns(more)).collect()} == set()
    edge[0] = (1, dt(2023, 12, 31, 23, 59, 59), 1000.0)
    assert {r.document_id for r in W.duration_anomalies(rows(edge, schema).withColumns(more)).collect()} == {50}


def test_entities_keep_one_shape_at_every_size(rows):
    docs = rows([(1,), (2,), (3,)], "document_id int")
    ent = rows([(1, i) for i in range(500)] + [(2, 7)], "document_id int, e int")
    out = R.document_with_entities(docs, ent, ["e"]).collect()
    assert sorted((r.ordinal, r.e) for r in out if r.document_id == 1) == [(i + 1, i) for i in range(500)]
    assert sorted((r.document_id, r.e, r.n_entities) for r in out if r.document_id != 1) == [(2, 7, 1), (3, None, 0)]
    assert [r.e for r in R.requested_document(docs, ent, 1).first().entities] == list(range(500))
    assert R.requested_document(docs, ent, 3).first().entities == []


def test_the_last_duplicate_needs_an_order(rows):
    with pytest.raises(ValueError):
        W.deduplicate(rows([(1, "a")], "i int, k string"), ["k"], "last")


def test_upsert_last_wins(rows):
    old = rows([(1, "a"), (2, "b")], "k int, v string")
    new = rows([(2, "x", 1), (2, "y", 2), (3, None, 1)], "k int, v string, o int")
    assert sorted((r.k, r.v) for r in R.upsert(old, new, ["k"], ["o"]).collect()) == [(1, "a"), (2, "y"), (3, None)]


def test_stdev_and_empty_group(rows):
    df = rows([(1.0,), (3.0,)], "v double")
    assert one(G.aggregate(df, [], {"s": "STDEV(v)", "n": "COUNT(*)"})).s == pytest.approx(2**0.5)
    assert one(G.automation_metrics(rows([], "requires_review boolean, automation_score double, confidence_score double, completeness_score double, validation_pass boolean"))).automation_rate == 0.0


def test_execution_health_levels(rows):
    now = "2024-01-01 12:00:00"
    schema = "execution_id int, status string, start_time timestamp_ntz, end_time timestamp_ntz"
    stuck = [(1, "running", dt(2024, 1, 1, 10, 0), None)]
    bad = [(2, "failed", dt(2024, 1, 1, 11, 30), None)]
    assert one(G.execution_health(rows(stuck, schema), now)).status == "warning"
    r = one(G.execution_health(rows(stuck + bad, schema), now))
    assert (r.status, r.recent_failure_rate, len(r.recommendations)) == ("critical", 100.0, 2)
    assert one(G.execution_health(rows([], schema), now)).recommendations == ["System is healthy - no issues detected"]


# --- quality ---


def test_document_rules(rows):
    df = rows([(1, None, "f", "abc", "text/html"), (2, 5, "g", "0", "text/plain")],
              "document_id int, user_id int, file_name string, file_size string, content_type string")
    got = sorted((r.document_id, r.field_name, r.rule_type, r.passed, r.severity) for r in Q.validate_documents(df).collect())
    assert got == [
        (1, "content_type", "format", False, "warning"),
        (1, "file_size", "data_type", False, "error"),
        (1, "user_id", "required", False, "error"),
        (2, "file_size", "data_type", True, "error"),
        (2, "file_size", "range", False, "error"),
    ]


def test_empty_table_is_critical(rows):
    r = one(Q.quality_metrics(rows([], "document_id int, file_size bigint"), "documents"))
    assert (r.overall_score, r.quality_level, r.uniqueness) == (0.0, "critical", 0.0)


def test_timeliness_skips_rows_without_time(rows):
    df = rows([(dt(2024, 1, 1, 12, 0),), (None,), (dt(2023, 1, 1),)], "created_at timestamp_ntz")
    assert one(Q.timeliness(df, "2024-01-02 00:00:00")).timeliness == pytest.approx(0.25)


def test_profile_median_mode_and_nulls(rows):
    df = rows([(1, "b"), (2, "a"), (10, "a"), (None, "b"), (None, None)], "n int, s string")
    p = {r.column_name: r for r in Q.profile(df).collect()}
    assert (p["n"].median, p["n"].null_count, p["n"].unique_count) == (2.0, 2, 3)
    assert (p["s"].most_common, p["s"].most_common_count, p["s"].avg_length) == ("a", 2, 1.0)


@pytest.mark.parametrize(
    "text,value", [("1K", 1000.0), ("2.5 m", 2500000.0), ("$1,200.50", 1200.5), ("7", 7.0), ("abc", None)]
)
def test_amounts(rows, text, value):
    assert one(rows([(text,)], "t string").select(Q.standard_amount(F.col("t")).alias("v"))).v == value


@pytest.mark.parametrize("text", ["2024-03-15", "15/03/2024", "15/03/24", "15.03.2024", "20240315"])
def test_dates(rows, text):
    assert str(one(rows([(text,)], "t string").select(Q.standard_date(F.col("t")).alias("v"))).v) == "2024-03-15"


def test_nearest_names_finds_every_close_pair(rows):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    raw = ["Microsft", "Mircosoft", "microsoft", "Gogle", "Goooogle", "IBM", "BIM", "I", "", "Adobe Inc"]
    known = ["Microsoft", "Google", "IBM", "Adobe", "I"]
    got = {r.raw: (r.known, r.distance) for r in Q.nearest_names(
        rows([(x,) for x in raw], "v string"), rows([(x,) for x in known], "k string"), "v", "k").collect()}
    want = {}
    for a in raw:
        near = sorted((distance(a, b), b) for b in known if distance(a, b) <= 2)
        if near:
            want[a] = (near[0][1], near[0][0])
    assert got == want


def test_alert_operators(rows):
    df = rows([(1, "m", 5.0, dt(2024, 1, 1, 0, 50)), (2, "m", 100.0, dt(2024, 1, 1, 0, 1))],
              "id int, metric_name string, metric_value double, metric_timestamp timestamp_ntz")
    rules = [M.AlertRule(op, "d", "low", "m", 5.0, op, 15) for op in (">", "<", ">=", "<=", "==")]
    got = sorted(r.rule_name for r in M.evaluate_alerts(df, rules, "2024-01-01 01:00:00").collect())
    assert got == ["<=", "==", ">="]


# --- events, lineage, migration ---


def test_append_continues_versions(rows):
    schema = "event_id int, event_type string, aggregate_id string, event_data string, timestamp timestamp_ntz"
    a = E.append_events(rows([(1, "x", "d", "{}", dt(2024, 1, 1)), (2, "x", "d", "{}", dt(2024, 1, 1))], schema))
    b = E.append_events(rows([(3, "x", "d", "{}", dt(2024, 1, 2)), (4, "x", "e", "{}", dt(2024, 1, 2))], schema), a)
    assert sorted((r.event_id, r.version) for r in a.collect()) == [(1, 1), (2, 2)]
    assert sorted((r.event_id, r.version) for r in b.collect()) == [(3, 3), (4, 1)]


def test_closure_with_cycle_and_paths(rows):
    edges = rows([(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (5, 6), (3, 3)], "src bigint, dst bigint")
    start = rows([(1,)], "s bigint")
    got = {r.node: (r.distance, r.path) for r in N.reachable(edges, start, with_path=True).collect()}
    assert got == {2: (1, [1, 2]), 4: (1, [1, 4]), 3: (2, [1, 2, 3])}
    assert [(r.step, r.src, r.dst) for r in N.data_flow(edges, 1, 3).orderBy("step").collect()] == [(1, 1, 2), (2, 2, 3)]
    assert N.data_flow(edges, 1, 6).count() == 0
    lone = rows([(9,)], "s bigint")
    assert one(N.lineage_depth(edges, lone)).lineage_depth == 0
    assert one(N.impact_analysis(edges, lone)).total_impact_score == 0


def test_deep_chain_compacts(rows):
    edges = rows([(i, i + 1) for i in range(20)], "src bigint, dst bigint")
    got = N.reachable(edges, rows([(0,)], "s bigint")).collect()
    assert sorted((r.node, r.distance) for r in got) == [(i, i) for i in range(1, 21)]


def test_copy_values(rows):
    df = rows([("7", "x", dt(2024, 1, 2, 3, 4, 5), 5)], "a string, b string, c timestamp_ntz, d int")
    r = one(Z.copy_table(df, {"a": "INTEGER", "b": "FLOAT", "c": "TIMESTAMP", "d": "JSON"}))
    assert tuple(r) == (7, None, "2024-01-02T03:04:05", "5")


def test_type_tables():
    assert sum(len(t) for t in Z.TYPE_MAP.values()) == 102


@pytest.mark.parametrize("source,kind,want", [
    ("oracle", "raw", "VARBINARY(MAX)"), ("teradata", "byte", "VARBINARY(MAX)"), ("mysql", "year", "SMALLINT"),
    ("netezza", "double", "FLOAT"), ("oracle", "geometry", "NVARCHAR(MAX)"), ("netezza", "char", "CHAR(1)"),
])
def test_types(rows, source, kind, want):
    df = rows([(kind, None, None, None)], "data_type string, length int, precision int, scale int")
    assert one(Z.map_types(df, source)).target_type == want


def test_reconcile_sees_changed_values(rows):
    a, b = rows([(1, "x")], "k int, v string"), rows([(1, "y")], "k int, v string")
    r = one(Z.reconcile({"t": (a, b)}))
    assert (r.progress_percentage, r.identical) == (100.0, False)


# --- text and search ---


def test_clean_text(rows):
    df = rows([("  Ça \t\n va? (100€) — ok_1 ", ), (None,)], "text string")
    assert [r.text for r in X.clean_text(df).collect()] == ["Ça va? 100  ok_1", ""]


def test_normalize_entities_of_texts(rows):
    df = rows([({"a": " x ", "b": None},)], "entities map<string,string>")
    assert one(X.normalize_entities(df)).entities == {"a": "x", "b": ""}


def test_vector_search_in_blocks_equals_one_block(spark, rows, monkeypatch):
    from inkstream.sources.views import Tables

    vectors = Tables(spark, "/root/testdata/sf0.001").embeddings
    queries = vectors.selectExpr("vec_id AS query_id", "embedding")
    a = sorted(tuple(r) for r in V.vector_top_k(queries, vectors, 3).collect())
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 50)
    b = sorted(tuple(r) for r in V.vector_top_k(queries, vectors, 3).collect())
    assert [(r[0], r[1], r[3]) for r in a] == [(r[0], r[1], r[3]) for r in b]
    assert all(r[0] == r[1] for r in a if r[3] == 1)


def test_text_search_edge_cases(rows):
    docs = rows([(1, "alpha beta"), (2, "beta beta gamma"), (3, None), (4, "")], "doc_id bigint, text string")
    queries = rows([(1, "Beta"), (2, "unknown"), (3, None), (4, "gamma beta")], "query_id bigint, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in V.text_top_k(queries, docs, 5).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (4, 1, 2), (4, 2, 1)]


def test_context_without_hits(rows):
    questions = rows([(1, "why")], "conv_id int, message string")
    hits = rows([], "conv_id int, rank int, title string, snippet string, score double")
    history = rows([(1, 0, "u", "a")], "conv_id int, turn int, user string, assistant string")
    r = one(V.prompts(V.assemble_context(questions, hits, history)))
    assert (r.confidence, r.context, r.conversation) == (0.8, "", "User: u\nAssistant: a\n\n")
    assert "User's current question: why" in r.prompt
