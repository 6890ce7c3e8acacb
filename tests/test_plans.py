"""Physical plans: pushdown, pruning, no Python in the hot path, no single-task windows."""

import pytest
from conftest import SMALL

from inkstream.operators import relational as R
from inkstream.operators import windows as W
from inkstream.plans import REGISTRY
from inkstream.sources.views import AS_OF, Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    t = Tables(spark, SMALL)
    text = plan(W.performance_metrics(R.time_range(t.doc_events(), "event_time", "7d", AS_OF), "1 hour"))
    assert "GreaterThanOrEqual(ts," in text
    schema = text.split("ReadSchema:")[1]
    assert "event_id" not in schema  # not needed by these metrics


def test_top_n_per_key_is_limited_before_the_shuffle(spark):
    text = plan(W.last_exchanges(Tables(spark, SMALL).conversations, 3, "conv_id", "turn"))
    assert text.count("WindowGroupLimit") >= 2


def test_alerts_read_the_input_once(spark):
    text = plan(W.realtime_alerts(Tables(spark, SMALL).doc_events(), "1 hour"))
    assert text.count("FileScan") == 1


@pytest.mark.parametrize(
    "name", ["document_type_distribution", "realtime_alerts", "automation_score", "route_documents", "replay",
             "validate_documents", "quality_metrics", "analytics_rollup", "document_aggregates", "upsert"],
)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(REGISTRY[name].run(spark, SMALL))
    for bad in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.mark.parametrize(
    "name", ["duration_anomalies", "peak_usage", "daily_volume_trend", "ewma", "running_mean", "index_percentiles",
             "train_validation_split", "append_events"],
)
def test_no_window_gathers_raw_rows_in_one_task(spark, name):
    """The only unpartitioned window allowed runs over the per-range totals."""
    text = plan(REGISTRY[name].run(spark, SMALL))
    for line in text.splitlines():
        if "SinglePartition" in line and "Exchange" in line:
            assert "rangepartitioning" not in line
    assert "windowspecdefinition(event_time" not in text and "windowspecdefinition(ts" not in text


def test_counts_are_partial_before_the_shuffle(spark):
    text = plan(R.user_document_counts(Tables(spark, SMALL).users(), Tables(spark, SMALL).user_documents()))
    assert "partial_count" in text


def test_no_local_checkpoint_in_the_library():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "inkstream"
    text = "".join(p.read_text() for p in root.rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text




def test_search_reads_the_documents_once_and_collects_nothing(spark):
    import inspect

    from inkstream.operators import search

    assert ".collect()" not in inspect.getsource(search) and ".first()" not in inspect.getsource(search)
    t = Tables(spark, SMALL)
    docs = t.documents
    for n in (1, 40):
        queries = t.benchmark.where(f"item_id < {n}").selectExpr("item_id AS query_id", "text")
        scans = [x for x in plan(search.text_top_k(queries, docs)).splitlines() if "FileScan" in x and "doc_id" in x]
        assert len(scans) <= 3  # postings, their counts (reused where equal), sizes
