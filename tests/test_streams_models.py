"""Streams against batches, state over several micro-batches, fitted models, sinks."""

from datetime import datetime as dt

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from inkstream.functions import udtf
from inkstream.operators import models as X
from inkstream.plans.models import labelled, languages
from inkstream.sources import jdbc, tables
from inkstream.sources.views import StreamTables, Tables
from inkstream.streaming import jobs as S
from inkstream.streaming.tables import Versioned

CHAINED = {"throughput_analysis", "entity_analytics"}  # two aggregates, which streams run in append mode only


@pytest.mark.parametrize("name", list(S.WINDOWED))
def test_stream_equals_batch(spark, tmp_path, name):
    """The whole result of every windowed output; of chained ones all closed windows."""
    op = S.WINDOWED[name]
    want = op(Tables(spark, SMALL).doc_events(), "6 hours")
    if name in CHAINED:
        stream = op(StreamTables(spark, SMALL).doc_events(), "6 hours", watermark="1 hour")
        last = Tables(spark, SMALL).doc_events().select(F.max("event_time") - F.expr("INTERVAL 1 HOUR")).scalar()
        want, mode, how = want.where(F.col("window_end") <= last), "append", "append"
    else:
        stream = op(StreamTables(spark, SMALL).doc_events(), "6 hours")
        mode, how = "update" if name == "realtime_alerts" else "complete", "overwrite"
    job = S.run_batches(
        stream, lambda df, i: df.write.mode(how).parquet(f"file://{tmp_path}/out"), f"file://{tmp_path}/c", mode
    )
    job.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")

    def canon(df):
        return sorted(
            tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r)
            for r in df.select(*[F.col(c).cast("timestamp_ntz") if t.startswith("timestamp") else F.col(c) for c, t in want.dtypes]).collect()
        )

    assert canon(got) == canon(want) and canon(got)


def test_metrics_continue_over_batches(spark, rows, tmp_path):
    data = [(i, dt(2024, 1, 1, 0, i), i % 4 != 0, float(i)) for i in range(12)]
    schema = "event_id int, event_time timestamp, success boolean, seconds double"
    table = Versioned(f"file://{tmp_path}/state", S.METRICS)
    step = S.processing_metrics(table)
    for n, part in enumerate((data[:5], data[5:6], [], data[6:])):
        step(rows(part, schema), n)
        step(rows(part, schema), n)  # a repeated micro-batch changes nothing
    r = S.metrics_report(table.at(spark, 3)).collect()[0]
    avg = 0.0
    for *_, seconds in data:
        avg = seconds if avg == 0 else avg * 0.9 + seconds * 0.1
    assert (r.events, r.failures) == (12, 3)
    assert r.processing_time_avg == pytest.approx(avg)
    assert r.throughput_per_minute == pytest.approx(12 / 11)


def test_lost_state_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        Versioned(f"file://{tmp_path}/none", S.METRICS).at(spark, 3)


def test_lifecycle_over_batches_in_any_order(spark, rows, tmp_path):
    schema = "event_type string, aggregate_id string, event_data string, timestamp timestamp, version bigint"
    fail = '{"error_message":"m","error_code":"E1","retry_count":%d}'
    first = [("DocumentProcessingFailed", "d", fail % 1, dt(2024, 1, 1, 0, 3), 3), ("DocumentClassified", "d", "{}", dt(2024, 1, 1), 4)]
    second = [("DocumentUploaded", "d", '{"file_name":"f.pdf","file_size":7}', dt(2024, 1, 1, 0, 1), 1)]
    third = [first[0], ("DocumentUploaded", "e", '{"file_name":"g.pdf","file_size":8}', dt(2024, 3, 1), 1)]  # a redelivery
    folder, out = f"file://{tmp_path}/in", S.newest_events(f"file://{tmp_path}/out", "30 DAYS")
    rows([], schema).write.json(folder)
    stream = spark.readStream.schema(schema).json(folder)
    for n, part in enumerate((first, second, third)):
        rows(part, schema).coalesce(1).write.mode("append").json(folder)
        job = S.run_batches(stream, S.keep_newest(out), f"file://{tmp_path}/c")
        job.awaitTermination()
        live = S.live_events(out.at(spark, int(job.lastProgress["batchId"])), "30 DAYS")
        found = {r.document_id: r for r in S.document_records(live).collect()}
        if n < 2:
            r = found["d"]
            assert (r.status, r.version, r.next_retry, r.retry_at) == ("failed", 3, 2, dt(2024, 1, 1, 0, 8))
            assert (r.file_name, r.file_size) == (("f.pdf", 7) if n else (None, None))
    assert list(found) == ["e"]  # the older document has expired


def test_language_detector_learns_and_saves(spark, tmp_path):
    docs = languages(Tables(spark, SMALL))
    fitted = X.fit_language_detector(docs, vocabulary=500)
    assert fitted.accuracy > 0.7
    top = X.predict(docs, fitted, "document_id", top=None).first()
    assert len(top.top_predictions) == len(fitted.labels)
    assert top.confidence == pytest.approx(top.top_predictions[0]["probability"])
    X.save_models({"language": fitted}, f"file://{tmp_path}")
    again = X.FittedClassifier("language", X.load_model(f"file://{tmp_path}", "language"), 0.0, fitted.report)
    same = X.predict(docs, again, "document_id").join(
        X.predict(docs, fitted, "document_id").withColumnRenamed("predicted_class", "p"), "document_id"
    )
    assert same.where("predicted_class <> p").count() == 0


def test_document_classifier_keeps_the_better(spark):
    best, other = X.fit_document_classifier(
        labelled(Tables(spark, SMALL)), trees=5, depth=3, rounds=2, boost_depth=2, vocabulary=100
    )
    assert best.accuracy >= other.accuracy
    assert {best.name, other.name} == {"tfidf", "count"}


def test_split_is_stratified(spark):
    docs = languages(Tables(spark, SMALL))
    tags = X.split_tags(docs, "language", "document_id").join(docs, "document_id")
    for r in tags.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert r.t == -(-r.n * 8 // 10)


def test_table_function(spark):
    udtf.register(spark)
    rules = '[{"field":"a","rule":"required"},{"field":"b","rule":"range","min":1,"max":3},{"field":"c","rule":"pattern","regex":"^x"}]'
    out = spark.sql(f"""SELECT * FROM validate('{{"b": 5, "c": "xy"}}', '{rules}')""").collect()
    assert [(r.field_name, r.passed) for r in out] == [("a", False), ("b", False), ("c", True)]


def test_jdbc_options():
    o = jdbc.jdbc_read_options("jdbc:x", "t", "id", 0, 100, 4)
    assert (o["partitionColumn"], o["numPartitions"], o["fetchsize"]) == ("id", "4", "10000")
    with pytest.raises(ValueError):
        jdbc.jdbc_read_options("jdbc:x", "t", "id", 0, 100, 0)


def test_zone_and_format_names(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(ValueError):
        tables.write_zone(df, str(tmp_path), "other", "id")
    with pytest.raises(ValueError):
        tables.export(df, str(tmp_path), "xlsx")
