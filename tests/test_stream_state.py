"""State of streams: changed rows only, the same state when a micro-batch runs again, late rows, one read of the source."""

import random
from datetime import datetime as dt
from datetime import timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from inkstream.operators import windows as W
from inkstream.plans.registry import REGISTRY
from inkstream.plans.streaming import _FAN, _zoned
from inkstream.sources.views import Tables
from inkstream.streaming import jobs as S
from inkstream.streaming.fanout import Output, SharedOutputs, micros
from inkstream.streaming.store import ChangeStore
from inkstream.streaming.tables import Versioned

START = dt(2024, 1, 1)


def canon(df):
    """Rows of any table, times plain, floats rounded."""
    plain = df.select(*[F.col(c).cast("timestamp_ntz") if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in plain.collect())


# --- change store ---


def test_the_newest_row_of_a_key_wins_and_a_rerun_changes_nothing(spark, rows, tmp_path):
    rng = random.Random(1)
    store = ChangeStore(f"file://{tmp_path}/s", "k INT, n STRING, v INT", ("k", "n"), fan=3)
    want = {}
    for batch in range(8):
        part = {(rng.randrange(40), rng.choice(["a", None])): rng.randrange(1000) for _ in range(rng.choice([0, 25]))}
        want |= part
        for _ in range(1 + batch % 2):
            store.put(rows([(*k, v) for k, v in part.items()], "k int, n string, v int"), batch)
        assert {(r.k, r.n): r.v for r in store.at(spark, batch).collect()} == want
    some = store.at(spark, 7, F.col("k") < 5)
    assert {(r.k, r.n): r.v for r in some.collect()} == {k: v for k, v in want.items() if k[0] < 5}
    with pytest.raises(Exception, match="batch=8"):
        store.at(spark, 8)


def test_greater_rows_win_whatever_their_micro_batch(spark, rows, tmp_path):
    store = ChangeStore(f"file://{tmp_path}/s", "k INT, version INT, v STRING", ("k",), ("version",), fan=2)
    for batch, part in enumerate([[(1, 5, "new"), (1, 2, "x")], [(1, 3, "late"), (2, 1, "a")], [(2, 1, "b")], []]):
        store.put(rows(part, "k int, version int, v string"), batch)
    assert sorted(tuple(r) for r in store.at(spark, 3).collect()) == [(1, 5, "new"), (2, 1, "b")]


def test_bytes_of_a_micro_batch_do_not_follow_the_history(spark, tmp_path):
    """Twenty micro-batches of 2 000 new keys each: all write as much, and merging rewrites a row a few times."""
    store = ChangeStore(f"file://{tmp_path}/s", "k BIGINT, v BIGINT", ("k",), buckets=2)
    wrote, merged = [], []
    for batch in range(20):
        store.put(spark.range(2000 * batch, 2000 * batch + 2000).selectExpr("id AS k", "hash(id) AS v"), batch)
        state = store.manifest(spark, batch)
        wrote.append(state["wrote"])
        merged.append(state["merged"])
    assert max(wrote) < 1.2 * min(wrote)
    assert sum(merged) < 2.5 * sum(wrote) and sum(m == 0 for m in merged) == 15
    assert len(state["runs"]) <= 6 and store.at(spark, 19).count() == 40_000
    kept = [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("run=")]
    assert len(kept) <= 10


def test_expired_events_are_left_out_and_merged_away(spark, rows, tmp_path):
    rng = random.Random(4)
    schema = "aggregate_id string, event_type string, version long, timestamp timestamp, event_data string"
    events = [
        (f"d{rng.randrange(12)}", rng.choice(["DocumentUploaded", "DocumentProcessingFailed", "DocumentClassified"]), i, START + timedelta(hours=3 * i), "{}")
        for i in range(120)
    ]
    rng.shuffle(events)  # any order of arrival
    store = S.newest_events(f"file://{tmp_path}/n", "3 DAYS")
    for batch in range(8):
        S.keep_newest(store)(rows(events[15 * batch : 15 * batch + 15], schema), batch)
    got = sorted(tuple(r) for r in S.live_events(store.at(spark, 7), "3 DAYS").collect())
    used = [e for e in events if e[1] != "DocumentClassified"]
    newest = max(e[3] for e in used)
    want = []
    for d in {e[0] for e in used}:
        last = max(e[3] for e in used if e[0] == d)
        for kind in {e[1] for e in used}:
            own = [e for e in used if e[0] == d and e[1] == kind]
            if own and last >= newest - timedelta(days=3):
                event = max(own, key=lambda e: e[2])
                if event[3] >= last - timedelta(days=3):
                    want.append(event)
    assert got == sorted(want) and want
    assert store.at(spark, 7).count() < len({(e[0], e[1]) for e in used})


# --- windows after a stream ---


def plain_windows(stored):
    out = {"moving_average": [], "count_trend": []}
    for kind in {k for _, k in stored}:
        ends = sorted(e for e, k in stored if k == kind)
        for i, end in enumerate(ends):
            avgs = [stored[e, kind][0] for e in ends]
            counts = [stored[e, kind][1] for e in ends]
            five, ten = avgs[max(0, i - 4) : i + 1], avgs[max(0, i - 9) : i + 1]
            out["moving_average"].append((end, kind, avgs[i], sum(five) / len(five), sum(ten) / len(ten)))
            before = counts[i - 1] if i else None
            out["count_trend"].append((end, kind, counts[i], before, counts[i] - before if i else None))
    return {n: sorted(map(str, ((*r[:2], *(round(v, 6) if isinstance(v, float) else v for v in r[2:])) for r in v))) for n, v in out.items()}


def test_only_the_results_that_a_changed_window_reaches_are_written(spark, rows, tmp_path):
    rng = random.Random(6)
    post, stored, written = S.PostWindows(f"file://{tmp_path}/p", "1 minute"), {}, []
    steps = [
        [(i, k) for i in range(0, 120, 3) for k in "ab"], [(i, "a") for i in range(120, 126)], [(5, "b"), (60, "a")], [],
        [(200, "c")], [(1000, "a"), (0, "a")], [(130, "b"), (1001, "a")],
    ]
    for batch, changed in enumerate(steps):
        part = {(START + timedelta(minutes=i), k): (float(rng.randrange(100)), rng.randrange(9)) for i, k in changed}
        stored |= part
        for _ in range(1 + (batch == 2)):
            post.step()(rows([(*k, *v) for k, v in part.items()], S.WINDOW_ROWS), batch)
        want = plain_windows(stored)
        for name in S.POST:
            assert canon(post.results(spark, name).at(spark, batch)) == want[name]
        written.append(post.results(spark, "moving_average").manifest(spark, batch)["rows"])
    assert written == [80, 6, 20, 0, 1, 11, 2]


def test_windows_read_back_no_further_than_needed(spark, rows, tmp_path):
    post = S.PostWindows(f"file://{tmp_path}/p", "1 minute")
    post.step()(rows([(START + timedelta(minutes=i), "a", 1.0, 1) for i in range(500)], S.WINDOW_ROWS), 0)
    changed = rows([(START + timedelta(minutes=499), "a", 3.0, 1)], S.WINDOW_ROWS)
    post.windows.put(changed, 1)
    assert post._range(changed, 1).count() == 1 + S.HALO


# --- all outputs from one job ---


def parts_of(table, n):
    """Events in ``n`` parts by time; some of the last hours of a part come with the next."""
    events = _zoned(table.doc_events())
    days = F.unix_micros("event_time") / 86_400_000_000
    late = (F.col("document_id") % 3 == 0) & (F.pmod(days, F.lit(10.0)) >= 9.6)
    first = F.floor(days / 10) + late.cast("int")
    marked = events.withColumn("part", first - F.floor(F.lit(START.toordinal() - dt(1970, 1, 1).toordinal()) / 10))
    return [marked.where(F.col("part") == i).drop("part") for i in range(n)], events.schema


def test_every_output_equals_its_operator(spark, tmp_path):
    table = Tables(spark, SMALL)
    parts, schema = parts_of(table, 5)
    widths = {name: width for name, (width, _) in _FAN.items() if width}
    shared = SharedOutputs(f"file://{tmp_path}/s", S.stream_outputs(widths), schema, "12 hours", "6 hours")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    total = 0
    for i, part in enumerate(parts):
        total += part.count()
        shared.step()(part.mapInArrow(counted, schema), i)
        assert read.value == total  # one read of each micro-batch, whatever the number of outputs
    assert total == table.doc_events().count() and shared.manifest(spark, 4)["late"] == 0
    until = table.doc_events().select(F.max("event_time") - F.expr("INTERVAL 12 HOURS")).first()[0]
    for name, output in shared.outputs.items():
        want = output.make(table.doc_events())
        end = want.columns[0]
        want = want.where(F.col(end) <= F.lit(until)) if output.width else want.where(F.col("event_time") < F.lit(until))
        assert canon(shared.output(spark, name, 4)) == canon(want), name


def test_reference_widths_late_rows_and_reruns(spark, rows, tmp_path):
    """Windows of one, five and ten minutes next to each other; a micro-batch that runs again; rows behind the watermark."""
    rng = random.Random(3)
    schema = "event_time timestamp, document_type string, processing_duration double, document_id long, user_id long"

    def count(width):
        return Output(lambda df: W.tumbling(df, width, ["document_type"], {"n": F.count(F.lit(1))}), width)

    outputs = {w: count(w) for w in ("1 minute", "5 minutes", "10 minutes")} | {"rows": Output(lambda df: df.select("event_time", "document_id"))}
    shared = SharedOutputs(f"file://{tmp_path}/s", outputs, schema, "3 minutes", "2 minutes")
    used, late, newest = [], 0, None
    for batch in range(6):
        low = 600 * batch
        part = [(START + timedelta(seconds=max(0, low + rng.randint(-400, 600))), rng.choice("ab"), 1.0, 100 * batch + i, 1) for i in range(30)]
        part = [] if batch == 3 else part
        floor = newest - timedelta(minutes=3) if newest else dt.min
        for _ in range(1 + (batch == 2)):
            shared.step()(rows(part, schema), batch)
        used += [r for r in part if r[0] >= floor]
        late += sum(r[0] < floor for r in part)
        newest = max([r[0] for r in part] + ([newest] if newest else []))
    mark, everything = newest - timedelta(minutes=3), rows(used, schema)
    assert late and shared.manifest(spark, 5)["late"] == late
    for name, output in outputs.items():
        want = output.make(everything)
        want = want.where(F.col("window_end") <= F.lit(mark)) if output.width else want.where(F.col("event_time") < F.lit(mark))
        assert canon(shared.output(spark, name, 5)) == canon(want)
    waiting = [int(p.name.removeprefix("period=")) for p in (tmp_path / "s" / "rows").iterdir() if p.name.startswith("period=")]
    assert min(waiting) * micros("2 minutes") >= (mark - dt(1970, 1, 1)).total_seconds() * 1e6 - micros("25 minutes")


# --- sessions, lateness ---


def test_a_late_event_joins_two_sessions(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/in"
    schema = "event_time timestamp, user_id int"
    minute = lambda m: START + timedelta(minutes=m)
    rows([], schema).write.parquet(folder)
    stream = W.sessions(spark.readStream.schema(schema).parquet(folder), "10 minutes", watermark="30 minutes")
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c")
    for part in ([(minute(0), 1), (minute(15), 1), (minute(3), 2)], [(minute(8), 1), (minute(20), 3)], [(minute(120), 3)]):
        rows(part, schema).coalesce(1).write.mode("append").parquet(folder)
        writer.trigger(availableNow=True).format("parquet").option("path", f"file://{tmp_path}/out").start().awaitTermination()
    got = sorted((r.user_id, r.session_start, r.session_end, r.events) for r in spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out").collect())
    assert got == [(1, minute(0), minute(25), 3), (2, minute(3), minute(13), 1), (3, minute(20), minute(30), 1)]


def test_late_rows_are_counted_over_all_batches(spark, rows, tmp_path):
    seen = Versioned(f"file://{tmp_path}/seen", "max_time TIMESTAMP, late BIGINT")
    split = S.late_rows(seen, f"file://{tmp_path}/late", "10 minutes")
    for n, minutes in enumerate(([0, 60], [49, 51, 70], [], [10, 59, 61])):
        for _ in range(2):
            split(rows([(START + timedelta(minutes=m),) for m in minutes], "event_time timestamp"), n)
    state = seen.at(spark, 3).first()
    assert (state.late, state.max_time) == (3, START + timedelta(minutes=70))
    assert spark.read.schema("event_time timestamp").parquet(f"file://{tmp_path}/late/*").count() == 3


def test_life_cycle_holds_every_document(spark, rows, tmp_path):
    """A document whose last event is weeks before the newest of all, and an old event of a document that has newer ones."""
    events = [
        (1, dt(2024, 1, 1), 1, "view", 5.0, '{"k": 0}'),  # doc-1, uploaded
        (2, dt(2024, 1, 1), 1, "view", 5.0, '{"k": 3}'),  # doc-2, failed
        (502, dt(2024, 1, 29), 1, "view", 7.0, '{"k": 2}'),  # doc-2, completed
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows(events, schema).write.parquet(f"file://{tmp_path}/events.parquet")
    found = {r.document_id: r for r in REGISTRY["document_lifecycle"].run(spark, f"file://{tmp_path}").collect()}
    assert {d: r.status for d, r in found.items()} == {"doc-1": "uploaded", "doc-2": "completed"}
    assert (found["doc-1"].file_name, found["doc-2"].error_code, found["doc-2"].next_retry) == ("doc-1.pdf", "E0", None)
    assert found["doc-2"].processing_duration == 7.0
