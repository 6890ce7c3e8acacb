"""Slow documents on a stream against a plain evaluation of the definition."""

import random
from datetime import datetime as dt
from datetime import timedelta
from statistics import mean, stdev

from inkstream.streaming import anomalies as A


def brute(rows):
    """Rows above the mean and two deviations of everything from one hour before up to their instant."""
    out = []
    for r in rows:
        hour = [x[2] for x in rows if r[0] - timedelta(hours=1) <= x[0] <= r[0] and x[2] is not None]
        if r[2] is not None and r[2] > 0 and len(hour) > 1 and r[2] > mean(hour) + 2 * stdev(hour):
            out.append(r)
    return sorted(out)


def events(rng, n):
    start = dt(2024, 1, 1)
    times = [start + timedelta(minutes=rng.choice([1, 5, 7]) * rng.randint(0, 120)) for _ in range(n)]
    slow = [None, -1.0, 0.0, 5000.0]
    return [(t, i, rng.choice(slow) if rng.random() < 0.1 else rng.uniform(1, 50), "other", i % 5) for i, t in enumerate(times)]


def test_rows_are_judged_once_the_watermark_has_passed(spark, rows, tmp_path):
    rng = random.Random(2)
    data = sorted(events(rng, 400))
    delay = timedelta(minutes=30)
    job = A.TrailingAnomalies(f"file://{tmp_path}/a", "30 minutes")
    # parts by time, with rows up to 30 minutes old and a few older ones in the next part
    parts = [[], [], [], [], []]
    for r in data:
        n = min(int((r[0] - dt(2024, 1, 1)).total_seconds() // 10000), 3)
        parts[n + (rng.random() < 0.1)].append(r)
    parts.insert(2, [])  # a micro-batch without rows
    used, late, newest = [], 0, None
    for n, part in enumerate(parts):
        for _ in range(1 + (n in (1, 3))):  # some micro-batches run twice
            job.step()(rows(part, A.ROWS).repartition(3), n)
        floor = newest - delay if newest else dt.min
        used += [r for r in part if r[0] >= floor]
        late += sum(r[0] < floor for r in part)
        newest = max([r[0] for r in part] + ([newest] if newest else []), default=None)
        got = sorted(tuple(r) for r in job.found(spark, n).collect())
        assert got == [r for r in brute(used) if r[0] < newest - delay]
    assert got and late and job.marks.at(spark, n).first().late == late


def test_state_does_not_grow_with_the_stream(spark, rows, tmp_path):
    job = A.TrailingAnomalies(f"file://{tmp_path}/a", "10 minutes")
    sizes = []
    for n in range(8):
        start = dt(2024, 1, 1) + timedelta(hours=3 * n)
        part = [(start + timedelta(minutes=m), 1000 * n + m, 1.0 + m % 7, "other", 1) for m in range(180)]
        job.step()(rows(part, A.ROWS), n)
        sizes.append((job._rows.at(spark, n).count(), job._sums.at(spark, n).count()))
    assert set(sizes) == {(11, 71)}  # ten minutes and the newest instant; an hour more
