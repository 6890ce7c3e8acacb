import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from data import SCHEMA, awkward, documents, shuffled

from inkstream.llm import periodic_runs


def brute_runs(w, least=12):
    """Every stretch, by comparing all places at all lags."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(key, text, rewrite):
    w = (text or "").encode().split()
    if rewrite and key is not None and w:
        h = crc32(str(key).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (key, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def order(rows):
    return sorted(rows, key=str)


def texts(rng):
    """Words that repeat in many ways."""
    kind = rng.randrange(6)
    n = rng.randint(0, 150)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        unit = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 20))]
        return [rng.choice("xyz") for _ in range(rng.randint(0, 9))] + unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
    if kind == 2:
        a, b = "x", "y"
        while len(a) < 100:  # a text with many runs
            a, b = a + b, a
        return list(a)
    if kind == 3:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        inner = unit * rng.randint(2, 6) + ["u"]
        return inner * rng.randint(2, 5)
    if kind == 4:
        return ["w"] * n
    return [str(rng.randrange(40)) for _ in range(n)]


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(150):
        some = [[x.encode() for x in texts(rng)] for _ in range(rng.randint(1, 6))]
        assert periodic_runs.find_runs(some) == [brute_runs(w) for w in some]


@pytest.mark.parametrize("least", [2, 5, 30])
def test_other_lengths(least):
    rng = random.Random(least)
    some = [[x.encode() for x in texts(rng)] for _ in range(120)]
    assert periodic_runs.find_runs(some, least) == [brute_runs(w, least) for w in some]


def test_segments_split_to_stability():
    rng = random.Random(5)

    def plain(codes, low, high):
        if high - low < 12:
            return []
        single = [i for i in range(low, high) if codes[low:high].count(codes[i]) == 1]
        if not single:
            return [(low, high)]
        edges = [low - 1, *single, high]
        return [s for a, b in zip(edges, edges[1:], strict=False) for s in plain(codes, a + 1, b)]

    for _ in range(200):
        codes = [rng.randrange(rng.choice([3, 20, 60])) for _ in range(rng.randint(0, 200))]
        assert periodic_runs.segments(codes) == plain(codes, 0, len(codes))


def test_a_text_that_splits_once_in_each_round_takes_n_log_n_steps():
    # word i stands at both ends of the part that is left when word i - 1 has gone
    n = 20_000
    chain = [0]
    for i in range(1, n):
        chain += [i, i - 1] if i % 2 else [i]
    assert periodic_runs.segments(chain) == []


def test_a_long_document_with_every_lag():
    words = [b"a"] * 30_000
    assert periodic_runs.find_runs([words]) == [[(0, 30_000, 1)]]
    unit = [str(i).encode() for i in range(9_000)]
    words = [b"x"] + unit * 3 + unit[:7]
    assert periodic_runs.find_runs([words]) == [[(1, 27_007, 9_000)]]


def test_rows(spark):
    rng = random.Random(8)
    rows = shuffled(awkward()) + [(100 + i, " ".join(texts(rng))) for i in range(150)]
    df = spark.createDataFrame(documents(None, rows), SCHEMA).repartition(3)
    for rewrite in (None, periodic_runs.repeat_tail):
        got = order(tuple(r) for r in periodic_runs.digest(df, rewrite=rewrite).collect())
        assert got == order(brute_row(k, t, rewrite) for k, t in rows)


def test_the_operator_returns_runs_and_texts(spark):
    rows = [(1, "a b " * 8 + "c"), (2, None), (2, "a b")]
    df = spark.createDataFrame(documents(None, rows), SCHEMA)
    out = {(r["doc_id"], r["n_words"]): r for r in periodic_runs.periodic_runs(df).collect()}
    assert [tuple(r) for r in out[1, 17]["runs"]] == [(0, 16, 2)] and out[1, 17]["collapsed"] == "a b c"
    assert out[2, 0]["runs"] == [] and out[2, 0]["collapsed"] == "" and out[2, 2]["collapsed"] == "a b"


def test_empty_table_and_small_slices(spark, monkeypatch):
    assert periodic_runs.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(2)
    some = [[x.encode() for x in texts(rng)] for _ in range(30)]
    whole = periodic_runs.find_runs(some)
    assert [r for w in some for r in periodic_runs.find_runs([w])] == whole


def test_supplied_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    short = [r for r in rows if len((r[1] or "").split()) < 1500]
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.digest(df, rewrite=periodic_runs.repeat_tail).collect()}
    assert len(got) == len(rows)
    for key, text in short:
        assert got[key] == brute_row(key, text, True)
    assert sum(r[1] > 0 for r in got.values()) >= np.sum([crc32(str(k).encode()) % 10 == 0 for k, _ in rows]) // 2
