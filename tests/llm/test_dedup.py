import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from data import SCHEMA, awkward, documents, shuffled

from inkstream.llm import sketch, substring_dedup, suffix_dedup


def brute_words(rows, width):
    first = {}
    split = [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in split:
        if k is not None:
            for i in range(len(w) - width + 1):
                name = tuple(w[i : i + width])
                first[name] = min(first.get(name, k), k)
    out = []
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if k is not None and first[tuple(w[i : i + width])] < k:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows, width):
    data = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(b[i : i + width] for _, b in data for i in range(len(b) - width + 1))
    out = []
    for k, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("width", [50, 4])
def test_substrings(spark, width):
    rows = shuffled(awkward())
    df = spark.createDataFrame(documents(None, rows), SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in substring_dedup.digest(df, width=width).collect())
    assert got == brute_words(rows, width)


def test_the_sketch_misses_no_repeated_key(spark):
    keys = [(k,) for k in range(3000) for _ in range(1 + (k % 7 == 0))]
    df = spark.createDataFrame(keys, "k bigint").repartition(3)

    def own(batch):
        yield batch.column(0).to_numpy().view(np.uint64)

    twice = sketch.bits(sketch.merged_counts(df, own))
    found = sketch.estimated(twice, np.arange(3000, dtype=np.uint64))
    assert found[::7].all() and found.sum() < 3000 / 7 + 20
    once = sketch.bits(sketch.merged_counts(df, own, least=1))
    assert sketch.estimated(once, np.arange(3000, dtype=np.uint64)).all()
    assert sketch.estimated(once, np.arange(3000, 9000, dtype=np.uint64)).sum() < 20


def test_rewritten_rows_keep_their_columns(spark):
    rows = awkward()
    df = spark.createDataFrame(documents(None, rows), SCHEMA)
    out = substring_dedup.remove_repeats(df).select("row.*", "n_removed").collect()
    assert out[0].asDict().keys() == {*df.columns, "n_removed"}
    texts = Counter(rows)
    for r in out:
        if r["n_removed"] == 0:
            assert texts[(r["doc_id"], r["text"])]
        assert r["row"] == "y" and r["windows"] == 1


@pytest.mark.parametrize("width", [400, 40, 8])
def test_suffixes(spark, width):
    rows = shuffled(awkward())
    df = spark.createDataFrame(documents(None, rows), SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in suffix_dedup.digest(df, width=width).collect())
    assert got == brute_bytes(rows, width)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.digest(none).collect() == []
    assert suffix_dedup.digest(none).collect() == []


def test_repeated_starts_of_random_strings(monkeypatch):
    rng = random.Random(6)
    for wave in (64, 0, 10**9):  # buckets by waves, and suffix by suffix
        monkeypatch.setattr(suffix_dedup, "WAVE", wave)
        for _ in range(300):
            letters = rng.choice([1, 2, 3, 26])
            contents = [bytes(rng.choices(range(97, 97 + letters), k=rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
            width = rng.randint(1, 8)
            count = Counter(c[i : i + width] for c in contents for i in range(len(c) - width + 1))
            expected = [[i for i in range(len(c) - width + 1) if count[c[i : i + width]] > 1] for c in contents]
            assert [g.tolist() for g in suffix_dedup.repeated_starts(contents, width)] == expected


def glued(rng, n, passages):
    """Contents of 300 to 4500 bytes, cut from and glued of a few passages."""
    parts = [bytes(rng.choices(b"abcde fgh", k=rng.randint(350, 1500))) for _ in range(passages)]
    out = []
    for _ in range(n):
        want, content = rng.randint(300, 4500), b""
        while len(content) < want:
            part = rng.choice(parts)
            low = rng.choice([0, 0, rng.randrange(len(part))])
            content += part[low : rng.choice([len(part), rng.randint(low, len(part))])]
        out.append(content[:want])
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("wave", [64, 10**9])
def test_repeated_starts_of_glued_passages(monkeypatch, seed, wave):
    monkeypatch.setattr(suffix_dedup, "WAVE", wave)
    contents = list(dict.fromkeys(glued(random.Random(seed), 60, 12)))
    count = Counter(c[i : i + 400] for c in contents for i in range(len(c) - 399))
    expected = [[i for i in range(len(c) - 399) if count[c[i : i + 400]] > 1] for c in contents]
    assert [g.tolist() for g in suffix_dedup.repeated_starts(contents, 400)] == expected


def test_the_order_is_the_full_order_of_suffixes():
    rng = random.Random(9)
    for letters in (2, 30, 3000):
        text = [rng.randint(1, letters) for _ in range(900)] * 2 + [0]
        order = suffix_dedup.suffix_array(np.array(text, dtype=np.int64)).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_documents_glued_of_shared_passages(spark):
    rows = [(i, c.decode()) for i, c in enumerate(glued(random.Random(40), 150, 20))]
    df = spark.createDataFrame(documents(None, rows), SCHEMA).repartition(3)
    assert Counter(tuple(r) for r in suffix_dedup.digest(df).collect()) == brute_bytes(rows, 400)
