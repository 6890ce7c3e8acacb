import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from data import SCHEMA, awkward, documents, shuffled

from inkstream.llm import lexical_search, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(rows, items, k=20):
    """(item, score, document) of every item's best, from the definition; scores before ids."""
    docs = [(d, terms(t)) for d, t in rows]
    docs = [(d, w, Counter(w)) for d, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, w, c in docs:
            m = 100 - 25 + (25 * len(w) * n) // total
            s = 0
            for t in terms(text):
                if t in c:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2])))


ITEMS = "item_id bigint, text string, number bigint, rank int"


def items_of(rng, texts, n):
    """Items cut from texts, from made-up words, repeated, and awkward ones."""
    out = [(1, None), (2, ""), (3, " .,-"), (4, "unheard"), (5, "Nd nd ND, nd"), (None, "one two WORDS"), (5, "two words")]
    for i in range(10, 10 + n):
        words = terms(rng.choice(texts)) or ["a"]
        low = rng.randrange(len(words))
        out.append((i, " ".join(words[low : low + rng.randint(1, 150)])))
    return out


@pytest.mark.parametrize("k", [20, 3])
def test_rows(spark, k):
    rng = random.Random(k)
    rows = shuffled(awkward()) + [(200 + i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 40)))) for i in range(120)]
    items = items_of(rng, [t for _, t in rows], 25)
    df = spark.createDataFrame(documents(None, rows), SCHEMA).repartition(4)
    bench = spark.createDataFrame([(*i, 7, 8) for i in items], ITEMS)
    got = lexical_search.search(df, bench, k).select("item_id", "rank", "doc_id", "score").collect()
    assert order(tuple(r) for r in got) == order(brute(rows, items, k))


def test_blocks_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 100)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 30)))) for i in range(90)]
    items = items_of(rng, [t for _, t in rows], 30)
    df, bench = spark.createDataFrame(documents(None, rows), SCHEMA), spark.createDataFrame([(*i, 7, 8) for i in items], ITEMS)
    assert len(list(lexical_search._blocks(bench, "item_id", "text"))) > 1
    got = lexical_search.search(df, bench, 5).collect()
    assert order(tuple(r) for r in got) == order(brute(rows, items, 5))


@pytest.mark.parametrize("seed", range(4))
def test_masks_stop_safely_and_early(seed):
    """Slices of documents one after the other: the same ranking as by scoring all, and most documents are never scored."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(5, 60))) for _ in range(900)]
    texts += [texts[3], texts[3], " ".join(words[:80])]
    item = [texts[3], " ".join(words[60:200]), "w0 w1"]
    rows = list(enumerate(texts))
    expected = brute(rows, list(enumerate(item)))
    items = lexical_search.Items(item)
    n, total = len(texts), sum(len(terms(t)) for t in texts)
    df = Counter(t for x in texts for t in set(lexical_search.terms_of(x)))
    ranking = lexical_search.Ranking(items, np.array([lexical_search.weight(n, df[t]) for t in items.number]), 20)
    scored = []
    plain = lexical_search.best_documents

    def counted(*args):
        for d, s in plain(*args):
            scored.append(len(d))
            yield d, s

    lexical_search.best_documents, at = counted, 0
    try:
        while at < n:
            some = texts[at : at + 301]
            found = [(d, items.number[t], c, len(terms(x))) for d, x in enumerate(some) for t, c in Counter(lexical_search.terms_of(x)).items() if t in items.number]
            d, t, c, size = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
            m = np.array([lexical_search.length_factor(int(x), n, total) for x in size])
            ranking.add(lexical_search.Postings(d, t, lexical_search.impacts(c, m), len(items.number)), list(range(at, at + len(some))))
            at += 301
    finally:
        lexical_search.best_documents = plain
    got = [(i, r, d, -s) for i, own in enumerate(ranking.kept) for r, (s, _, d) in enumerate(own, 1)]
    assert got == expected
    assert sum(scored) < 0.7 * 3 * n


def test_more_terms_than_bits(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(1, 200)))) for i in range(60)]
    items = [(1, " ".join(words)), (2, " ".join(words[:130] * 2))]
    df, bench = spark.createDataFrame(documents(None, rows), SCHEMA), spark.createDataFrame([(*i, 7, 8) for i in items], ITEMS)
    assert order(tuple(r) for r in lexical_search.search(df, bench).collect()) == order(brute(rows, items))


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    df, bench = spark.createDataFrame(documents(None, awkward()), SCHEMA), spark.createDataFrame([(1, "one", 7, 8)], ITEMS)
    for a, b in ((none, bench), (df, no_items), (none, no_items)):
        out = lexical_search.search(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []


def test_supplied_documents(spark, duck):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op11_lexical_search(spark, "/root/testdata/sf0.001").select("item_id", "rank", "doc_id", "score").collect()]
    assert order(got) == order(brute(rows, items))
    sql = duck.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLES['op11_lexical_search']})").fetchall()
    assert order(sql) == order(got)
