import random
from collections import Counter

import numpy as np
import pytest
from data import SCHEMA, awkward, documents, shuffled, words

from inkstream.llm import ngram_join as N
from inkstream.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, n, percent):
    """(doc_id, set size) of every row and the smallest reachable id, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(smallest.get(find(i), key), key)
    return Counter((key, len(sets[i]), smallest.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows))


def run(spark, rows, n, percent):
    df = spark.createDataFrame(documents(None, rows), SCHEMA)
    return Counter(tuple(r) for r in N.similar_groups(df, n=n, percent=percent).collect())


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_awkward_rows(spark, n, percent):
    rows = shuffled(awkward())
    assert run(spark, rows, n, percent) == brute(rows, n, percent)


def test_chains_of_near_copies_around_the_threshold(spark):
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = words(rng, rng.choice([8, 12, 20, 45, 90, 160]), "abcdefghijklmnop").split()
        for copy in range(8):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 14))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            rows.append((100 * group + copy, " ".join(own)))
            if copy % 3 == 0:
                base = own  # links chain on
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_BLOCK", 8)
    monkeypatch.setattr(N, "CLUSTER_BLOCK", 8)
    rng = random.Random(5)
    base = words(rng, 100, "abcdefghijklmnop").split()
    rows = []
    for copy in range(60):
        own = list(base)
        own[rng.randrange(100)] = f"w{copy}"
        rows.append((copy, " ".join(own)))
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_empty_table(spark):
    assert N.similar_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_parts_find_every_linked_pair():
    rng = np.random.default_rng(3)
    for _ in range(400):
        percent = int(rng.choice([80, 85, 95]))
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        drop = rng.integers(0, max(1, size // 6) + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, int(rng.integers(0, 12)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and common and 100 * common >= percent * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
            keys = [
                {k for c in N.classes_of(len(s), percent) for k in N.part_keys(s, c, percent).tolist()} for s in (a, b)
            ]
            assert keys[0] & keys[1]


def test_trees_lose_no_linked_pair():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    sets = []
    for _ in range(70):
        keep = rng.random(200) > rng.choice([0.0, 0.03, 0.08, 0.6])
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**64, int(rng.integers(0, 15)), dtype=np.uint64)])))
    size_class = max(N.classes_of(max(map(len, sets)), 85))
    maps = np.stack([N.bitmap(s, size_class) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = N.SignatureTree(maps, sizes)
    found = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in N.dual_traversal(tree, tree, 85)), strict=True)}
    linked = set(zip(*(x.tolist() for x in N.linked_pairs(sets, None, 85)), strict=True))
    exact = {
        (i, j) for j in range(70) for i in range(j)
        if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]))
    }
    assert linked == exact and exact <= found and len(found) < 70 * 69 / 2
    left, right = N.SignatureTree(maps[:30], sizes[:30]), N.SignatureTree(maps[30:], sizes[30:])
    across = set(zip(*(x.tolist() for x in N.dual_traversal(left, right, 85)), strict=True))
    assert {(i, j - 30) for i, j in exact if i < 30 <= j} <= across


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = dict(connected_components(df).collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert connected_components(df.where("a < 0")).collect() == []
