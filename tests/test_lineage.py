"""Closures by packed starts against plain searches."""

import random
from collections import deque

import pytest

from inkstream.operators import lineage as N


def distances(pairs, start):
    """Distance of every node that a plain breadth-first search reaches."""
    out, queue = {start: 0}, deque([start])
    while queue:
        node = queue.popleft()
        for other in pairs.get(node, ()):
            if other not in out:
                out[other] = out[node] + 1
                queue.append(other)
    del out[start]
    return out


def sides(edges):
    down, up = {}, {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)
        up.setdefault(b, set()).add(a)
    return down, up


def graph(rng, nodes, n):
    """Random edges with cycles, loops and repeats."""
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(3, 3), (1, 2), (1, 2), (2, 1)]


@pytest.mark.parametrize("seed,starts", [(1, 1), (2, 64), (3, 65), (4, 150)])
def test_closures_equal_plain_searches(spark, rows, seed, starts):
    rng = random.Random(seed)
    edges = graph(rng, 150, 170)
    chosen = sorted(rng.sample(range(160), starts))  # some have no edge
    down, up = sides(edges)
    df, s = rows(edges, "src long, dst long"), rows([(c,) for c in [*chosen, chosen[0]]], "s long")
    for way, side in (("downstream", down), ("upstream", up)):
        got = sorted(tuple(r) for r in N.reachable(df, s, way).collect())
        assert got == sorted((c, node, d) for c in chosen for node, d in distances(side, c).items())
    both = {c: (distances(down, c), distances(up, c)) for c in chosen}
    depth = {r.start: r.lineage_depth for r in N.lineage_depth(df, s).collect()}
    assert depth == {c: max([0, *a.values(), *b.values()]) for c, (a, b) in both.items()}
    score = {r.start: r.impact_score for r in N.impact_score(df, s, spark.range(160)).collect()}
    assert score == {c: pytest.approx(min(1.0, (len(a) + len(b)) / 160)) for c, (a, b) in both.items()}
    counts = {r.start: tuple(r)[1:] for r in N.impact_analysis(df, s).collect()}
    assert counts == {
        c: (len(a), len(b), max([0, *a.values()]), max([0, *b.values()]), len(a) + len(b)) for c, (a, b) in both.items()
    }


def test_limits_and_empty_tables(spark, rows):
    df, s = rows([(i, i + 1) for i in range(12)], "src long, dst long"), rows([(0,)], "s long")
    assert sorted(r.node for r in N.reachable(df, s, max_hops=3).collect()) == [1, 2, 3]
    assert max(r.distance for r in N.reachable(df, s, target=5).collect()) == 5
    none, nobody = rows([], "src long, dst long"), rows([], "s long")
    assert N.reachable(none, s).collect() == [] and N.reachable(df, nobody).collect() == []
    assert [tuple(r) for r in N.lineage_depth(none, s).collect()] == [(0, 0)]


def test_names_as_nodes(spark, rows):
    df, s = rows([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string"), rows([("a",), ("z",)], "s string")
    assert sorted(tuple(r) for r in N.reachable(df, s).collect()) == [("a", "b", 1), ("a", "c", 2)]


def test_rounds_stay_packed_with_many_starts(spark, rows):
    """10 000 starts above a small graph: no round has more rows than nodes times words."""
    rng = random.Random(7)
    core = [(rng.randrange(100), rng.randrange(100)) for _ in range(250)]
    starts = range(1000, 11_000)
    edges = core + [(i, rng.randrange(100)) for i in starts]
    df, s = rows(edges, "src long, dst long"), spark.range(1000, 11_000).toDF("s")
    numbered = N.numbered_starts(s)
    words = -(-10_000 // 64)
    assert numbered.select("word").distinct().count() == words and numbered.distinct().count() == 10_000
    found = N.levels(df, numbered, ["downstream"])
    sizes = {r["distance"]: r["count"] for r in found.groupBy("distance").count().collect()}
    assert len(sizes) > 2 and max(sizes.values()) <= 100 * words
    down, _ = sides(edges)
    want = {i: distances(down, i) for i in starts}
    got = {}
    for r in N.per_start(found, numbered).collect():
        got.setdefault(r["start"], {})[r["distance"]] = r["n"]
    for i in starts:
        counts = {}
        for d in want[i].values():
            counts[d] = counts.get(d, 0) + 1
        assert got[i] == counts
    assert sum(sizes.values()) < sum(map(len, want.values())) / 5


def smallest_path(down, source, target):
    """The smallest of the shortest paths, by levels of whole paths."""
    paths, seen = {source: (source,)}, {source}
    while paths:
        if target in paths:
            return paths[target]
        grown = {}
        for node, path in paths.items():
            for other in down.get(node, set()) - seen:
                grown[other] = min(grown.get(other, (float("inf"),)), (*path, other))
        seen |= grown.keys()
        paths = grown
    return ()


def flow(df, source, target):
    found = sorted(N.data_flow(df, source, target).collect(), key=lambda r: r.step)
    assert all(r.path_length == len(found) and r.step == i for i, r in enumerate(found, 1))
    return [(r.src, r.dst) for r in found]


def test_one_path_is_the_smallest_shortest(spark, rows):
    rng = random.Random(11)
    layers = [(10 * i + rng.randrange(4), 10 * i + 10 + rng.randrange(4)) for i in range(9) for _ in range(7)]
    edges = [(0, 10), *layers, (4, 4), (21, 3), (90, 12), (None, 5), (7, None)]
    df, (down, _) = rows(edges, "src long, dst long"), sides([e for e in edges if None not in e])
    nodes = [n for n in down if distances(down, n)]
    pairs = [(0, 93), (0, 90), (0, 0), (93, 0), (4, 4), (0, 777), (777, 0)]
    pairs += [(a, rng.choice(sorted(distances(down, a)))) for a in rng.sample(nodes, 2)]
    for a, b in pairs:
        path = smallest_path(down, a, b) if a != b else ()
        assert flow(df, a, b) == list(zip(path, path[1:], strict=False)), (a, b)
    assert flow(rows([], "src long, dst long"), 1, 2) == []
    assert flow(rows([("b", "c"), ("a", "b")], "src string, dst string"), "a", "c") == [("a", "b"), ("b", "c")]


def test_a_long_way_is_followed_in_few_rounds(spark, rows, monkeypatch):
    """1 000 pointers: ten rounds of two written tables at most, and nothing longer than a node in a row."""
    written, cut = [], N.cut_lineage

    def counted(df):
        written.append(df.columns)
        return cut(df)

    monkeypatch.setattr(N, "cut_lineage", counted)
    chain = rows([(i, i + 1) for i in range(1000)], "src long, dst long")
    way = N._followed(rows([(0,)], "node long"), chain, 1000)
    assert sorted((r.place, r.node) for r in way.collect()) == [(i, i) for i in range(1001)]
    assert len(written) <= 20 and all(c in (["place", "node"], ["src", "dst"]) for c in written)
