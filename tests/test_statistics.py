"""Tabulated t and normal values, and rank-sum tests against enumeration."""

import tracemalloc
from itertools import combinations
from math import comb

import pytest

from inkstream.functions import stats
from inkstream.operators import experiments as B


@pytest.mark.parametrize(
    "p,df,want", [(0.975, 1, 12.7062), (0.975, 10, 2.2281), (0.975, 30, 2.0423), (0.95, 5, 2.0150), (0.975, 1e6, 1.95996)]
)
def test_t_quantile(p, df, want):
    assert stats.t_quantile(p, df) == pytest.approx(want, abs=1e-4)


def test_t_two_sided():
    assert stats.t_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0)


@pytest.mark.parametrize("n1,n2", [(3, 4), (2, 6), (5, 5)])
def test_exact_rank_sum(n1, n2):
    ranks = range(1, n1 + n2 + 1)
    sums = [sum(c) for c in combinations(ranks, n1)]
    for r1 in set(sums):
        u1 = r1 - n1 * (n1 + 1) / 2
        u = max(u1, n1 * n2 - u1)
        tail = sum(1 for s in sums if s - n1 * (n1 + 1) / 2 >= u) / len(sums)
        assert stats.rank_sum_p(r1, n1, n2, 0) == pytest.approx(min(1.0, 2 * tail))


def test_normal_approximation_with_ties():
    # all values equal: no evidence
    n = 40
    assert stats.rank_sum_p(n * (n + 0.5), n, n, (2 * n) ** 3 - 2 * n) == 1.0


def test_small_samples_use_ranks(rows):
    data = [("m", i, "control", float(i)) for i in range(5)] + [("m", 9 + i, "treatment", 10.0 + i) for i in range(4)]
    r = B.significance(rows(data, "metric string, user_id int, variant string, value double")).collect()[0]
    assert r.test == "mann_whitney_u"
    assert r.p_value == pytest.approx(2 / 126)
    assert r.is_significant


def test_large_samples_use_t(rows):
    data = [("m", i, "control", float(i % 5)) for i in range(50)] + [("m", 99 + i, "treatment", float(i % 5) + 0.5) for i in range(50)]
    events = rows(data, "metric string, user_id int, variant string, value double")
    r = B.significance(events).collect()[0]
    # t = 0.5 / sqrt(pooled * 2/50), pooled = (50*2 + 50*2) / 98
    t = 0.5 / (200 / 98 * 2 / 50) ** 0.5
    assert r.test == "t_test"
    assert r.p_value == pytest.approx(stats.t_two_sided(t, 98))
    report = B.experiment_report(events).collect()
    assert {x.participants for x in report} == {50}
    assert all(x.ci_low < x["mean"] < x.ci_high for x in report)


def test_missing_value_is_zero(rows):
    events = rows([("m", 1, "control", None), ("m", 2, "control", 4.0)], "metric string, user_id int, variant string, value double")
    r = B.variant_stats(events).collect()[0]
    assert (r.n, r["mean"], r["std"], r["median"]) == (2, 2.0, 2.0, 2.0)


def test_rank_sum_is_exact_whatever_the_sizes():
    """The method does not change with n1 * n2."""
    for n in (12_500, 12_501, 200_000):
        u = 0.725 * 8 * n
        p, normal = stats.rank_sum_p(u + 36, 8, n, 0), stats.rank_sum_p(u + 36, 8, n, 1e-9)
        assert p != normal and p == pytest.approx(0.0256, abs=1e-4)


def counted(m, n):
    """Arrangements by U, by the recurrence over the largest value."""
    table = {}

    def ways(m, n):
        if (m, n) not in table:
            if m == 0 or n == 0:
                table[m, n] = [1]
            else:
                out = [0] * (m * n + 1)
                for at, c in enumerate(ways(m - 1, n)):
                    out[at + n] += c
                for at, c in enumerate(ways(m, n - 1)):
                    out[at] += c
                table[m, n] = out
        return table[m, n]

    return ways(m, n)


@pytest.mark.parametrize("m,n", [(1, 1), (1, 9), (2, 30), (3, 17), (5, 40), (7, 23), (8, 8), (8, 60)])
def test_exact_rank_sum_equals_counting(m, n):
    ways = counted(m, n)
    assert sum(ways) == comb(m + n, m)
    below = 0
    for v, c in enumerate(ways):
        below += c
        assert stats._partitions_up_to(v, m) >= below
        if 2 * v <= m * n:
            p = min(1.0, 2 * below / comb(m + n, m))
            assert stats.rank_sum_exact(m * n - v, m, n) == stats.rank_sum_exact(m * n - v, n, m) == p
    assert stats.rank_sum_exact(m * n + 1, m, n) == 0.0


def test_exact_rank_sum_takes_no_memory_for_the_larger_sample():
    stats.rank_sum_exact(100, 8, 20)  # the table for eight values
    tracemalloc.start()
    n = 10**8
    found = {share: stats.rank_sum_exact(share * 8 * n, 8, n) for share in (0.5, 0.725, 0.9, 1.0)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000
    assert found[0.5] == 1.0 and found[1.0] == 2 / comb(n + 8, 8)
    assert found[0.725] == pytest.approx(stats.rank_sum_exact(0.725 * 8 * 10**6, 8, 10**6), rel=1e-4)
