from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sphaera.operators import metrics


def frame(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y int, label int")


def test_equal_labels_score_one(spark):
    row = metrics.evaluate(frame(spark, [0, 0, 1, 1], [0, 0, 1, 1])).first().asDict()
    assert all(v == pytest.approx(1.0) for v in row.values())


def test_labels_may_be_renamed(spark):
    y, p = [0, 0, 1, 1, 2, 2, 2], [5, 5, -1, -1, 3, 3, 5]
    a = metrics.evaluate(frame(spark, y, p)).first()
    b = metrics.evaluate(frame(spark, y, [{5: 1, -1: 0, 3: 2}[v] for v in p])).first()
    assert tuple(a) == pytest.approx(tuple(b))


def test_single_cluster_and_null_labels(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0), (None, 0), (1, None)], "y int, label int")
    row = metrics.evaluate(df).first()
    assert row.acc == pytest.approx(2 / 3) and row.nmi == 0.0 and row.ari == 0.0 and row.purity == pytest.approx(2 / 3)


def test_empty_table_raises(spark):
    with pytest.raises(ValueError):
        metrics.evaluate(spark.createDataFrame([], "y int, label int"))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_matching_is_best(n, m, data):
    a = np.array(data.draw(st.lists(st.lists(st.integers(0, 9), min_size=m, max_size=m), min_size=n, max_size=n)))
    got = sum(a[i, j] for i, j in metrics.best_matching(a))
    wide = a if n <= m else a.T
    best = max(sum(wide[i, p[i]] for i in range(wide.shape[0])) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    assert got == best


def test_expected_information_by_enumeration():
    a, b = [2, 3], [1, 4]
    y = [0, 0, 1, 1, 1]
    total, count = 0.0, 0
    for p in set(itertools.permutations([0, 1, 1, 1, 1])):
        m = np.zeros((2, 2))
        for i, j in zip(y, p):
            m[i, j] += 1
        total += sum(m[i, j] / 5 * math.log(5 * m[i, j] / (a[i] * b[j])) for i in range(2) for j in range(2) if m[i, j])
        count += 1
    assert metrics.expected_information(np.array(a), np.array(b)) == pytest.approx(total / count)


def test_expected_information_needs_no_table_of_all_samples():
    import math

    import numpy as np

    from sphaera.operators import metrics

    for k in (0, 1, 10, 4000, 4095, 4096, 10**6, 10**9):
        assert abs(float(metrics.log_factorial(k)) - math.lgamma(k + 1)) <= 1e-9 * max(1.0, math.lgamma(k + 1))
    a, b = np.array([30, 50, 20]), np.array([60, 40])
    lg = lambda v: math.lgamma(v + 1)
    want = 0.0
    for x in a.tolist():
        for y in b.tolist():
            for k in range(max(1, x + y - 100), min(x, y) + 1):
                p = math.exp(lg(x) + lg(y) + lg(100 - x) + lg(100 - y) - lg(100) - lg(k) - lg(x - k) - lg(y - k) - lg(100 - x - y + k))
                want += k / 100 * math.log(100 * k / (x * y)) * p
    assert abs(metrics.expected_information(a, b) - want) < 1e-12
    big = metrics.expected_information(np.array([4 * 10**8, 6 * 10**8]), np.array([5 * 10**8, 5 * 10**8]))
    assert 0 < big < 1e-8
