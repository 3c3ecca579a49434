from __future__ import annotations

import pytest

from sphaera.plans import catalog
from tests.oracle import compare

ITERATIVE = {"p3_found", "p3_predictions", "q_event_windows"}


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - ITERATIVE))
def test_query_matches_sql(spark, small, name):
    compare(spark, small, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(ITERATIVE))
def test_iterative_query_matches_sql(spark, small, name):
    compare(spark, small, catalog.QUERIES[name], catalog.SQL[name])


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_flagship_is_one_row_of_metrics(spark, small):
    row = catalog.flagship(spark, small).first().asDict()
    assert set(row) == {"acc", "nmi", "ari", "ami", "f_measure", "macro_f1", "pairwise_f1", "fmi", "purity", "rand_index"}
    assert 0 < row["acc"] <= 1


def test_scans_read_only_what_they_need(spark, small):
    plan = catalog.QUERIES["q_lineitem_ranges"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in plan and "l_orderkey" not in plan
