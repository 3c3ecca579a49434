"""All queries of the core and their SQL."""

from __future__ import annotations

from sphaera.plans import ball_rules, data_queries, experiments, relational

QUERIES = {**data_queries.QUERIES, **relational.QUERIES, **ball_rules.QUERIES, **experiments.QUERIES}
SQL = {**data_queries.SQL, **relational.SQL, **ball_rules.SQL, **experiments.SQL}
flagship = experiments.flagship
