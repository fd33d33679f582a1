"""All registered queries and the SQL they are checked with."""

from __future__ import annotations

from cohortspan.plans import api, arrivals, basics, charts, checks, loading, scoring  # noqa: F401
from cohortspan.plans.define import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
