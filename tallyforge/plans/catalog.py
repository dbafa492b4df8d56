"""Every query of the analytics library by name, with its SQL oracle."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import audit_queries, contract_queries, cost_queries, match_queries, merge_queries, oracles, queries, record_queries, review_oracles, review_queries, upkeep_queries

FLAGSHIP = "price_chain_latest_moves"


def _queries_of(module: ModuleType) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: f
        for name, f in vars(module).items()
        if inspect.isfunction(f) and f.__module__ == module.__name__ and list(inspect.signature(f).parameters) == ["spark", "sf_dir"] and not name.startswith("_")
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = _queries_of(queries) | _queries_of(review_queries) | _queries_of(upkeep_queries) | _queries_of(contract_queries) | _queries_of(match_queries) | _queries_of(cost_queries) | _queries_of(merge_queries) | _queries_of(record_queries) | _queries_of(audit_queries)
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL | review_oracles.ORACLE_SQL | upkeep_queries.ORACLE_SQL | contract_queries.ORACLE_SQL | match_queries.ORACLE_SQL | cost_queries.ORACLE_SQL | merge_queries.ORACLE_SQL | record_queries.ORACLE_SQL | audit_queries.ORACLE_SQL
