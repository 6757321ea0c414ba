"""Every registered query of the core library with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "e03_funnel"


def _counts(sql: str) -> str:
    """DuckDB's count_if gives 128-bit numbers; a plain count of cases gives what Spark does."""
    while (at := sql.find("count_if(")) >= 0:
        start, depth, end = at + len("count_if("), 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[start : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query over the tables of a folder, and its DuckDB SQL if SQL can express it."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if oracle:
            ORACLE_SQL[name] = _counts(oracle)
        return function

    return register


def _load() -> None:
    from lexforge.plans import q_analytics, q_chunks, q_dedup, q_discovery, q_files, q_gates, q_merge, q_records, q_retrieval, q_scalars, q_telemetry  # noqa: F401


_load()
