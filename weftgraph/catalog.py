"""All registered queries of the graph engine and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.binding import Graph, sql, stored_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of a Graph; oracle is DuckDB SQL over the bound tables, see binding.sql()."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(stored_graph(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return add


from .plans import q_evaluate, q_incremental, q_ledger, q_reads, q_retrieve, q_text, q_traverse  # noqa: E402, F401
