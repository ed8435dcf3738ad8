"""Every query of the library by name, with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, and its oracle."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


from . import queries_catalog, queries_content, queries_graph, queries_layers, queries_mining, queries_session, queries_sources, queries_streaming  # noqa: E402,F401  they register themselves
