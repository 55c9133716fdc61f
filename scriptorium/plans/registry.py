"""Where queries and the SQL that checks them are registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, views: str = ""):
    """Registers a function of (spark, sf_dir) under its name; oracle is DuckDB SQL, which may use the named views."""

    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = with_views(views, oracle)
        return function

    return register
