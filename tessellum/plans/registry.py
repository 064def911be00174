"""Name -> query and name -> oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import bindings
from .dialect import Duck, Spark, doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def statement(name: str, *tables: str):
    """Registers a function of a dialect that returns one statement over the named tables, as query and oracle."""

    def add(sql):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(doubles(sql(Spark)), **{t: bindings.load(spark, sf_dir, t) for t in tables})

        query.__doc__ = sql.__doc__
        QUERIES[name] = query
        ORACLES[name] = oracle(sql(Duck), *tables)
        return sql

    return add


def oracle(sql: str, *tables: str) -> str:
    """A DuckDB statement with the logical tables in front."""
    sql = doubles(sql)
    below = [n for t in tables if t in bindings.LOGICAL for n in bindings.LOGICAL[t][1] if n in bindings.LOGICAL]
    logical = [t for t in dict.fromkeys([*below, *tables]) if t in bindings.LOGICAL]
    heads = [f"{t} AS ({doubles(bindings.LOGICAL[t][0](Duck))})" for t in logical]
    body = sql.strip()
    if not heads:
        return body
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return word + ", ".join(heads) + ", " + body[len(word) :]
    return "WITH " + ", ".join(heads) + " " + body


def frame(name: str, sql: str | None = None, *tables: str):
    """Registers a DataFrame query; ``sql`` is its oracle over the named tables, if SQL can express it."""

    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = oracle(sql, *tables)
        return query

    return add


from . import evaluation, graph, queues, records, retrieval, operations, scoring, shaping, streams, text, vectors, verification, writes  # noqa: E402, F401
