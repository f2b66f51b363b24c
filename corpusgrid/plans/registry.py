"""All queries of the library proper, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (tables) -> DataFrame under its name, with the SQL that DuckDB runs over the same tables."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql.strip()
        return f

    return keep


class Tables:
    """Attribute access to the Parquet tables of a folder: tables.documents."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


from corpusgrid.plans import corpus, ensembles, evaluation, graphs, lexicons, sampling, scenes, streams, text  # noqa: E402, F401
