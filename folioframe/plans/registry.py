"""Registration of named queries: a function over tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def over(self, name: str, *tables: str, sql: str | None = None) -> Callable:
        """Registers a function of the named tables."""

        def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[name] = lambda spark, sf_dir: function(*(table(spark, sf_dir, t) for t in tables))
            if sql:
                self.oracle[name] = sql
            return function

        return add

    def derived(self, name: str, tables: str, views: dict[str, str], sql: str | None = None) -> Callable:
        """Registers a function of rows that both engines derive from the named tables (parted by spaces) by the same SQL:
        {table} stands for a table, {view} for a view before. `sql` goes on after the views."""
        named = tables.split()

        def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                frames = {t: table(spark, sf_dir, t) for t in named}
                for view, text in views.items():
                    frames[view] = spark.sql(text, **{n: f for n, f in frames.items() if f"{{{n}}}" in text})
                return function(*(frames[v] for v in views))

            self.queries[name] = query
            if sql:
                parts = [f"{view} AS ({text.format(**{n: n for n in [*named, *views]})})" for view, text in views.items()]
                self.oracle[name] = f"WITH {', '.join(parts)} {sql}"
            return function

        return add


def pick(key: str, *values: str) -> str:
    """SQL for one of the values by the remainder of a whole number."""
    return f"CASE CAST(({key}) % {len(values)} AS INT) {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(values))} END"
