"""How a query is registered: a Spark function and, where SQL can say it, the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None):
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: comparable(query(spark, sf_dir))
        if sql is not None:
            self.sql[name] = sql


def comparable(df: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles, so results compare across engines."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)
