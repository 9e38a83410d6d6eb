"""Where plans enter their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.sources.views import Tables, with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 digits without negative zero, counts as long."""
    def one(c: str, kind: str):
        if kind in ("double", "float"):
            return (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c)
        return F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c)

    return df.select(*[one(c, k) for c, k in df.dtypes])


def add(name: str, build: Callable[[Tables], DataFrame], views: str = "", sql: str | None = None) -> None:
    """Registers `build` over the views as a query, with its SQL over the named views."""
    QUERIES[name] = lambda spark, folder: tidy(build(Tables(spark, folder)))
    if sql is not None:
        SQL[name] = with_views(views, sql) if views else sql
