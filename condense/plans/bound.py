"""Register of the queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from condense.operators.frames import FRAME_CHUNK
from condense.operators.series import CHUNK_ROWS

#: Rows per chunk of the queries' series and frames; the tests make them tiny.
SIZES = {"series": CHUNK_ROWS, "frames": FRAME_CHUNK}

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None):
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
