"""All driver queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import whole_unions
from . import event_queries, market_queries, snapshot_queries, stream_queries
from .views import expand

_PARTS = (snapshot_queries, event_queries, market_queries, stream_queries)


def _longs(query: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers come out as longs, whatever counted them."""
    whole_unions(spark)
    out = query(spark, sf_dir)
    return out.withColumns({c: F.col(c).cast("long") for c, kind in out.dtypes if kind == "int"})


QUERIES = {name: partial(_longs, query) for part in _PARTS for name, query in part.Q.items()}
ORACLES = {name: expand(sql) for part in _PARTS for name, sql in part.O.items()}
