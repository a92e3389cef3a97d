"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.plans import analytics, files, frames, media, streams, vectors  # noqa: F401  (they register their queries)
from framelake.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five keepers of each file."""
    return QUERIES["op069_topk_per_file"](spark, sf_dir)
