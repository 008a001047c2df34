"""Session settings that the library's results rely on, and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Business days are Korean ones; instants are kept in UTC.
BUSINESS_ZONE = "Asia/Seoul"


def get_session(name: str = "tenderspring", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override, cluster sizes are left to the cluster."""
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.ansi.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=base | settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
