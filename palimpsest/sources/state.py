"""The carried state of a history, kept as numbered versions in one folder.

A version is added as a whole and the last one counts, so a state can be read while its successor is
written, and a run that fails leaves the state as it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"


def last_version(spark: SparkSession, path: str) -> int:
    """The number of the last version, or 0 where nothing was written yet."""
    try:
        versions = spark.read.parquet(path).select(VERSION)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise
    return versions.agg(F.coalesce(F.max(VERSION), F.lit(0))).first()[0]


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    version = last_version(spark, path)
    if not version:
        return None
    return spark.read.parquet(path).filter(F.col(VERSION) == version).drop(VERSION)


def write_state(state: DataFrame, path: str) -> None:
    version = last_version(state.sparkSession, path) + 1
    numbered = state.withColumn(VERSION, F.lit(version))
    numbered.write.mode("append").partitionBy(VERSION).parquet(path)
