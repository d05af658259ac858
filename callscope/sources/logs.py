"""Logs written by hosts, as tables or as streams.

Every reader passes its schema: nothing is inferred, and TAGS stays a map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from callscope.model import (
    EXEC_SCHEMA,
    PARTITION_SCHEMA,
    PROBE_SCHEMA,
    RAW_COUNTER_SCHEMA,
    SAMPLE_SCHEMA,
)
from callscope.operators.counters import flatten_counters
from callscope.operators.tagging import exec_tags

SAMPLE_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def _read(spark: SparkSession, path, fmt: str, schema: T.StructType, stream: bool, **options) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).schema(schema).options(**options).load(path)


def probe_events(spark: SparkSession, path, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Function entries and returns (PROBE_SCHEMA)."""
    return _read(spark, path, fmt, PROBE_SCHEMA, stream, **options)


def raw_counters(spark: SparkSession, path, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Drained counters, flat. Each drain holds what happened since the one before."""
    return flatten_counters(_read(spark, path, fmt, RAW_COUNTER_SCHEMA, stream, **options))


def exec_events(spark: SparkSession, path, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Started processes with their environment text (EXEC_SCHEMA)."""
    return _read(spark, path, fmt, EXEC_SCHEMA, stream, **options)


def tagged_execs(
    spark: SparkSession, path, tracked: Sequence[str], fmt: str = "parquet", stream: bool = False, **options
) -> DataFrame:
    """Started processes that have tracked variables, with TAGS."""
    return exec_tags(exec_events(spark, path, fmt, stream, **options), tracked)


def partition_list(spark: SparkSession, path, fmt: str = "parquet", **options) -> DataFrame:
    """Partition lists of hosts (PARTITION_SCHEMA)."""
    return _read(spark, path, fmt, PARTITION_SCHEMA, False, **options)


def stored_samples(
    spark: SparkSession, path, time_format: str = SAMPLE_TIME_FORMAT, stream: bool = False, **options
) -> DataFrame:
    """Samples read back from JSON lines."""
    return _read(spark, path, "json", SAMPLE_SCHEMA, stream, timestampFormat=time_format, **options)


def table_schema(spark: SparkSession, table: str) -> T.StructType:
    """Columns of a target table as they are now."""
    spark.catalog.refreshTable(table)
    return spark.table(table).schema
