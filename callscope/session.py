"""Session settings the operators count on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # What is kept in memory has as many partitions as its bytes need, not all that a shuffle has: each one is a task in every
    # later job, and a file per day in every sink.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    # Wide aggregates (65 sums) are generated as one function per sum.
    "spark.sql.codegen.aggregate.splitAggregateFunc.enabled": "true",
    # A join whose small side was filtered thins out the large side's scan before the shuffle, from this size on.
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "64MB",
    # Keyed stream state with large buffers lives off heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A commit writes what changed, not a snapshot of the whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set what can be set on a running session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings_held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs that run meanwhile; afterwards they are as they were."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def build_session(name: str = "callscope", **settings) -> SparkSession:
    """A session with the settings above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
