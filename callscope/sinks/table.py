"""Samples in a typed table whose columns decide what is stored."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.model import DEFAULT_SCHEMA_REFRESH, TABLE_SCHEMA, TAG_COLUMN_PREFIX
from callscope.operators.conform import conform, tag_column_changes, tag_columns
from callscope.plans.storage import delete_path, move_path, names_in, path_exists, put_text
from callscope.sinks.base import Sink, register_sink
from callscope.sources.logs import table_schema

log = logging.getLogger(__name__)

PLACES = {"date": "STRING", "batch_id": "BIGINT"}


def create_sample_table(
    spark: SparkSession, table: str, schema: T.StructType = TABLE_SCHEMA, fmt: str = "parquet"
) -> None:
    """Create the database and the table of a name ``database.table`` where they are missing.

    The table is partitioned by day, so that a time range is read alone, and by micro-batch, so
    that a replayed one replaces itself.
    """
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    placed = ", ".join(f"`{name}` {kind}" for name, kind in PLACES.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {placed}) USING {fmt} PARTITIONED BY ({', '.join(PLACES)})"
    )


def with_places(samples: DataFrame, batch_id: int) -> DataFrame:
    """The partition columns of a sample table."""
    return samples.withColumns({
        "date": F.date_format("TIMESTAMP", "yyyy-MM-dd"), "batch_id": F.lit(batch_id).cast("long"),
    })


def missing_columns(samples: DataFrame, target: T.StructType) -> list[str]:
    return [
        f.name for f in target.fields
        if not f.name.startswith(TAG_COLUMN_PREFIX) and f.name not in samples.columns and f.name not in PLACES
    ]


_overwriting = Lock()


@contextmanager
def dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Inserts overwrite the partitions they write, and no others. An insert takes this from the session alone, so it is
    set for the time of the insert, one insert at a time."""
    key = "spark.sql.sources.partitionOverwriteMode"
    with _overwriting:
        before = spark.conf.get(key)
        spark.conf.set(key, "dynamic")
        try:
            yield
        finally:
            spark.conf.set(key, before)


@register_sink("table")
class TableSink(Sink):
    """Stores samples, fitted to the table's columns.

    In a table with the partitions of ``create_sample_table`` a replayed micro-batch replaces
    itself. Other tables are appended to: at least once, or with ``ledger``, a folder that belongs to one checkpoint and
    table, exactly once. A batch is then written beside the table's files, moved among them under names that begin with
    its number, and entered in the ledger; a replay of an entered batch adds nothing, one that was cut off is moved anew.
    This needs a table without partitions that keeps its rows in files.

    With ``learn_tags`` the tracked names are those of the table's tag columns. The schema is
    read again when older than ``refresh_seconds``; a write that does not fit reads it again
    and is tried once more. A column the samples lack always fails, without a second try.
    """

    def __init__(
        self,
        table: str,
        learn_tags: bool = False,
        refresh_seconds: float = DEFAULT_SCHEMA_REFRESH,
        on_tags: Callable[[list[str]], None] | None = None,
        clock: Callable[[], float] = time.monotonic,
        ledger: str | None = None,
    ):
        self.table = table
        self.learn_tags = learn_tags
        self.refresh_seconds = refresh_seconds
        self.on_tags = on_tags
        self.clock = clock
        self.schema: T.StructType | None = None
        self.tracked: list[str] = []
        self.read_at = 0.0
        self.ledger = ledger and ledger.rstrip("/")
        self.retries = 0

    def setup(self, spark: SparkSession) -> None:
        self.refresh(spark)

    def refresh(self, spark: SparkSession) -> None:
        self.schema = table_schema(spark, self.table)
        if self.learn_tags:
            names = tag_columns(self.schema)
            added, removed = tag_column_changes(self.tracked, names)
            if added:
                log.info("tag columns added: %s", ",".join(added))
            if removed:
                log.info("tag columns removed: %s", ",".join(removed))
            self.tracked = names
            if self.on_tags:
                self.on_tags(names)
        self.read_at = self.clock()

    def before(self, spark: SparkSession) -> None:
        """Names learned here serve the rows that are about to be prepared."""
        if self.schema is None or (self.learn_tags and self.clock() - self.read_at >= self.refresh_seconds):
            self.refresh(spark)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.before(batch.sparkSession)
        lacking = missing_columns(batch, self.schema)
        if lacking:
            # Left to Spark, which names the column in its error.
            conform(batch, self.schema)
        try:
            self._store(batch, batch_id)
        except (AnalysisException, ArithmeticException, NumberFormatException) as misfit:
            self._retry(batch, batch_id, misfit)
        except PySparkException as failed:
            if "CAST" not in (failed.getCondition() or ""):
                raise
            self._retry(batch, batch_id, failed)

    def _retry(self, batch: DataFrame, batch_id: int, error: Exception) -> None:
        if not self.learn_tags:
            raise error
        self.retries += 1
        self.refresh(batch.sparkSession)
        self._store(batch, batch_id)

    def _store(self, batch: DataFrame, batch_id: int) -> None:
        if set(PLACES) <= set(self.schema.names):
            # Only the partitions that the batch itself writes are replaced.
            fitted = conform(with_places(batch, batch_id), self.schema)
            with dynamic_overwrite(batch.sparkSession):
                fitted.write.mode("overwrite").insertInto(self.table)
        elif self.ledger is None:
            conform(batch, self.schema).write.insertInto(self.table)
        elif not path_exists(batch.sparkSession, f"{self.ledger}/{batch_id}"):
            self._store_once(batch, batch_id)

    def _store_once(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").collect()}
        if "# Partition Information" in described:
            raise ValueError(f"{self.table} has partitions of its own: a ledger cannot be kept for it")
        location, fmt = described["Location"].rstrip("/"), described["Provider"]
        staged, own = f"{location}/_staged/{batch_id}", f"batch-{batch_id}-"
        conform(batch, self.schema).write.mode("overwrite").format(fmt).save(staged)
        for name in names_in(spark, location):
            if name.startswith(own):  # moved by an attempt that was cut off
                delete_path(spark, f"{location}/{name}")
        for name in names_in(spark, staged):
            if name.startswith("part-"):
                move_path(spark, f"{staged}/{name}", f"{location}/{own}{name}")
        put_text(spark, f"{self.ledger}/{batch_id}", self.table)
        delete_path(spark, staged)
        spark.catalog.refreshTable(self.table)
