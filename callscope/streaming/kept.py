"""What a ``foreachBatch`` function keeps from one micro-batch to the next."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.plans.storage import delete_path, get_text, put_text

#: Micro-batches whose sizes stay readable.
REMEMBERED = 100


class Kept:
    """Named tables and whole numbers, written to two places in turn.

    A micro-batch reads what its predecessor left and writes the other place, so a replayed one finds what it found
    before. The numbers are written last: a place is only read if they are those of the batch before. The row counts of
    the last ``REMEMBERED`` micro-batches stay in ``sizes``.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def place(self, batch_id: int) -> str:
        return f"{self.folder}/{batch_id % 2}"

    def write(self, name: str, rows: DataFrame, batch_id: int) -> int:
        """Write a table; returns its number of rows."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.place(batch_id)}/{name}")
        return seen.get["n"]

    def read(self, spark: SparkSession, batch_id: int) -> Found:
        """What a micro-batch left."""
        marks = json.loads(get_text(spark, f"{self.place(batch_id)}/marks.json") or '{"batch": null}')
        if marks["batch"] != batch_id:
            raise RuntimeError(f"{self.place(batch_id)} holds micro-batch {marks['batch']}, wanted {batch_id}")
        return Found(spark, self.place(batch_id), marks["numbers"], marks["tables"])

    def close(self, spark: SparkSession, batch_id: int, numbers: dict[str, int], sizes: dict[str, int]) -> None:
        """The numbers of a micro-batch, after its tables; ``sizes`` are their row counts."""
        put_text(spark, f"{self.place(batch_id)}/marks.json", json.dumps({"batch": batch_id, "numbers": numbers, "tables": list(sizes)}))
        lines = "".join(json.dumps({"name": name, "n": n}) + "\n" for name, n in sizes.items())
        put_text(spark, f"{self.folder}/sizes/batch={batch_id}/sizes.json", lines)
        delete_path(spark, f"{self.folder}/sizes/batch={batch_id - REMEMBERED}")


class Found(NamedTuple):
    """What a micro-batch left: its numbers, and tables by name."""

    spark: SparkSession
    place: str
    numbers: dict[str, int]
    tables: list[str]

    def table(self, name: str, schema: T.StructType) -> DataFrame:
        """Empty if the micro-batch wrote none of that name."""
        if name not in self.tables:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.place}/{name}")


def kept_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, name, n): rows kept after each of the last micro-batches."""
    return spark.read.schema("name string, n long, batch long").json(f"{folder.rstrip('/')}/sizes").select("batch", "name", "n")


def payload(rows: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in rows.columns if c not in keys]
