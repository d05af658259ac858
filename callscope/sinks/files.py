"""Samples as JSON lines in files, by date, with rotation by size."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions.records import json_iso
from callscope.model import DEFAULT_FILE_BACKUPS
from callscope.plans.lookup import lookup
from callscope.plans.storage import delete_path, get_text, names_in, put_text
from callscope.sinks.base import Sink, register_sink

#: A batch is put in order in lanes of about this many bytes.
LANE_BYTES = 32 << 20


@register_sink("file")
class JsonFileSink(Sink):
    """Writes ``<path>/batch=<id>/date=<day>/``; a replayed batch replaces itself, so a path
    belongs to one checkpoint. ``max_records`` bounds the rows per file.

    With ``max_size_mb`` the log rotates: ``<path>/volume=<n>/batch=<id>/date=<day>/``, where a volume holds at most
    that many bytes, whatever the batches' sizes. The newest volume and ``max_backups`` older ones are kept, and all volumes of the
    batch just written, so nothing is deleted before it was there for a whole batch. A line longer than a volume has one
    of its own.
    """

    def __init__(
        self,
        path: str,
        max_records: int = 500_000,
        max_size_mb: float | None = None,
        max_backups: int = DEFAULT_FILE_BACKUPS,
        lane_bytes: int = LANE_BYTES,
    ):
        self.path = path.rstrip("/")
        self.max_records = max_records
        self.max_bytes = None if max_size_mb is None else int(max_size_mb * 1024 * 1024)
        self.max_backups = max_backups
        self.lane_bytes = lane_bytes

    def write(self, batch: DataFrame, batch_id: int) -> None:
        lines = batch.select(
            json_iso(batch).alias("value"), F.date_format("TIMESTAMP", "yyyy-MM-dd").alias("date")
        )
        if self.max_bytes is not None:
            self._rotate(lines, batch_id)
            return
        (
            lines.write.mode("overwrite").partitionBy("date")
            .option("maxRecordsPerFile", self.max_records)
            .text(f"{self.path}/batch={batch_id}")
        )

    def _rotate(self, lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        open_volume, used = self._before(spark, batch_id)
        sized = lines.withColumn("bytes", F.octet_length("value").cast("long") + 1).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sums = sized.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("longest")).first()
            total = sums["total"]
            if total is None:
                return
            limit = max(1, self.max_bytes - sums["longest"])
            last = open_volume + (used + total - 1) // limit  # where the last line ends
            lanes = -(-total // self.lane_bytes)
            # As many tasks as the bytes ask for: a task opens files for all that come after it, which for the hundreds of
            # partitions of a session is more work than the rows of a small batch.
            tasks = max(-(-total // LANE_BYTES), min(last - open_volume + 1, spark.sparkContext.defaultParallelism))
            placed = in_volumes(sized.coalesce(tasks), open_volume, used, limit, lanes, tasks)
            seen = Observation()
            (
                placed.withColumn("batch", F.lit(batch_id)).repartition(tasks, "volume", "date")
                .observe(seen, F.min("volume").alias("first"), F.sum(F.when(F.col("volume") == last, F.col("bytes"))).alias("filled"))
                .select("value", "volume", "batch", "date")
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume", "batch", "date")
                .option("maxRecordsPerFile", self.max_records).text(self.path)
            )
            first = seen.get["first"]
            filled = seen.get["filled"] + (used if last == open_volume else 0)
        finally:
            sized.unpersist()
        put_text(spark, f"{self.path}/_volumes/{batch_id}", json.dumps({"volume": last, "used": filled}))
        oldest = min(first, last - self.max_backups)
        for name in names_in(spark, self.path):
            if name.startswith("volume=") and int(name[len("volume="):]) < oldest:
                delete_path(spark, f"{self.path}/{name}")
        for name in self._marks(spark, batch_id)[:-1]:
            delete_path(spark, f"{self.path}/_volumes/{name}")

    def _marks(self, spark: SparkSession, batch_id: int) -> list[int]:
        """Batches before this one whose end is known, in order."""
        return sorted(int(n) for n in names_in(spark, f"{self.path}/_volumes") if n.isdigit() and int(n) < batch_id)

    def _before(self, spark: SparkSession, batch_id: int) -> tuple[int, int]:
        """(open volume, its bytes) after the batch before, so that a replayed batch goes where it went before."""
        marks = self._marks(spark, batch_id)
        if not marks:
            return 0, 0
        mark = json.loads(get_text(spark, f"{self.path}/_volumes/{marks[-1]}"))
        return mark["volume"], mark["used"]

    def files(self, spark: SparkSession) -> DataFrame:
        """The files as (HOSTNAME, path, modified, bytes), the path standing for the log."""
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(self.path)
        return listed.select(
            F.lit(self.path).alias("HOSTNAME"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")
        )


def in_volumes(sized: DataFrame, open_volume: int, used: int, limit: int, lanes: int, tasks: int) -> DataFrame:
    """Lines (value, bytes, ...) with the ``volume`` in which each ends, volumes being ``limit`` bytes apart.

    The order is that of lanes, by a hash of the line, and in a lane that of the lines: the same rows always go to the same
    volumes. A running sum walks one lane at a time; what comes before a lane follows from the lanes' totals. Both read one
    shuffle of the lines, to ``tasks`` tasks.
    """
    number = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long")
    rows = sized.withColumn("lane", number % lanes).repartition(tasks, "lane")
    upto = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("lane").agg(F.sum("bytes").alias("n")).select(
        "lane", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("lane").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = lookup(rows.withColumn("until", F.sum("bytes").over(inside)), before, ["lane"], how="inner")
    return ended.withColumn("volume", F.lit(open_volume) + F.expr(f"(until + before + {used} - 1) div {limit}")).drop("lane", "until", "before")
