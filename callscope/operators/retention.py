"""Which stored sample files to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.model import DEFAULT_FILE_BACKUPS, DEFAULT_FILE_MB


def retained_files(
    files: DataFrame,
    max_size_mb: float = DEFAULT_FILE_MB,
    max_backups: int = DEFAULT_FILE_BACKUPS,
    log: str = "HOSTNAME",
) -> DataFrame:
    """Of (log, path, modified, bytes) rows, the files of each log to keep.

    A log is one current file and ``max_backups`` older ones of at most ``max_size_mb``
    each. Kept are the newest files while both their number and their total size fit. The
    rank filter runs first and prunes each task's rows, so a log with very many files
    never gathers in one place.
    """
    slots = max_backups + 1
    newest = Window.partitionBy(log).orderBy(F.col("modified").desc(), F.col("path").desc())
    running = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = files.withColumn("slot", F.row_number().over(newest).cast("long")).where(F.col("slot") <= slots)
    budget = F.lit(int(max_size_mb * 1024 * 1024 * slots))
    return (
        ranked.withColumn("total_bytes", F.sum("bytes").over(running))
        .where(F.col("total_bytes") <= budget)
    )
