"""Mount rows out of mount-table text and partition lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.scalars import device_text
from callscope.operators.mounts import COLLECTOR, OWN_PROCESS, PARTITION_LIST


def network_mount(fstype: Column) -> Column:
    return fstype.contains("nfs")


def parse_mountinfo(lines: DataFrame, column: str = "value") -> DataFrame:
    """Mount-table lines to (devt, MOUNT, fstype, device), network mounts only.

    Fields are split at white space; file-system type and device are the two tokens after
    the first ``-``, which stands behind any number of optional fields.
    """
    tokens = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    others = [c for c in lines.columns if c != column]
    parsed = lines.select(*others, tokens.alias("__p")).select(
        *others, "__p", F.array_position("__p", "-").cast("int").alias("__dash")
    )
    # array_position counts from 1, get() from 0.
    return parsed.select(
        *others,
        F.get("__p", F.lit(2)).alias("devt"),
        F.get("__p", F.lit(4)).alias("MOUNT"),
        F.get("__p", F.col("__dash")).alias("fstype"),
        F.get("__p", F.col("__dash") + 1).alias("device"),
    ).where((F.col("__dash") > 0) & network_mount(F.col("fstype")))


def read_mountinfo(spark: SparkSession, paths, path_pattern: str = r"([^/]+)/([^/]+)/mountinfo$") -> DataFrame:
    """Mount candidates out of collected ``<host>/<pid>/mountinfo`` files.

    The directory named ``self`` is the collector's own table, used when a process is gone.
    Files are a few kilobytes and read whole, which keeps the line numbers.
    """
    files = spark.read.text(paths, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("seen_at"),
    )
    lines = files.select(
        F.regexp_extract("path", path_pattern, 1).alias("HOSTNAME"),
        F.regexp_extract("path", path_pattern, 2).alias("PID"),
        "seen_at",
        F.posexplode(F.split("value", "\n")).alias("line_no", "value"),
    )
    source = F.when(F.col("PID") == "self", F.lit(COLLECTOR)).otherwise(F.lit(OWN_PROCESS))
    return parse_mountinfo(lines.withColumn("source", source)).drop("fstype", "PID")


def parse_partitions(partitions: DataFrame) -> DataFrame:
    """Mount candidates out of partition lists (kernel-format device numbers)."""
    return partitions.where(network_mount(F.col("fstype"))).select(
        "HOSTNAME", "seen_at", F.lit(PARTITION_LIST).alias("source"), F.lit(0).alias("line_no"),
        device_text(F.col("st_dev")).alias("devt"), F.col("mountpoint").alias("MOUNT"), "device",
    )
