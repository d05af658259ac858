"""Pairing function entries with returns, per thread.

A return consumes the open entry of its thread; a later entry replaces an open one. So a
return completes a call exactly when the row before it on the thread is an entry. The
operation counted is the return's; device and requested bytes are the entry's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.model import (
    CALLER_COLUMNS,
    FILE_OPERATIONS,
    KEPT_FILE_TYPES,
    MODE_TYPE_MASK,
    OP_NUMBER,
    PROBES,
)

THREAD = ["HOSTNAME", "TID"]
HIT_ORDER = ["t_ns", "seq", "phase"]
DEFAULT_SLICE_SECONDS = 3600


def probe_dimension(spark) -> DataFrame:
    """Probe name -> operation number and whether its entries are file-filtered (26 fixed rows)."""
    rows = [(probe, OP_NUMBER[op], op in FILE_OPERATIONS) for probe, op in PROBES.items()]
    return spark.createDataFrame(rows, "probe string, OP_NO int, file_filtered boolean")


def name_operations(events: DataFrame) -> DataFrame:
    """Attach the operation of each probe; events of unknown probes are dropped."""
    dimension = probe_dimension(events.sparkSession)
    return events.join(F.broadcast(dimension), "probe")


def keeps_file() -> Column:
    """A named regular file, directory or symbolic link."""
    kind = F.col("mode").bitwiseAND(F.lit(MODE_TYPE_MASK))
    return (F.col("name_len") > 0) & kind.isin(KEPT_FILE_TYPES)


def drop_unwanted_entries(events: DataFrame) -> DataFrame:
    """File filter on entry rows of file operations. Must run before pairing: a dropped
    entry does not replace an open one."""
    checked = (F.col("phase") == "E") & F.col("file_filtered")
    return events.where(~checked | F.coalesce(keeps_file(), F.lit(False)))


def pair_calls(events: DataFrame, slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """Completed calls of an event log with the columns of PROBE_SCHEMA.

    One thread may hold a large part of the log, so a thread's rows are looked at in time
    slices: inside a slice the previous row is a plain ``lag``. Only the first row of a slice
    needs its neighbour from an earlier slice; first and last rows of all slices (two per
    slice) go through a second ``lag`` per thread. Both branches read one shuffle of the log.
    Shorter slices suit busier threads.
    """
    return pair_hits(wanted_hits(events), slice_seconds)


def wanted_hits(events: DataFrame) -> DataFrame:
    """Entries and returns of known operations, without the entries that the file filter drops.

    A missing return code counts as success, missing bytes as none, and a missing device as -1,
    which no mount has; so tables and streams agree.
    """
    hits = events.where(F.col("phase").isin("E", "R"))
    return drop_unwanted_entries(name_operations(hits)).select(
        *CALLER_COLUMNS, "phase", "t_ns", "seq", "OP_NO",
        *[F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in (("sbdev", -1), ("bytes", 0), ("rc", 0))],
    )


def pair_hits(rows: DataFrame, slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """``pair_calls`` of rows that ``wanted_hits`` selected."""
    order = HIT_ORDER
    sliced = rows.withColumn("__slice", F.expr(f"t_ns div {slice_seconds * 1_000_000_000}L"))
    inside = Window.partitionBy(*THREAD, "__slice").orderBy(*order)
    looked = sliced.withColumns({**_previous(inside), "__next": F.lead("phase").over(inside)})
    first, last = F.col("__phase").isNull(), F.col("__next").isNull()
    across = Window.partitionBy(*THREAD).orderBy(*order)
    edges = looked.where(first | last).withColumn("__first", first).withColumns(_previous(across))
    return _completed(looked.where(~first)).unionByName(_completed(edges.where("__first")))


def _previous(window) -> dict[str, Column]:
    """What the row before holds. Plain columns, so that the shuffle carries each value once
    and both branches of a sliced pairing ask for the same columns, hence the same shuffle."""
    return {f"__{c}": F.lag(c).over(window) for c in ("phase", "t_ns", "sbdev", "bytes")}


def _completed(rows: DataFrame) -> DataFrame:
    return rows.where("phase = 'R' AND __phase = 'E'").select(
        *CALLER_COLUMNS,
        F.col("__sbdev").alias("SBDEV"),
        "OP_NO",
        F.timestamp_micros(F.expr("t_ns div 1000")).alias("TS"),
        F.col("seq").alias("SEQ"),
        (F.col("t_ns") - F.col("__t_ns")).alias("DURATION_NS"),
        F.col("rc").alias("RC"),
        F.col("__bytes").alias("REQ_BYTES"),
    )
