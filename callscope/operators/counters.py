"""Counting calls per thread and interval, and flattening raw counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.scalars import command_text, sample_time
from callscope.model import (
    BYTE_OPERATIONS,
    CALLER_COLUMNS,
    DURATION_COLUMNS,
    OP_NUMBER,
    OPERATIONS,
    STAT_COLUMNS,
)

COUNTER_KEYS = CALLER_COLUMNS + ["SBDEV"]


def is_error(op_no: Column, rc: Column) -> Column:
    """READ and WRITE fail on a negative return code, all other calls on a non-zero one."""
    moves_data = op_no.isin([OP_NUMBER[op] for op in BYTE_OPERATIONS])
    return F.when(moves_data, rc < 0).otherwise(rc != 0)


def call_sums() -> list[Column]:
    """The 65 conditional sums, durations in nanoseconds. One pass, one shuffle row per key."""
    sums = []
    for op, number in OP_NUMBER.items():
        parts = {"COUNT": "1L", "ERRORS": "__failed", "DURATION": "DURATION_NS"}
        if op in BYTE_OPERATIONS:
            parts["BYTES"] = "REQ_BYTES"
        sums += [
            F.expr(f"sum(CASE WHEN OP_NO = {number} THEN {value} ELSE 0L END) AS {op}_{kind}")
            for kind, value in parts.items()
        ]
    return sums


def count_calls(calls: DataFrame, interval: int | str) -> DataFrame:
    """Counters per interval and (host, thread, process, user, command, device).

    Works on tables and, with a watermark on ``TS``, on streams. Failed calls count, with
    their time and requested bytes. TIMESTAMP is the end of the interval, SEQ the newest
    call of the row. Durations stay in nanoseconds (see ``durations_to_seconds``).
    """
    width = interval if isinstance(interval, str) else f"{interval} seconds"
    slim = calls.select(
        "TS", *CALLER_COLUMNS, "SBDEV", "OP_NO", "SEQ",
        F.coalesce(is_error(F.col("OP_NO"), F.col("RC")), F.lit(False)).cast("long").alias("__failed"),
        "DURATION_NS", "REQ_BYTES",
    )
    counted = slim.groupBy(F.window("TS", width).alias("__window"), *COUNTER_KEYS).agg(
        *call_sums(), F.max("SEQ").alias("SEQ")
    )
    end = F.col("__window.end")
    return counted.select(
        sample_time_like(end, slim.schema["TS"].dataType).alias("TIMESTAMP"),
        *COUNTER_KEYS, "SEQ", *STAT_COLUMNS,
    )


def sample_time_like(ts: Column, dtype: T.DataType) -> Column:
    """Whole-second sample time that keeps the input's timestamp type."""
    return sample_time(ts).cast(dtype)


def flatten_counters(raw: DataFrame) -> DataFrame:
    """Raw counters (one struct per operation) to the flat statistics columns.

    TID rolls up to PID later; the command name may still be bytes. Durations stay in
    nanoseconds.
    """
    columns = []
    for op in OPERATIONS:
        stat = f"`{op.lower()}`"
        columns += [
            f"{stat}.count AS {op}_COUNT", f"{stat}.errors AS {op}_ERRORS", f"{stat}.duration AS {op}_DURATION",
        ]
        if op in BYTE_OPERATIONS:
            columns.append(f"{op[0].lower()}bytes AS {op}_BYTES")
    return raw.select(
        sample_time_like(F.col("TIMESTAMP"), raw.schema["TIMESTAMP"].dataType).alias("TIMESTAMP"),
        "HOSTNAME", "TID", "PID", "UID", command_text(F.col("COMM")).alias("COMM"), "SBDEV", "SEQ",
        *[F.expr(c) for c in columns],
    )


def durations_to_seconds(df: DataFrame) -> DataFrame:
    """The last step of a plan that summed nanoseconds: duration columns as seconds."""
    return df.selectExpr(*[
        f"CAST(`{c}` AS DOUBLE) / 1e9D AS `{c}`" if c in DURATION_COLUMNS else f"`{c}`" for c in df.columns
    ])
