"""Pairing entries with returns on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.model import CALL_SCHEMA, struct_of
from callscope.operators.pairing import HIT_ORDER, THREAD, wanted_hits
from callscope.shipping import by_value
from callscope.streaming.ordered import InTimeOrder

_LONG, _TEXT = T.LongType(), T.StringType()
_ROWS = struct_of(
    PID=_LONG, UID=_LONG, COMM=_TEXT, phase=_TEXT, t_ns=_LONG, seq=_LONG, OP_NO=T.IntegerType(),
    sbdev=_LONG, bytes=_LONG, rc=_LONG,
)
_OPEN = struct_of(t_ns=_LONG, sbdev=_LONG, bytes=_LONG)


class OpenCalls(InTimeOrder):
    """The open entry of each thread, if its last row was an entry."""

    row_schema = _ROWS
    carry_schema = _OPEN
    order = HIT_ORDER

    def advance(self, key, rows, carry):
        entry = rows["phase"] == "E"
        before = rows[["t_ns", "sbdev", "bytes"]].shift(1, fill_value=0)
        opened = entry.shift(1, fill_value=False)
        if carry is not None:
            before.loc[0] = list(carry)
            opened.iloc[0] = True
        done = ~entry & opened
        rows_done, start = rows[done], before[done]
        out = pd.DataFrame({
            "HOSTNAME": key[0], "TID": key[1], "PID": rows_done["PID"], "UID": rows_done["UID"],
            "COMM": rows_done["COMM"], "SBDEV": start["sbdev"], "OP_NO": rows_done["OP_NO"].astype("int32"),
            "TS": pd.to_datetime(rows_done["t_ns"] // 1000, unit="us", utc=True), "SEQ": rows_done["seq"],
            "DURATION_NS": rows_done["t_ns"] - start["t_ns"], "RC": rows_done["rc"], "REQ_BYTES": start["bytes"],
        })
        last = rows.iloc[-1]
        still_open = (int(last["t_ns"]), int(last["sbdev"]), int(last["bytes"])) if last["phase"] == "E" else None
        return out, still_open


def stream_calls(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Completed calls (CALL_SCHEMA) of a probe event stream; ``TS`` carries the watermark.

    Rows may be late by up to ``delay``; later ones are dropped by Spark. The state of a
    thread lives in one task, which its rate of calls bounds. Where single threads make a
    large part of all events use ``streaming.sliced``.
    """
    rows = wanted_hits(events)
    filled = rows.select(
        *THREAD, "PID", "UID", "COMM", "phase", "t_ns", "seq", "OP_NO", "sbdev", "bytes", "rc",
        F.timestamp_micros(F.expr("t_ns div 1000")).alias("event_time"),
    )
    return filled.withWatermark("event_time", delay).groupBy(*THREAD).transformWithStateInPandas(
        statefulProcessor=OpenCalls(),
        outputStructType=CALL_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="TS",
    )


by_value(__name__)
