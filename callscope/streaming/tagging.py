"""Attaching process tags on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.tags import tag_entries
from callscope.model import TAGS_TYPE, struct_of
from callscope.operators.tagging import PROCESS
from callscope.shipping import by_value
from callscope.streaming.ordered import InTimeOrder

_LONG, _TEXT = T.LongType(), T.StringType()
_ROWS = struct_of(t_ns=_LONG, side=T.IntegerType(), seq=_LONG, TAGS=_TEXT, row=_TEXT)
_TAGS = struct_of(TAGS=_TEXT, t_ns=_LONG)
_OUT = struct_of(HOSTNAME=_TEXT, PID=_LONG, event_time=T.TimestampType(), row=_TEXT, TAGS=_TEXT)


class ProcessTags(InTimeOrder):
    """The newest tags of each process; a newer exec replaces them.

    With ``ttl_seconds`` tags older than that are forgotten, as event time goes.
    """

    row_schema = _ROWS
    carry_schema = _TAGS
    order = ["t_ns", "side", "seq"]

    def __init__(self, ttl_seconds: int | None = None):
        self.ttl_ns = None if ttl_seconds is None else ttl_seconds * 1_000_000_000

    def advance(self, key, rows, carry):
        execs = rows["side"] == 0
        tags = rows["TAGS"].where(execs).ffill()
        since = rows["t_ns"].where(execs).ffill()
        if carry is not None:
            tags, since = tags.fillna(carry[0]), since.fillna(carry[1])
        if self.ttl_ns is not None:
            tags = tags.where(rows["t_ns"] - since <= self.ttl_ns)
        samples = rows[~execs]
        out = pd.DataFrame({
            "HOSTNAME": key[0], "PID": key[1],
            "event_time": pd.to_datetime(samples["t_ns"] // 1000, unit="us", utc=True),
            "row": samples["row"], "TAGS": tags[~execs].fillna("{}"),
        })
        known = carry
        if execs.any():
            last = rows[execs].iloc[-1]
            known = (last["TAGS"], int(last["t_ns"]))
        return out, known


def stream_tags(
    samples: DataFrame,
    execs: DataFrame,
    time: str = "TIMESTAMP",
    delay: str = "10 seconds",
    ttl_seconds: int | None = None,
) -> DataFrame:
    """TAGS of each sample's process: the newest exec at or before the sample's time.

    ``samples`` have HOSTNAME, PID and ``time``; ``execs`` HOSTNAME, PID, ts, seq, TAGS. The
    other sample columns travel through the state as one JSON text.
    """
    nanos = lambda c: F.unix_micros(c) * 1000
    payload = [f for f in samples.schema.fields if f.name not in (*PROCESS, "TAGS")]
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    rows = samples.select(
        *PROCESS, F.col(time).alias("event_time"), nanos(F.col(time)).alias("t_ns"), F.lit(1).alias("side"),
        F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("TAGS"),
        F.to_json(F.struct(*[f.name for f in payload]), {"timestampFormat": micros}).alias("row"),
    )
    history = execs.select(
        *PROCESS, F.col("ts").alias("event_time"), nanos(F.col("ts")).alias("t_ns"), F.lit(0).alias("side"),
        F.col("seq").cast("long").alias("seq"),
        F.to_json(F.map_from_entries(tag_entries(F.col("TAGS")))).alias("TAGS"),
        F.lit(None).cast("string").alias("row"),
    )
    tagged = (
        rows.unionByName(history)
        .withWatermark("event_time", delay)
        .groupBy(*PROCESS)
        .transformWithStateInPandas(
            statefulProcessor=ProcessTags(ttl_seconds),
            outputStructType=_OUT,
            outputMode="Append",
            timeMode="EventTime",
            eventTimeColumnName="event_time",
        )
    )
    back = F.from_json("row", T.StructType(payload), {"timestampFormat": micros})
    columns = [
        F.col(c) if c in PROCESS
        else F.col("event_time").alias(c) if c == time
        else F.col(f"r.{c}")
        for c in samples.columns if c != "TAGS"
    ]
    return tagged.withColumn("r", back).select(
        *columns, F.from_json("TAGS", TAGS_TYPE).alias("TAGS")
    )


by_value(__name__)
