"""Message forms of a sample row: JSON text, message key and message headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.tags import tag_value

_PLAIN = (
    T.StringType, T.NumericType, T.BooleanType, T.MapType, T.TimestampType, T.TimestampNTZType,
    T.BinaryType, T.NullType,
)


def _json_fields(df: DataFrame, time_form) -> list[Column]:
    fields = []
    for field in df.schema.fields:
        if not isinstance(field.dataType, _PLAIN):
            raise TypeError(f"column {field.name} of type {field.dataType.simpleString()} has no JSON form")
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = time_form(column)
        elif isinstance(field.dataType, T.BinaryType):
            column = F.decode(column, "UTF-8")
        fields.append(column.alias(field.name))
    return fields


def _iso(ts: Column) -> Column:
    # Whole seconds show no fraction; others show microseconds.
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(micros)


def json_iso(df: DataFrame) -> Column:
    """The whole row as JSON text with ISO-8601 times; nulls are kept."""
    return F.to_json(F.struct(*_json_fields(df, _iso)), {"ignoreNullFields": "false"})


def json_unix(df: DataFrame) -> Column:
    """The whole row as JSON text with times as whole seconds since 1970."""
    seconds = lambda ts: F.unix_timestamp(ts)
    return F.to_json(F.struct(*_json_fields(df, seconds)), {"ignoreNullFields": "false"})


def message_key() -> Column:
    """Bytes of ``HOSTNAME:COMM:UID:PID``."""
    return F.concat_ws(":", "HOSTNAME", "COMM", F.col("UID").cast("string"), F.col("PID").cast("string")).cast("binary")


def message_headers(tracked: Sequence[str] = ()) -> Column:
    """Ordered headers: five sample fields, then one per tracked tag (empty when absent)."""
    named = [(c, F.col(c).cast("string")) for c in ("HOSTNAME", "UID", "COMM", "MOUNT", "REMOTE_PATH")]
    named += [(name, tag_value(F.col("TAGS"), name)) for name in tracked]
    return F.array(*[
        F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value")) for name, value in named
    ])
