"""Filtering, grouping and anonymizing sample rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.tags import has_all_tags, has_any_tag, tag_entries
from callscope.model import ANONYMIZABLE, STAT_COLUMNS

BY_COMMAND = ["MOUNT", "COMM", "TAGS"]
BY_PROCESS = ["MOUNT", "PID", "TAGS"]
# Rows of different hosts and intervals stay apart when many are looked at together.
SAMPLE_SCOPE = ["TIMESTAMP", "HOSTNAME"]


def filter_stats(df: DataFrame, tags: Sequence[str], how: str) -> DataFrame:
    """Rows that carry ``any`` or ``all`` of the named tags."""
    if how == "any":
        return df.where(has_any_tag(F.col("TAGS"), tags))
    if how == "all":
        return df.where(has_all_tags(F.col("TAGS"), tags))
    raise NotImplementedError(f"tag filter {how!r}: use 'any' or 'all'")


def last_value(column: str, order: Column) -> Column:
    """Last non-null value in the given order: combines map-side, unlike ``last``."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)


def total_order(df: DataFrame) -> list[Column]:
    """Time, then the sequence number, or without one all other columns: rows that still tie are equal."""
    first = [c for c in ("TIMESTAMP", "SEQ") if c in df.columns]
    if "SEQ" in first:
        return [F.col(c) for c in first]
    return [F.col(c) for c in first] + sort_key(df, [c for c in df.columns if c not in first])


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | None = None,
    sort: bool = False,
) -> DataFrame:
    """Group by any columns: statistics are summed, every other column takes its last value.

    Rows with a null key are dropped. "Last" is by ``order``, whose columns should make a
    total order; left out, it is ``total_order``. Columns that serve only as order and are no
    sample columns can be dropped by the caller. Maps are compared without key order. ``sort`` orders the result by key.
    """
    keys = list(keys)
    by = total_order(df) if order is None else [F.col(c) for c in order]
    position = by[0] if len(by) == 1 else F.struct(*by)
    stats = [c for c in STAT_COLUMNS if c in df.columns]
    rest = [c for c in df.columns if c not in stats and c not in keys]
    complete = df.where(" AND ".join(f"`{key}` IS NOT NULL" for key in keys))
    grouped = complete.groupBy(*keys).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in stats], *[last_value(c, position) for c in rest]
    )
    if sort:
        return grouped.orderBy(*sort_key(grouped, keys))
    return grouped


def sort_key(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Orderable forms of group keys; a map sorts as its sorted entries."""
    return [
        tag_entries(F.col(k)) if isinstance(df.schema[k].dataType, T.MapType) else F.col(k) for k in keys
    ]


def squash_processes(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Per command: group by mount, command and tags within host and interval."""
    return group_stats(df, SAMPLE_SCOPE + BY_COMMAND, order)


def keep_processes(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Per process: group by mount, process id and tags within host and interval."""
    return group_stats(df, SAMPLE_SCOPE + BY_PROCESS, order)


def check_anonymizable(fields: Sequence[str]) -> None:
    unknown = sorted(set(fields) - set(ANONYMIZABLE))
    if unknown:
        raise ValueError(f"cannot anonymize {', '.join(unknown)}; allowed: {', '.join(ANONYMIZABLE)}")


def anonymize(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Mask columns by type: text becomes ``--``, numbers 0, tag values ``--``.

    Runs after grouping; masked rows are not merged.
    """
    check_anonymizable(fields)
    masked = {}
    for name in fields:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.StringType):
            masked[name] = F.lit("--")
        elif isinstance(dtype, T.NumericType):
            masked[name] = F.lit(0).cast(dtype)
        elif isinstance(dtype, T.MapType):
            masked[name] = F.transform_values(name, lambda k, v: F.lit("--"))
        else:
            raise ValueError(f"column {name} of type {dtype.simpleString()} cannot be masked")
    return df.withColumns(masked) if masked else df
