"""Fitting samples to a target table's schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.tags import tag_value
from callscope.model import TAG_COLUMN_PREFIX


class SchemaError(ValueError):
    """A target table whose tag columns cannot hold tags."""


def tag_columns(schema: T.StructType) -> list[str]:
    """Sorted tag names behind the tag columns of a target schema; these must be text."""
    names = []
    for field in schema.fields:
        if field.name.startswith(TAG_COLUMN_PREFIX):
            if not isinstance(field.dataType, T.StringType):
                raise SchemaError(f"column {field.name} must be a string to hold a tag")
            names.append(field.name[len(TAG_COLUMN_PREFIX):])
    return sorted(names)


def tag_column_changes(old: Sequence[str], new: Sequence[str]) -> tuple[list[str], list[str]]:
    """Tag names added and removed between two readings of a target schema."""
    return sorted(set(new) - set(old)), sorted(set(old) - set(new))


def conform(samples: DataFrame, target: T.StructType) -> DataFrame:
    """Project samples to the columns, order and types of a target schema.

    Tag columns come from TAGS (empty when absent), the others by name. A column the samples
    lack fails the analysis; a value that does not fit its type fails the cast.
    """
    columns = []
    for field in target.fields:
        if field.name.startswith(TAG_COLUMN_PREFIX):
            value = tag_value(F.col("TAGS"), field.name[len(TAG_COLUMN_PREFIX):])
        else:
            value = F.col(field.name)
        columns.append(value.cast(field.dataType).alias(field.name))
    return samples.select(*columns)
