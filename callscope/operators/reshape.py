"""Samples turned on their side: one row per field and sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.tags import tag_text
from callscope.operators.stats import SAMPLE_SCOPE, sort_key


def transpose(samples: DataFrame, keys: Sequence[str], scope: Sequence[str] = SAMPLE_SCOPE) -> DataFrame:
    """(scope..., sample_no, field, value) rows; samples are numbered by ``keys`` per scope.

    A scope is one interval of one host, so the numbering never sees more than one batch.
    """
    by = Window.partitionBy(*scope).orderBy(*sort_key(samples, keys))
    numbered = samples.withColumn("sample_no", F.row_number().over(by) - 1)
    fields = [c for c in samples.columns if c not in scope]
    texts = [
        (tag_text(F.col(c)) if isinstance(samples.schema[c].dataType, T.MapType) else F.col(c).cast("string")).alias(c)
        for c in fields
    ]
    return numbered.select(*scope, "sample_no", *texts).unpivot(
        [*scope, "sample_no"], fields, "field", "value"
    )
