"""Lookup joins against a side with unique keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SALT = "__salt"
_NOT_HASHABLE = (T.MapType, T.ArrayType, T.StructType, T.VariantType)


def salt_column(df: DataFrame, salts: int):
    """A salt that depends on the row alone, so that a recomputed task yields the same rows."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, _NOT_HASHABLE)]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def lookup(facts: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left", salts: int | None = None) -> DataFrame:
    """Join rows to a lookup side whose ``keys`` are unique.

    A plain join: adaptive execution knows the sizes at run time, broadcasts a side that turned out
    small and splits the rows of a hot key. Where that is switched off or a key is known to hold most
    rows, ``salts`` repeats the side so many times and joins on (keys, salt).
    """
    keys = list(keys)
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"a lookup join cannot be {how!r}")
    if salts is None:
        return facts.join(side, keys, how)
    spread = side.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = facts.withColumn(_SALT, salt_column(facts, salts))
    return salted.join(spread, keys + [_SALT], how).drop(_SALT)
