"""Expressions over the TAGS map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_value(tags: Column, name: str) -> Column:
    """Value of a tag, empty text when the tag is absent."""
    return F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(""))


def has_any_tag(tags: Column, names: Sequence[str]) -> Column:
    """At least one of the names is a tag; no names, no rows."""
    hit = F.lit(False)
    for name in names:
        hit = hit | F.map_contains_key(tags, name)
    return hit


def has_all_tags(tags: Column, names: Sequence[str]) -> Column:
    """Every name is a tag; no names, all rows."""
    hit = F.lit(True)
    for name in names:
        hit = hit & F.map_contains_key(tags, name)
    return hit


def tag_entries(tags: Column) -> Column:
    """Tags as a sorted array of entries: an orderable, distinct-able form of the map."""
    return F.array_sort(F.map_entries(tags))


def tag_text(tags: Column) -> Column:
    """Tags as ``name=value;name=value`` text in name order."""
    return F.concat_ws(
        ";", F.transform(tag_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
