"""Tags out of a process's environment block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.model import TAGS_TYPE


def is_tracked(entry: Column, tracked: Sequence[str]) -> Column:
    """Does ``NAME=value`` start with a tracked name? A prefix match: JOB also takes JOBID."""
    hit = F.lit(False)
    for name in tracked:
        hit = hit | entry.startswith(name)
    return hit


def parse_environ(environ: Column, tracked: Sequence[str]) -> Column:
    """Tracked variables of a NUL-separated environment block as a map.

    * every entry ends in NUL, so text after the last NUL is no entry;
    * the value ends at a second ``=`` (``A=b=c`` gives ``b``);
    * one tracked entry without ``=`` empties the whole result;
    * of a repeated name the last entry counts;
    * an unreadable (null) block gives an empty map.
    """
    empty = F.create_map().cast(TAGS_TYPE)

    def to_map(parts: Column) -> Column:
        def repeated(part, i):
            return F.exists(F.slice(parts, i + 2, F.size(parts)), lambda later: later[0] == part[0])

        last_only = F.filter(parts, lambda part, i: ~repeated(part, i))
        pairs = F.transform(last_only, lambda p: F.struct(p[0].alias("key"), F.get(p, F.lit(1)).alias("value")))
        malformed = F.exists(parts, lambda p: F.size(p) < 2)
        return F.when(malformed, empty).otherwise(F.map_from_entries(pairs))

    pieces = F.split(environ, "\\x00")
    tracked_parts = F.transform(
        F.filter(F.slice(pieces, 1, F.size(pieces) - 1), lambda e: is_tracked(e, tracked)),
        lambda e: F.split(e, "="),
    )
    # An array of one: to_map then works on a computed value and not on a repeated expression.
    tags = F.get(F.transform(F.array(tracked_parts), to_map), F.lit(0))
    # Most blocks name no tracked variable at all and need no splitting.
    named = F.lit(False)
    for name in tracked:
        named = named | environ.contains(name)
    return F.when(F.coalesce(named, F.lit(False)), tags).otherwise(empty)
