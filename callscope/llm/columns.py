"""Column helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space: space and the ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def without_spaces(text: Column) -> Column:
    """The text without any white space (byte searches, no pattern)."""
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), SPACES, text)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(numbers: Column) -> Column:
    """Sums of an array's elements up to each of them. Round k adds the sum that ends 2**k places before, so n elements
    take log2(n) rounds over the array and no array is grown element by element."""

    def added(start: Column) -> Column:
        n = F.size(start)
        rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(n.cast("double"))).cast("int") - 1, F.lit(0)))
        back = lambda k: F.call_function("shiftleft", F.lit(1), k)
        step = lambda done, k: F.zip_with(
            done, F.concat(F.array_repeat(F.lit(0), back(k)), F.slice(done, F.lit(1), n - back(k))), lambda x, before: x + before
        )
        return F.when(n > 1, F.aggregate(rounds, start, step)).otherwise(start)

    return let(numbers, added)


def located(text: Column, pattern: str, lead: int = 0) -> Column:
    """Each leftmost match of a pattern, without overlaps: (start, end (exclusive), found, lead: up to ``lead`` code points
    just before it, back to the match before). Places are code points; time grows as n * log(n) of the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(found, lambda found: F.zip_with(
        found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
        lambda m, gap: F.struct(m.alias("found"), F.char_length(m).alias("size"), F.char_length(gap).alias("gap"), F.right(gap, F.lit(lead)).alias("lead")),
    ))
    return let(pairs, lambda pairs: F.zip_with(
        pairs, running_sum(F.transform(pairs, lambda p: p["gap"] + p["size"])),
        lambda p, end: F.struct((end - p["size"]).alias("start"), end.alias("end"), p["found"].alias("found"), p["lead"].alias("lead")),
    ))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet, whatever they were given."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def one_row_each(docs: DataFrame, chosen: DataFrame, key: Column, kept: Column) -> DataFrame:
    """One row of ``docs`` for each different ``kept`` of ``chosen`` that its ``key`` equals, with all its columns.

    The join places the rows by their key, so the choice among rows that repeat one needs no other shuffle.
    """
    name, place = fresh(docs, "key"), fresh(docs, "place")
    rows = docs.withColumn(name, key).join(chosen.select(kept.alias(name)).distinct(), name, "left_semi")
    first = Window.partitionBy(name).orderBy(F.lit(1))
    return rows.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])
