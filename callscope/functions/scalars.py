"""Scalar conversions of single sample fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.model import DEVICE_MINOR_BITS


def ns_to_seconds(ns: Column) -> Column:
    """Nanoseconds to seconds as a double. Add up nanoseconds first, divide once."""
    return ns.cast("double") / F.lit(1e9)


def device_text(st_dev: Column) -> Column:
    """Kernel device number to the ``major:minor`` text used in mount tables."""
    minor = st_dev.bitwiseAND(F.lit((1 << DEVICE_MINOR_BITS) - 1))
    return F.concat(F.shiftright(st_dev, DEVICE_MINOR_BITS), F.lit(":"), minor)


def remote_path(device: Column) -> Column:
    """Exported path of ``address:/path``: the text after the last ``:/``, slash kept."""
    return F.regexp_extract(device, r".*:(/.*)$", 1)


def command_text(comm: Column) -> Column:
    """Command name bytes as text; malformed UTF-8 is replaced."""
    return F.make_valid_utf8(comm.cast("string"))


def sample_time(ts: Column) -> Column:
    """Sample time: whole seconds, without a time zone of its own."""
    return F.date_trunc("second", ts)
