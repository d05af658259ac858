"""Running the dataflow as a query: stream in, samples out to sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.model import DEFAULT_INTERVAL
from callscope.operators.counters import count_calls
from callscope.operators.tagging import execs_around
from callscope.plans.collect import check_options, samples_from_counters
from callscope.sinks.base import Sink, fan_out
from callscope.streaming.pairing import stream_calls

Side = DataFrame | Callable[[], DataFrame] | None


def stream_counters(calls: DataFrame, interval: int = DEFAULT_INTERVAL, delay: str | None = None) -> DataFrame:
    """Counters of closed intervals. Append mode: every row is a delta and comes once.

    ``delay`` sets a watermark on TS; leave it out for calls that come from ``stream_calls``.
    """
    watched = calls if delay is None else calls.withWatermark("TS", delay)
    return count_calls(watched, interval)


def current(side: Side) -> DataFrame | None:
    """A side table as it is now."""
    return side() if callable(side) else side


def check_stream_options(options: dict) -> None:
    check_options(
        options.get("tracked", ()), options.get("tag_filter"), options.get("anon_fields", ()),
        options.get("tracked_from_table", False),
    )


def start_collect(
    events: DataFrame,
    mounts: Side,
    sinks: Sequence[Sink],
    checkpoint: str,
    interval: int = DEFAULT_INTERVAL,
    execs: Side = None,
    late: Side = None,
    delay: str = "10 seconds",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Probe events to samples in all sinks.

    Pairing and counting are stream state. Every micro-batch then holds whole intervals, and
    mounts, tags, filter, grouping and masking run on it as the batch operators. ``mounts``,
    ``execs`` and ``late`` may be functions: they are called for every micro-batch, so
    slowly changing tables are read anew; of the execs only those around the micro-batch's
    intervals are kept meanwhile. With a checkpoint a stopped query goes on where it ended.
    """
    check_stream_options(options)
    kept = []

    def to_samples(counters: DataFrame) -> DataFrame:
        known = current(execs)
        if known is not None:
            at = F.unix_micros(F.col("TIMESTAMP").cast("timestamp"))
            known = execs_around(known, *counters.agg(F.min(at), F.max(at)).first()).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(known)
        return samples_from_counters(counters, current(mounts), interval, execs=known, late=current(late), **options)

    deliver = fan_out(sinks, to_samples)

    def collect(counters: DataFrame, batch_id: int) -> None:
        try:
            deliver(counters, batch_id)
        finally:
            while kept:
                kept.pop().unpersist()

    counters = stream_counters(stream_calls(events, delay), interval)
    writer = (
        counters.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(collect)
    )
    return writer.trigger(**(trigger or {"processingTime": f"{interval} seconds"})).start()


def stop_collect(
    query: StreamingQuery, sinks: Sequence[Sink], poll_seconds: float = 0.2, wait_seconds: float = 60
) -> None:
    """Let the running micro-batch finish, for ``wait_seconds`` at most, stop, and close the sinks.

    A micro-batch that was cut off all the same is replayed from the checkpoint.
    """
    until = time.monotonic() + wait_seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(poll_seconds)
    query.stop()
    for sink in sinks:
        sink.teardown()
