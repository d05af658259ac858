"""The sink interface, a registry of sinks by name, and delivery to several at once."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from importlib.metadata import entry_points

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

SINKS: dict[str, type[Sink]] = {}
#: Installed packages offer sinks under this group of entry points: ``name = "package.module:SinkClass"``.
SINK_GROUP = "callscope.sinks"


class Sink:
    """Takes whole batches of samples. Subclasses override ``write``."""

    def setup(self, spark: SparkSession) -> None:
        """Called once before the first batch."""

    def before(self, spark: SparkSession) -> None:
        """Called before the rows of a batch are prepared, with or without rows."""

    def write(self, batch: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def teardown(self) -> None:
        """Called once after the last batch."""


def register_sink(name: str) -> Callable[[type[Sink]], type[Sink]]:
    """Class decorator: make a sink available to ``make_sink`` under a name."""

    def add(cls: type[Sink]) -> type[Sink]:
        SINKS[name] = cls
        return cls

    return add


def discover_sinks(group: str = SINK_GROUP) -> list[str]:
    """Register the sinks of installed packages; returns their names.

    A name that is taken stays with its sink. A package whose sink cannot be loaded is left out with a warning, so that it does not stop the others.
    """
    found = []
    for entry in entry_points(group=group):
        if entry.name in SINKS:
            continue
        try:
            cls = entry.load()
        except Exception as error:
            log.warning("sink %s of %s cannot be loaded: %s", entry.name, entry.value, error)
            continue
        if not (isinstance(cls, type) and issubclass(cls, Sink)):
            raise TypeError(f"entry point {entry.name} of {group} is no Sink class: {entry.value}")
        SINKS[entry.name] = cls
        found.append(entry.name)
    return found


def make_sink(name: str, /, **options) -> Sink:
    """A sink by its name: one registered here, or else one that an installed package offers."""
    if name not in SINKS:
        discover_sinks()
    if name not in SINKS:
        raise ValueError(f"unknown sink {name!r}; known: {', '.join(sorted(SINKS))}")
    return SINKS[name](**options)


def fan_out(
    sinks: Sequence[Sink], prepare: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives each non-empty batch to all sinks.

    The batch is computed once and kept while the sinks write at the same time; it waits for
    all of them and fails if one failed, so that the batch is replayed.
    """
    if not sinks:
        raise ValueError("no sink given")
    ready = False

    def deliver(batch: DataFrame, batch_id: int) -> None:
        nonlocal ready
        if not ready:
            for sink in sinks:
                sink.setup(batch.sparkSession)
            ready = True
        for sink in sinks:
            sink.before(batch.sparkSession)
        # Plans read a batch more than once; unkept, each reading would run the stream's state again.
        kept = [batch.persist(StorageLevel.MEMORY_AND_DISK)]
        try:
            if batch.isEmpty():
                return
            samples = batch
            if prepare:
                samples = prepare(batch).persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(samples)
                if samples.isEmpty():
                    return
            with ThreadPoolExecutor(len(sinks)) as pool:
                writes = [pool.submit(sink.write, samples, batch_id) for sink in sinks]
            for write in writes:
                write.result()
        finally:
            for df in kept:
                df.unpersist()

    return deliver
