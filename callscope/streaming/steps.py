"""Completed calls and tagged samples of a stream with the sliced batch operators, for hot threads and processes.

``streaming.pairing`` and ``streaming.tagging`` keep a thread or a process in one task's state. Here each micro-batch runs
the batch operators, which cut hot keys into time slices, over the rows that are due; all of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.operators.pairing import DEFAULT_SLICE_SECONDS, pair_hits, wanted_hits
from callscope.operators.tagging import DEFAULT_SLICE_SECONDS as TAG_SLICE_SECONDS
from callscope.operators.tagging import attach_tags
from callscope.streaming.kept import Found, Kept
from callscope.streaming.sliced import NANOS, TAGGED_EXECS, newest_execs, open_entries, parted, together

Deliver = Callable[[DataFrame, int], None]


def to_parquet(path: str) -> Deliver:
    """Delivers to ``<path>/batch=<id>``; a replayed micro-batch replaces what it wrote."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


class SlicedStep:
    """A ``foreachBatch`` function that holds rows until nothing can come before them, then hands them on, once.

    A row is due when one more than ``delay_seconds`` later was seen. Rows that come when their time is over are dropped,
    or written to ``<late_rows>/batch=<id>``; rows without a time are dropped. Kept (``streaming.kept``) are the rows not
    yet due and what ``carry`` says of those that are.
    """

    def __init__(self, folder: str, deliver: Deliver, delay_seconds: int, late_rows: str | None):
        self.kept = Kept(folder)
        self.deliver = deliver
        self.delay_ns = delay_seconds * NANOS
        self.late_rows = late_rows and late_rows.rstrip("/")

    def nanos(self) -> Column:
        """A row's time."""
        raise NotImplementedError

    def rows(self, batch: DataFrame, found: Found | None) -> DataFrame:
        """The rows of a micro-batch."""
        raise NotImplementedError

    def results(self, due: DataFrame) -> DataFrame:
        """What is made of the rows that are due."""
        raise NotImplementedError

    def carry(self, due: DataFrame, until: int, batch_id: int) -> tuple[DataFrame | None, dict[str, int]]:
        """Rows among those due that are looked at again, and the sizes of other tables that were written."""
        raise NotImplementedError

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = self.kept.read(spark, batch_id - 1) if batch_id > 0 else None
        new = self.rows(batch, found).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows, newest, over = new, 0, 0
            if found is not None:
                newest, over = found.numbers["newest"], found.numbers["finished"]
                if self.late_rows:
                    new.where(self.nanos() < over).write.mode("overwrite").parquet(f"{self.late_rows}/batch={batch_id}")
                rows = new.where(self.nanos() >= over).unionByName(found.table("rows", new.schema))
            newest = max(newest, new.agg(F.max(self.nanos()).alias("t")).first()["t"] or 0)
            until = max(over, newest - self.delay_ns)
            due, waiting = rows.where(self.nanos() < until), rows.where(self.nanos() >= until)
            if until > over:
                self.deliver(self.results(due), batch_id)
            again, sizes = self.carry(due, until, batch_id)
            sizes["rows"] = self.kept.write("rows", waiting if again is None else waiting.unionByName(again), batch_id)
            self.kept.close(spark, batch_id, {"newest": newest, "finished": until}, sizes)
        finally:
            new.unpersist()


class SlicedCalls(SlicedStep):
    """Probe events to completed calls. Each thread's open entry is carried; with ``ttl_seconds`` an older one is
    forgotten, and a call that takes longer is not given, whenever its return comes."""

    def __init__(
        self, folder: str, deliver: Deliver, delay_seconds: int = 10, slice_seconds: int = DEFAULT_SLICE_SECONDS,
        ttl_seconds: int | None = None, late_rows: str | None = None,
    ):
        super().__init__(folder, deliver, delay_seconds, late_rows)
        self.slice_seconds = slice_seconds
        self.ttl_ns = None if ttl_seconds is None else ttl_seconds * NANOS

    def nanos(self) -> Column:
        return F.col("t_ns")

    def rows(self, batch: DataFrame, found: Found | None) -> DataFrame:
        return wanted_hits(batch)

    def results(self, due: DataFrame) -> DataFrame:
        calls = pair_hits(due, self.slice_seconds)
        return calls if self.ttl_ns is None else calls.where(F.col("DURATION_NS") <= self.ttl_ns)

    def carry(self, due: DataFrame, until: int, batch_id: int) -> tuple[DataFrame | None, dict[str, int]]:
        still_open = open_entries(due)
        return still_open if self.ttl_ns is None else still_open.where(F.col("t_ns") >= until - self.ttl_ns), {}


class SlicedTags(SlicedStep):
    """Samples and execs (a stream of ``together``) to samples with the tags of the newest exec at or before them.

    Of each process the newest exec before the rows not yet due is kept, with those after it; an exec may come late as long as the
    samples after it are not due. With ``ttl_seconds`` tags serve that long only.
    """

    def __init__(
        self, folder: str, deliver: Deliver, time: str = "TIMESTAMP", delay_seconds: int = 10,
        slice_seconds: int = TAG_SLICE_SECONDS, ttl_seconds: int | None = None, late_rows: str | None = None,
    ):
        super().__init__(folder, deliver, delay_seconds, late_rows)
        self.time = time
        self.slice_seconds = slice_seconds
        self.ttl_seconds = ttl_seconds
        self.execs: DataFrame | None = None

    def nanos(self) -> Column:
        return F.unix_micros(F.col(self.time)) * 1000

    def rows(self, batch: DataFrame, found: Found | None) -> DataFrame:
        samples, execs, _ = parted(batch)
        self.execs = execs if found is None else execs.unionByName(found.table("execs", TAGGED_EXECS))
        return samples

    def results(self, due: DataFrame) -> DataFrame:
        return attach_tags(due, self.execs, time=self.time, slice_seconds=self.slice_seconds, ttl_seconds=self.ttl_seconds)

    def carry(self, due: DataFrame, until: int, batch_id: int) -> tuple[DataFrame | None, dict[str, int]]:
        recent = newest_execs(self.execs, until)
        if self.ttl_seconds is not None:
            recent = recent.where(F.unix_micros("ts") * 1000 >= until - self.ttl_seconds * NANOS)
        return None, {"execs": self.kept.write("execs", recent, batch_id)}


def _start(stream: DataFrame, step: SlicedStep, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(**(trigger or {})).start()


def _folder(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/kept"


def start_sliced_calls(events: DataFrame, deliver: Deliver, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Completed calls of a probe event stream, micro-batch by micro-batch; the options are those of ``SlicedCalls``."""
    return _start(events, SlicedCalls(_folder(checkpoint), deliver, **options), checkpoint, trigger)


def start_sliced_tags(
    samples: DataFrame, execs: DataFrame, deliver: Deliver, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Samples with the tags of their processes; the options are those of ``SlicedTags``."""
    return _start(together(samples, execs), SlicedTags(_folder(checkpoint), deliver, **options), checkpoint, trigger)
