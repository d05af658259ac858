"""Collecting from a stream with the sliced batch pairing, for hot threads.

Keyed stream state gives each thread to one task. Here every micro-batch runs the batch
operators instead, which cut a thread's rows into time slices. Between micro-batches only
what later ones need is kept, in small tables beside the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from callscope.functions.scalars import remote_path
from callscope.model import DEFAULT_INTERVAL, DEFAULT_VACUUM, TAGS_TYPE, struct_of
from callscope.operators.counters import count_calls
from callscope.operators.mounts import MOUNT_KEY, first_mounts, mount_epoch
from callscope.operators.pairing import HIT_ORDER, THREAD, pair_hits, wanted_hits
from callscope.operators.tagging import PROCESS, exec_tags, live_tags, no_tags
from callscope.plans.collect import samples_from_counters
from callscope.sinks.base import Sink, fan_out
from callscope.streaming.collect import Side, check_stream_options, current
from callscope.streaming.kept import Kept, payload

NANOS = 1_000_000_000

_PROCESS = dict(HOSTNAME=T.StringType(), PID=T.LongType())
_EXEC = dict(ts=T.TimestampType(), seq=T.LongType())
#: Execs with their tags, or with the environment itself, to be searched for names that are not known yet.
TAGGED_EXECS = struct_of(**_PROCESS, **_EXEC, TAGS=TAGS_TYPE)
RAW_EXECS = struct_of(**_PROCESS, **_EXEC, environ=T.StringType())
#: Mount rows as they are seen, and one per host, device and vacuum period as kept.
SEEN_MOUNTS = struct_of(
    HOSTNAME=T.StringType(), devt=T.StringType(), MOUNT=T.StringType(), device=T.StringType(), source=T.IntegerType(),
    seen_at=T.TimestampType(), line_no=T.LongType(),
)
KEPT_MOUNTS = T.StructType([*SEEN_MOUNTS.fields, T.StructField("epoch", T.LongType())])
LATE_TAGS = struct_of(**_PROCESS, TAGS=TAGS_TYPE)


class SlicedCollector:
    """A ``foreachBatch`` function from probe events, and execs and mounts where they are streams, to finished counters.

    An interval is over when an event more than ``delay_seconds`` after its end was seen;
    rows of finished intervals that come later are dropped, or written to ``<late_rows>/batch=<id>``.
    What is kept (``streaming.kept``):

    * rows of intervals that are not over, and entries still open;
    * of each process the newest exec of finished intervals, with those after it. Execs with an ``environ`` column are kept
      as they are, the newest one and the newest with a name of ``tracked()``, so that names learned later are found in them;
    * with ``late``, what it said of a process when the process was first counted without an exec: it is asked once, and
      an empty answer counts;
    * of each host and device the mount first seen in the newest vacuum period of finished intervals and in those after it.

    What belongs to processes that are not in ``live`` (HOSTNAME, PID) is dropped. With ``ttl_seconds`` execs and open
    entries are forgotten after that time: a call that takes longer is not counted, and tags do not serve longer. Both hold for every row, whenever it
    comes, so dropping them changes nothing that is still to come.
    """

    def __init__(
        self,
        folder: str,
        deliver: Callable[[DataFrame, int], None],
        interval: int = DEFAULT_INTERVAL,
        delay_seconds: int = 10,
        slice_seconds: int | None = None,
        live: Side = None,
        ttl_seconds: int | None = None,
        late: Side = None,
        late_rows: str | None = None,
        vacuum: int = DEFAULT_VACUUM,
        tracked: Callable[[], Sequence[str]] = lambda: (),
    ):
        self.kept = Kept(folder)
        self.deliver = deliver
        self.interval = interval
        self.delay_ns = delay_seconds * NANOS
        self.slice_seconds = slice_seconds or interval
        self.live = live
        self.ttl_ns = None if ttl_seconds is None else ttl_seconds * NANOS
        self.late = late
        self.late_rows = late_rows and late_rows.rstrip("/")
        self.vacuum = vacuum
        self.tracked = tracked
        self.execs: DataFrame | None = None
        self.late_tags: DataFrame | None = None
        self.mounts: DataFrame | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hits, execs, seen = parted(batch)
        newest = finished = 0
        found = self.kept.read(spark, batch_id - 1) if batch_id > 0 else None
        held = [wanted_hits(hits).persist(StorageLevel.MEMORY_AND_DISK)]
        sizes = {}
        try:
            rows = held[0]
            if found is not None:
                newest, finished = found.numbers["newest"], found.numbers["finished"]
                if self.late_rows:
                    missed = rows.where(F.col("t_ns") < finished)
                    missed.write.mode("overwrite").parquet(f"{self.late_rows}/batch={batch_id}")
                rows = rows.where(F.col("t_ns") >= finished).unionByName(found.table("rows", rows.schema))
                if "exec" in batch.columns:
                    execs = execs.unionByName(found.table("execs", execs.schema))
                if "seen" in batch.columns:
                    seen = seen.unionByName(found.table("mounts", KEPT_MOUNTS).drop("epoch"))
            self.execs = execs
            if "exec" in batch.columns:
                self.execs = execs.persist(StorageLevel.MEMORY_AND_DISK)
                held.append(self.execs)
            if "seen" in batch.columns:
                mounts = first_mounts(seen, self.vacuum).persist(StorageLevel.MEMORY_AND_DISK)
                held.append(mounts)
                self.mounts = mounts.select(*MOUNT_KEY, "epoch", "MOUNT", "device", remote_path(F.col("device")).alias("REMOTE_PATH"))
            newest = max(newest, rows.agg(F.max("t_ns").alias("t")).first()["t"] or 0)
            width = self.interval * NANOS
            until = max(finished, (newest - self.delay_ns) // width * width)
            ready = rows.where(F.col("t_ns") < until)
            counters = None
            if until > finished:
                calls = pair_hits(ready, self.slice_seconds)
                if self.ttl_ns is not None:
                    calls = calls.where(F.col("DURATION_NS") <= self.ttl_ns)
                counters = count_calls(calls, self.interval)
            if self.late is not None:
                if counters is not None:
                    counters = counters.persist(StorageLevel.MEMORY_AND_DISK)
                    held.append(counters)
                known = spark.createDataFrame([], LATE_TAGS) if found is None else found.table("late", LATE_TAGS)
                # written first: the samples use the answers that later micro-batches will find
                sizes["late"] = self.kept.write("late", self._living(self._asked(counters, known)), batch_id)
                self.late_tags = spark.read.schema(LATE_TAGS).parquet(f"{self.kept.place(batch_id)}/late")
            if counters is not None:
                self.deliver(counters, batch_id)
            waiting = rows.where(F.col("t_ns") >= until).unionByName(self._living(self._young(open_entries(ready), "t_ns", until)))
            sizes["rows"] = self.kept.write("rows", waiting, batch_id)
            if "exec" in batch.columns:
                recent = self._young(self._newest(until), F.unix_micros("ts") * 1000, until)
                sizes["execs"] = self.kept.write("execs", self._living(recent), batch_id)
            if "seen" in batch.columns:
                sizes["mounts"] = self.kept.write("mounts", newest_mounts(mounts, until, self.vacuum), batch_id)
            self.kept.close(spark, batch_id, {"newest": newest, "finished": until}, sizes)
        finally:
            for df in held:
                df.unpersist()

    def _living(self, rows: DataFrame) -> DataFrame:
        live = current(self.live)
        return rows if live is None else live_tags(rows, live)

    def _young(self, rows: DataFrame, time, until: int) -> DataFrame:
        """Rows that can still matter to what comes after ``until``."""
        time = F.col(time) if isinstance(time, str) else time
        return rows if self.ttl_ns is None else rows.where(time >= until - self.ttl_ns)

    def _newest(self, until: int) -> DataFrame:
        execs = self.execs
        kept = newest_execs(execs, until)
        if "environ" in execs.columns:
            named = exec_tags(execs.withColumn("__environ", F.col("environ")), self.tracked())
            named = named.withColumnRenamed("__environ", "environ").select(execs.columns)
            kept = kept.unionByName(newest_execs(named, until)).distinct()
        return kept

    def _asked(self, counters: DataFrame | None, known: DataFrame) -> DataFrame:
        """The answers known, and those for processes that are counted for the first time and have no exec."""
        if counters is None:
            return known
        unknown = (
            counters.select(*PROCESS).distinct().join(known, PROCESS, "left_anti")
            .join(self.execs.select(*PROCESS).distinct(), PROCESS, "left_anti")
        )
        answers = unknown.join(current(self.late).select(*PROCESS, "TAGS"), PROCESS, "left")
        return known.unionByName(answers.withColumn("TAGS", F.coalesce("TAGS", no_tags())))


def together(events: DataFrame, execs: DataFrame | None, mounts: DataFrame | None = None) -> DataFrame:
    """Probe events, execs and mounts as one stream, so that a micro-batch sees all of them."""
    raw = execs is not None and "environ" in execs.columns
    inputs = {"hit": events, "exec": execs, "seen": mounts}
    inputs = {kind: rows for kind, rows in inputs.items() if rows is not None}
    every = {"hit": events.schema, "exec": RAW_EXECS if raw else TAGGED_EXECS, "seen": SEEN_MOUNTS}
    schemas = {kind: every[kind] for kind in inputs}
    out = None
    for kind, rows in inputs.items():
        typed = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas[kind].fields])
        part = rows.select(*[(typed if k == kind else F.lit(None).cast(t)).alias(k) for k, t in schemas.items()])
        out = part if out is None else out.unionByName(part)
    return out


def parted(batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The probe events, execs and mounts of a micro-batch of ``together``, or of probe events alone."""
    if "hit" not in batch.columns:
        hits = batch
    else:
        hits = batch.where("hit IS NOT NULL").select("hit.*")

    def side(kind: str, schema: T.StructType) -> DataFrame:
        if kind in batch.columns:
            return batch.where(F.col(kind).isNotNull()).select(f"{kind}.*")
        return batch.sparkSession.createDataFrame([], schema)

    return hits, side("exec", TAGGED_EXECS), side("seen", SEEN_MOUNTS)


def newest_execs(execs: DataFrame, until: int) -> DataFrame:
    """Per process the newest exec before ``until`` (nanoseconds), and all from there on. Combines before the shuffle."""
    limit = F.timestamp_micros(F.lit(until // 1000))
    last = F.max_by(F.struct(*payload(execs, PROCESS)), F.struct("ts", "seq"))
    older = execs.where(F.col("ts") < limit).groupBy(*PROCESS).agg(last.alias("__last")).select(*PROCESS, "__last.*")
    return older.unionByName(execs.where(F.col("ts") >= limit))


def newest_mounts(mounts: DataFrame, until: int, vacuum: int) -> DataFrame:
    """Per host and device the mount of the newest period before the one of ``until``, and all from there on."""
    now = mount_epoch(F.timestamp_micros(F.lit(until // 1000)), vacuum)
    last = F.max_by(F.struct(*payload(mounts, MOUNT_KEY)), "epoch")
    older = mounts.where(F.col("epoch") < now).groupBy(*MOUNT_KEY).agg(last.alias("__last"))
    columns = [c if c in MOUNT_KEY else f"__last.{c}" for c in mounts.columns]
    return older.select(*columns).unionByName(mounts.where(F.col("epoch") >= now)).select(*[f.name for f in KEPT_MOUNTS.fields])


def open_entries(rows: DataFrame) -> DataFrame:
    """The last row of each thread where it is an entry. Combines before the shuffle."""
    last = F.max_by(F.struct(*payload(rows, THREAD)), F.struct(*HIT_ORDER))
    return (
        rows.groupBy(*THREAD).agg(last.alias("__last")).where(F.col("__last.phase") == "E")
        .select(*[c if c in THREAD else f"__last.{c}" for c in rows.columns])
    )


def start_sliced_collect(
    events: DataFrame,
    mounts: Side,
    sinks: Sequence[Sink],
    checkpoint: str,
    interval: int = DEFAULT_INTERVAL,
    execs: Side = None,
    late: Side = None,
    live: Side = None,
    delay_seconds: int = 10,
    slice_seconds: int | None = None,
    ttl_seconds: int | None = None,
    late_rows: str | None = None,
    learned: Callable[[], Sequence[str]] | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Probe events to samples in all sinks, without keyed state: the collector to use by default.

    ``execs`` is best a stream (HOSTNAME, PID, ts, seq, TAGS): then a micro-batch looks at its
    own execs and one newest exec per process, never at the history. A table or a function
    is read anew for every micro-batch. ``mounts`` may be a stream of mount rows as they are seen
    (HOSTNAME, devt, MOUNT, device, source, seen_at, line_no); the first one seen in a vacuum period then stays.
    ``late`` is asked once for each process that is counted without an exec, ``live`` drops what is kept of processes
    that are gone, ``ttl_seconds`` what is older. Rows that come too late go to ``late_rows``, if given.
    Unlike ``start_collect``, which goes by Spark's watermark, an event is too late here as soon
    as its interval was finished.

    An exec stream with an ``environ`` column instead of TAGS is searched for the names of the option ``tracked``, or of the
    function ``learned`` (``lambda: sink.tracked`` of a table sink that learns), called for every micro-batch.
    """
    if learned is not None:
        options["tracked_from_table"] = True
    check_stream_options(options)
    vacuum = options.get("vacuum", DEFAULT_VACUUM)
    is_stream = lambda side: isinstance(side, DataFrame) and side.isStreaming
    streamed, seen = is_stream(execs), is_stream(mounts)
    raw = streamed and "environ" in execs.columns
    tracked = learned or (lambda: options.get("tracked", ()))

    def to_samples(counters: DataFrame) -> DataFrame:
        known = collector.execs if streamed else current(execs)
        if raw:
            known = exec_tags(known, tracked())
        if known is None and late is not None:
            known = counters.sparkSession.createDataFrame([], TAGGED_EXECS)
        where = collector.mounts if seen else current(mounts)
        return samples_from_counters(
            counters, where, interval, execs=known, late=collector.late_tags, tag_ttl_seconds=ttl_seconds, **options
        )

    collector = SlicedCollector(
        f"{checkpoint.rstrip('/')}/kept", fan_out(sinks, to_samples), interval, delay_seconds, slice_seconds, live,
        ttl_seconds=ttl_seconds, late=late, late_rows=late_rows, vacuum=vacuum, tracked=tracked,
    )
    both = together(events, execs if streamed else None, mounts if seen else None)
    writer = both.writeStream.option("checkpointLocation", checkpoint).foreachBatch(collector)
    return writer.trigger(**(trigger or {"processingTime": f"{interval} seconds"})).start()
