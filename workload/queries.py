"""One query per operator over the given tables."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.environ import parse_environ
from callscope.functions.records import json_iso, json_unix, message_headers, message_key
from callscope.functions.scalars import device_text, remote_path
from callscope.functions.tags import tag_text, tag_value
from callscope.model import (
    CALLER_COLUMNS,
    OP_NUMBER,
    OPERATIONS,
    PROBE_SCHEMA,
    SAMPLE_COLUMNS,
    SAMPLE_SCHEMA,
    STAT_COLUMNS,
)
from callscope.operators.conform import conform
from callscope.operators.counters import count_calls, durations_to_seconds, flatten_counters, is_error
from callscope.operators.metrics import buffer_usage, drain_metrics, newest_samples, to_metrics
from callscope.operators.mounts import attach_mounts, resolve_mounts, upsert_mounts
from callscope.operators.pairing import pair_calls
from callscope.operators.reshape import transpose
from callscope.operators.retention import retained_files
from callscope.operators.stats import anonymize, check_anonymizable, filter_stats, group_stats
from callscope.operators.tagging import attach_tags, live_tags, tag_key_drift
from callscope.plans.collect import collect_samples
from callscope.plans.storage import delete_path, scratch_path, written
from callscope.sinks import BufferSink, ConsoleSink, JsonFileSink, MetricsSink, TableSink, fan_out, make_sink
from callscope.sinks.kafka import KafkaSink
from callscope.sinks.table import create_sample_table
from callscope.sources import logs
from callscope.sources.mounts import parse_mountinfo, parse_partitions, read_mountinfo
from workload import streams, views
from workload.views import DAY, TRACKED

HOUR = 3600


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: times without zone, tags as text."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            columns.append(F.col(field.name).cast("timestamp_ntz").alias(field.name))
        elif isinstance(field.dataType, T.MapType):
            columns.append(tag_text(F.col(field.name)).alias(field.name))
        else:
            columns.append(field.name)
    return df.select(*columns)


def call_counters(spark, d):
    return plain(count_calls(views.calls(spark, d), DAY))


def item_counters(spark, d):
    counters = count_calls(views.item_calls(spark, d), 30 * DAY)
    keys = ["TIMESTAMP", "HOSTNAME", "COMM"]
    return plain(durations_to_seconds(group_stats(counters.select(*keys, *STAT_COLUMNS), keys)))


def _raw_counters(spark, d):
    calls = views.calls(spark, d)
    failed = is_error(F.col("OP_NO"), F.col("RC")).cast("long")
    zero = F.lit(0).cast("long")

    def of(op, value):
        return F.sum(F.when(F.col("OP_NO") == OP_NUMBER[op], value).otherwise(zero))

    raw = calls.groupBy(F.window("TS", f"{DAY} seconds").alias("w"), *CALLER_COLUMNS, "SBDEV").agg(
        F.max("SEQ").alias("SEQ"),
        *[
            F.struct(
                of(op, F.lit(1).cast("long")).alias("count"),
                of(op, F.col("DURATION_NS")).alias("duration"),
                of(op, failed).alias("errors"),
            ).alias(op.lower())
            for op in OPERATIONS
        ],
        of("READ", F.col("REQ_BYTES")).alias("rbytes"),
        of("WRITE", F.col("REQ_BYTES")).alias("wbytes"),
    )
    return raw.withColumn("TIMESTAMP", F.col("w.end")).drop("w")


def counter_flatten(spark, d):
    return plain(flatten_counters(_raw_counters(spark, d).withColumn("COMM", F.col("COMM").cast("binary"))))


def call_errors(spark, d):
    failed = is_error(F.col("OP_NO"), F.col("RC")).cast("long")
    return views.calls(spark, d).groupBy("HOSTNAME", "OP_NO").agg(
        F.count("*").alias("n"), F.sum(failed).alias("errors")
    )


def samples(spark, d, interval=DAY, **options):
    return collect_samples(
        views.calls(spark, d), views.mounts(spark, d), interval, execs=views.execs(spark, d), **options
    )


def samples_squash(spark, d):
    return plain(samples(spark, d))


def samples_per_pid(spark, d):
    return plain(samples(spark, d, squash_pid=False))


def probe_samples(spark, d):
    calls = pair_calls(views.probe_events(spark, d))
    return plain(collect_samples(calls, views.mounts(spark, d), DAY, execs=views.execs(spark, d)))


def _located(spark, d):
    return attach_mounts(count_calls(views.calls(spark, d), DAY), views.mounts(spark, d))


def _regrouped(spark, d, keys):
    rows = _located(spark, d).drop("TID", "SBDEV")
    grouped = group_stats(rows, keys, order=["TIMESTAMP", "SEQ"]).drop("SEQ")
    return plain(durations_to_seconds(grouped))


def group_by_mount(spark, d):
    return _regrouped(spark, d, ["MOUNT"])


def group_by_comm_pid(spark, d):
    return _regrouped(spark, d, ["COMM", "PID"])


def group_last_nulls(spark, d):
    ev = views.events(spark, d)
    k, n = F.col("k"), F.col("event_id")
    rows = ev.select(
        F.when(k % 10 != 0, F.concat("HOSTNAME", k.cast("string"))).alias("HOSTNAME"),
        F.when((k % 3 != 0) & (n % 2 != 0), F.concat(F.lit("/mnt/"), n.cast("string"))).alias("MOUNT"),
        "PID", n.alias("SEQ"), k.cast("long").alias("READ_BYTES"),
    )
    return group_stats(rows, ["HOSTNAME"], order=["SEQ"])


def _tagged_calls(spark, d):
    return views.events(spark, d).select(F.col("event_id").alias("SEQ"), "HOSTNAME", "PID", views.event_tags().alias("TAGS"))


def tag_filter_any(spark, d):
    return plain(filter_stats(_tagged_calls(spark, d), TRACKED, "any"))


def tag_filter_all(spark, d):
    return plain(filter_stats(_tagged_calls(spark, d), TRACKED, "all"))


def anonymized(spark, d):
    masked = anonymize(samples(spark, d), ["PID", "COMM", "MOUNT", "REMOTE_PATH", "TAGS"])
    return plain(masked)


def mount_lookup(spark, d):
    found = attach_mounts(views.calls(spark, d), views.mounts(spark, d), time="TS")
    return found.select("SEQ", "HOSTNAME", device_text(F.col("SBDEV")).alias("devt"), "MOUNT", "REMOTE_PATH")


def _mount_candidates(spark, d):
    cust = F.col("o_custkey")
    return views.table(spark, d, "orders").select(
        F.concat(F.lit("host"), cust % 4).alias("HOSTNAME"),
        F.concat(F.lit("0:"), cust % 40).alias("devt"),
        F.concat(F.lit("/mnt/"), F.lower("o_orderpriority")).alias("MOUNT"),
        F.concat(F.lit("10.0.0."), cust % 7, F.lit(":/export/o"), "o_orderkey").alias("device"),
        (F.col("o_orderkey") % 3).cast("int").alias("source"),
        F.col("o_orderdate").cast("timestamp").alias("seen_at"),
        F.col("o_orderkey").alias("line_no"),
    )


def mount_precedence(spark, d):
    return resolve_mounts(_mount_candidates(spark, d), vacuum=30 * DAY)


def mount_asof(spark, d):
    """Devices collected now and then: most periods of a device have no candidate of their own."""
    seen = views.seen_mounts(views.events(spark, d))
    found = attach_mounts(views.calls(spark, d), resolve_mounts(seen, vacuum=DAY // 4), vacuum=DAY // 4, time="TS")
    return found.select("SEQ", "HOSTNAME", "SBDEV", "MOUNT", "REMOTE_PATH")


def mount_upsert(spark, d):
    return upsert_mounts(_mount_candidates(spark, d))


def remote_paths(spark, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    form = key % 6
    device = (
        F.when(form == 0, F.concat(F.lit("10.0.0."), nation, F.lit(":/"), "c_mktsegment"))
        .when(form == 1, F.concat(F.lit("[2001::"), nation, F.lit("]:/vol/"), key))
        .when(form == 2, F.lit("filer.local:8080:/"))
        .when(form == 3, F.lit(":::/mnt"))
        .when(form == 4, F.concat(F.lit("/dev/sd"), key))
        .otherwise(F.concat(F.lit("srv:/a:/b/"), key))
    )
    devices = views.table(spark, d, "customer").select("c_custkey", device.alias("device"))
    return devices.withColumn("REMOTE_PATH", remote_path(F.col("device")))


def devt_format(spark, d):
    st_dev = F.col("o_orderkey") * 2654435 % F.lit(4294967296)
    orders = views.table(spark, d, "orders").select("o_orderkey", st_dev.alias("st_dev"))
    return orders.withColumn("devt", device_text(F.col("st_dev")))


def _mount_lines(spark, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    line = F.concat(
        F.when(key % 3 == 0, F.lit("  ")).otherwise(F.lit("")), key, F.lit(" 25  0:"), key % 977,
        F.lit(" / /mnt/"), F.lower("c_mktsegment"), key, F.lit("\trw,relatime "),
        F.when(key % 2 == 0, F.concat(F.lit("shared:"), nation, F.lit(" master:1 "))).otherwise(F.lit("")),
        F.lit("- "),
        F.when(key % 5 == 0, F.lit("ext4")).when(key % 7 == 0, F.lit("nfs")).otherwise(F.lit("nfs4")),
        F.lit(" 10.1.0."), nation, F.lit(":/vol - rw,vers=4"),
    )
    return views.table(spark, d, "customer").select("c_custkey", line.alias("value"))


def mountinfo_parse(spark, d):
    return parse_mountinfo(_mount_lines(spark, d))


def _environs(spark, d):
    k, nul = F.col("k"), F.lit("\0")
    user = F.pmod("user_id", F.lit(7))
    none = F.lit("")
    text = F.concat(
        F.lit("JOBID="), user, nul, F.lit("PATH=/bin"), nul, F.lit("JOB=a=b"), nul,
        F.when(k % 5 == 0, F.concat(F.lit("JOBX"), nul)).otherwise(none),
        F.when(k % 4 == 0, F.concat(F.lit("JOBID=again"), nul)).otherwise(none),
        F.when(k % 3 == 0, F.concat(F.lit("SCHEDID="), nul)).otherwise(none),
        F.lit("JOBTAIL"),
    )
    return views.events(spark, d).select("event_id", "HOSTNAME", "PID", "ts", F.when(k != 0, text).alias("environ"))


def env_parse(spark, d):
    rows = _environs(spark, d)
    return plain(rows.select("event_id", parse_environ(F.col("environ"), ["JOB", "SCHEDID"]).alias("TAGS")))


def paired(spark, d):
    return plain(pair_calls(views.probe_events(spark, d)))


def paired_fine(spark, d):
    return plain(pair_calls(views.probe_events(spark, d), slice_seconds=60))


def _tag_samples(spark, d):
    return views.events(spark, d).where(F.col("event_type") != "signup").select(
        F.col("event_id").alias("SEQ"), "HOSTNAME", "PID", F.col("ts").alias("TIMESTAMP")
    )


def tags_asof(spark, d):
    late = (
        views.events(spark, d).where(F.col("PID") % 2 == 0).select("HOSTNAME", "PID").distinct()
        .withColumn("TAGS", F.create_map(F.lit("LATE"), F.col("PID").cast("string")))
    )
    return plain(attach_tags(_tag_samples(spark, d), views.execs(spark, d), late).drop("TIMESTAMP"))


def tags_alive(spark, d):
    live = views.events(spark, d).where((F.col("event_type") == "click") & (F.col("k") >= 95))
    return plain(live_tags(views.execs(spark, d), live).select("HOSTNAME", "PID", "seq", "TAGS"))


def key_drift(spark, d):
    rows = views.events(spark, d).select(
        F.window("ts", "600 seconds")["end"].alias("TIMESTAMP"), views.event_tags().alias("TAGS")
    )
    return plain(tag_key_drift(rows, 600))


def _labels(metrics, *names):
    label = [F.try_element_at("labels", F.lit(n)).alias(n) for n in names]
    return plain(metrics.select("TIMESTAMP", *label, "name", "help", "value"))


_LABELS = ["HOSTNAME", "UID", "COMM", "MOUNT", "REMOTE_PATH", "JOBID"]


def _command_samples(spark, d):
    rows = attach_tags(_located(spark, d), views.execs(spark, d)).drop("TID", "SBDEV")
    return durations_to_seconds(group_stats(rows, ["TIMESTAMP", "HOSTNAME", "COMM"], order=["SEQ"]))


def metrics_long(spark, d):
    return _labels(to_metrics(_command_samples(spark, d), ["JOBID"]), *_LABELS)


def metrics_drained(spark, d):
    metrics = to_metrics(_command_samples(spark, d), ["JOBID"])
    since, until = (F.lit(t).cast("timestamp") for t in ("2024-01-08", "2024-01-20"))
    return _labels(drain_metrics(metrics, since, until), *_LABELS)


def metrics_merged(spark, d):
    per_process = samples(spark, d, interval=30 * DAY, squash_pid=False)
    return _labels(to_metrics(per_process, ["JOBID"], merge=True), *_LABELS)


def ring_latest(spark, d):
    kept = newest_samples(count_calls(views.calls(spark, d), HOUR), buffer_size=100)
    return plain(kept)


def buffer_fill(spark, d):
    return buffer_usage(count_calls(views.calls(spark, d), HOUR), buffer_size=800)


def retention(spark, d):
    files = views.events(spark, d).groupBy(
        "HOSTNAME", F.concat("HOSTNAME", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("path")
    ).agg(F.max("ts").alias("modified"), F.sum(F.col("k").cast("long") * 4096).alias("bytes"))
    return plain(retained_files(files, max_size_mb=14, max_backups=5))


def kafka_records(spark, d):
    rows = samples(spark, d)
    records = rows.select(message_key().alias("key"), json_unix(rows).alias("value"), message_headers(TRACKED).alias("headers"))
    body = F.from_json("value", T.StructType([T.StructField("TIMESTAMP", T.LongType())] + [f for f in SAMPLE_SCHEMA.fields if f.name != "TIMESTAMP"]))
    return plain(records.select(
        F.col("key").cast("string").alias("key"),
        F.array_join("headers.key", "|").alias("header_names"),
        F.array_join(F.transform("headers.value", lambda v: v.cast("string")), "|").alias("header_values"),
        body.alias("b"),
    ).select("key", "header_names", "header_values", "b.*"))


def _json_back(rows, text, time_type):
    fields = [T.StructField("TIMESTAMP", time_type)] + [f for f in SAMPLE_SCHEMA.fields if f.name != "TIMESTAMP"]
    schema = T.StructType(fields)
    return plain(rows.select(F.from_json(text, schema).alias("r")).select("r.*"))


def iso(spark, d):
    rows = samples(spark, d)
    return _json_back(rows, json_iso(rows), T.StringType())


def unix(spark, d):
    rows = samples(spark, d)
    return _json_back(rows, json_unix(rows), T.LongType())


def conform_env_columns(spark, d):
    target = T.StructType.fromDDL(
        "TIMESTAMP TIMESTAMP, PID INT, OPEN_COUNT INT, READ_DURATION DOUBLE, ENV_JOBID STRING, ENV_NOPE STRING"
    )
    return plain(conform(samples(spark, d, squash_pid=False), target))


def sample_transpose(spark, d):
    """All fields; durations as numbers, because engines write small ones differently."""
    long = transpose(samples(spark, d, interval=7 * DAY), ["MOUNT", "COMM", "TAGS"])
    seconds = F.col("field").endswith("_DURATION")
    return plain(long.select(
        "TIMESTAMP", "HOSTNAME", "sample_no", "field",
        F.when(~seconds, F.col("value")).alias("value"), F.when(seconds, F.col("value").cast("double")).alias("seconds"),
    ))


def _stored(df, name):
    """A given table in a log format, in a new folder; returns its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def source_probe(spark, d):
    hits = views.probe_events(spark, d).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PROBE_SCHEMA.fields])
    return plain(pair_calls(logs.probe_events(spark, _stored(hits, "probe-log"))))


def source_counters(spark, d):
    return plain(logs.raw_counters(spark, _stored(_raw_counters(spark, d), "counter-log")))


def source_execs(spark, d):
    rows = _environs(spark, d).select("HOSTNAME", "PID", "ts", F.col("event_id").alias("seq"), "environ")
    return plain(logs.tagged_execs(spark, _stored(rows, "exec-log"), ["JOB", "SCHEDID"]).select("HOSTNAME", "PID", "seq", "TAGS"))


def source_parts(spark, d):
    cust = F.col("c_custkey")
    rows = views.table(spark, d, "customer").select(
        F.concat(F.lit("host"), cust % 4).alias("HOSTNAME"), (cust * 2654435 % F.lit(4294967296)).alias("st_dev"),
        F.concat(F.lit("/mnt/"), F.lower("c_mktsegment"), cust).alias("mountpoint"),
        F.concat(F.lit("10.2.0."), F.col("c_nationkey"), F.lit(":/vol")).alias("device"),
        F.when(cust % 5 == 0, F.lit("ext4")).otherwise(F.lit("nfs4")).alias("fstype"),
        F.timestamp_seconds(F.lit(1704067200) + cust).alias("seen_at"),
    )
    found = parse_partitions(logs.partition_list(spark, _stored(rows, "partition-list")))
    return plain(found)


def source_mountinfo(spark, d):
    """One file per host and process, as collected: the lines of a process are one task's."""
    path = scratch_path(spark, "mountinfo")
    cust = F.col("c_custkey")
    lines = _mount_lines(spark, d).select(
        F.concat(F.lit("host"), cust % 3).alias("host"), F.when(cust % 2 == 0, F.lit("self")).otherwise(F.lit("77")).alias("pid"), "value"
    )
    lines.repartition("host", "pid").write.partitionBy("host", "pid").text(path)
    found = read_mountinfo(spark, f"{path}/*/*/*", r"host=([^/]+)/pid=([^/]+)/[^/]+$")
    return found.select("HOSTNAME", "devt", "MOUNT", "device", "source")


def sink_table(spark, d):
    """Stored by micro-batches of which each is replayed, in between a new tag column."""
    table = f"callscope_check.samples_{uuid.uuid4().hex[:12]}"
    create_sample_table(spark, table)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_JOBID STRING)")
    sink, rows = TableSink(table, learn_tags=True, refresh_seconds=0), samples(spark, d)
    sink.setup(spark)
    for batch_id in (0, 1):
        part = rows.where(F.pmod(F.xxhash64("HOSTNAME", "COMM"), F.lit(2)) == batch_id)
        for _ in range(2):
            sink.write(part, batch_id)
        if batch_id == 0:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_SCHEDID STRING)")
    stored = spark.table(table)
    learned = F.col("batch_id") == 0  # the first batch was stored before the second column was there
    wide = stored.withColumn("ENV_SCHEDID", F.when(learned, tag_value(F.col("TAGS"), "SCHEDID")).otherwise(F.col("ENV_SCHEDID")))
    return plain(wide.drop("batch_id"))


def sink_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    sink = MetricsSink(path, ["JOBID"])
    for _ in range(2):
        sink.write(_command_samples(spark, d), 7)
    return _labels(spark.read.schema("TIMESTAMP TIMESTAMP, name STRING, help STRING, labels MAP<STRING, STRING>, value DOUBLE").parquet(f"{path}/batch=7"), *_LABELS)


def sink_fanout(spark, d):
    """Two sinks and an empty micro-batch between; what both hold."""
    files, metrics = JsonFileSink(scratch_path(spark, "samples")), MetricsSink(scratch_path(spark, "metrics"))
    deliver = fan_out([files, metrics])
    rows = written(samples(spark, d), "all-samples")
    deliver(rows, 0)
    deliver(rows.where("false"), 1)
    deliver(rows, 0)
    stored = logs.stored_samples(spark, files.path)
    counted = spark.read.parquet(f"{metrics.path}/batch=0").where("name LIKE '%READ_COUNT'")
    total = counted.groupBy(F.col("labels")["HOSTNAME"].alias("HOSTNAME"), "TIMESTAMP").agg(F.sum("value").cast("long").alias("reads"))
    own = stored.groupBy("HOSTNAME", "TIMESTAMP").agg(F.count("*").alias("samples"), F.sum("READ_COUNT").alias("stored_reads"))
    return plain(own.join(total, ["HOSTNAME", "TIMESTAMP"], "full"))


def sink_rotation(spark, d):
    """Five days of counters per micro-batch in volumes of 0.2 MB, each micro-batch replayed; what is left of them, by volume."""
    sink = JsonFileSink(scratch_path(spark, "rotated"), max_size_mb=0.2, max_backups=3, lane_bytes=50_000)
    counters = written(count_calls(views.calls(spark, d), DAY), "counters")
    for batch_id in range(6):
        rows = counters.where(F.floor((F.unix_seconds("TIMESTAMP") - 1704067200) / F.lit(5 * DAY)) == batch_id)
        for _ in range(2):
            sink.write(rows, batch_id)
    lines = spark.read.text(sink.path)
    return lines.groupBy("volume", "batch").agg(
        F.count("*").alias("samples"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min("value").alias("first_line")
    ).select(F.col("volume").cast("long").alias("volume"), F.col("batch").cast("long").alias("batch"), "samples", "bytes", "first_line")


def _refusal(use: Callable[[], object]) -> str | None:
    """The kind of error that a call ends with, if any."""
    try:
        use()
    except (ValueError, NotImplementedError) as error:
        return type(error).__name__
    return None


def anonymize_allowed(spark, d):
    """Every column that may be masked is, in the whole dataflow; all others are refused."""
    refused = [c for c in SAMPLE_COLUMNS if _refusal(lambda: check_anonymizable([c]))]
    allowed = [c for c in SAMPLE_COLUMNS if c not in refused]
    return plain(samples(spark, d, anon_fields=allowed).withColumn("refused", F.lit(len(refused)).cast("long")))


def option_rules(spark, d):
    """Every combination of tag filter, given names and learned names: its samples, or the kind of error."""
    parts = []
    for how, given, learned in itertools.product([None, "any", "all", "none"], [False, True], [False, True]):
        options = {"tag_filter": how, "tracked": TRACKED if given else [], "tracked_from_table": learned}
        found = []
        refused = _refusal(lambda: found.append(samples(spark, d, interval=7 * DAY, **options)))  # noqa: B023
        rows = samples(spark, d, interval=7 * DAY).where("false") if refused else found[0]
        parts.append(rows.agg(F.count(F.lit(1)).alias("samples"), F.sum("READ_COUNT").cast("long").alias("reads")).select(
            F.lit(how or "").alias("tag_filter"), F.lit(given).alias("given"), F.lit(learned).alias("learned"),
            F.lit(refused or "").alias("refused"), "samples", F.coalesce("reads", F.lit(0).cast("long")).alias("reads"),
        ))
    return reduce(DataFrame.unionAll, parts)


def learned_order(spark, d):
    """Names learned from a table whose tag columns stand in another order: headers follow the sorted names."""
    table = f"callscope_check.samples_{uuid.uuid4().hex[:12]}"
    create_sample_table(spark, table)
    for name in reversed([*TRACKED, "ABSENT"]):
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_{name} STRING)")
    sink = TableSink(table, learn_tags=True)
    sink.setup(spark)
    rows = samples(spark, d)
    return rows.select(message_key().cast("string").alias("key"), message_headers(sink.tracked).alias("headers")).select(
        "key", F.array_join("headers.key", "|").alias("header_names"),
        F.array_join(F.transform("headers.value", lambda v: v.cast("string")), "|").alias("header_values"),
    )


def sink_console(spark, d):
    """The lines of the console's table, taken apart again; durations as numbers."""
    lines = ConsoleSink(table_format=True).lines(samples(spark, d, interval=7 * DAY, squash_pid=False))
    part = lambda i: F.regexp_extract("line", r"^(\S+ \S+) (\S+) (\d+) (\S+) (.*)$", i)
    seconds = part(4).endswith("_DURATION")
    return lines.select(
        part(1).alias("TIMESTAMP"), part(2).alias("HOSTNAME"), part(3).cast("int").alias("sample_no"), part(4).alias("field"),
        F.when(~seconds, part(5)).alias("value"), F.when(seconds, part(5).cast("double")).alias("seconds"),
    )


class _MessageFiles(KafkaSink):
    """Messages go to files, as Spark's connector for the real thing is no part of PySpark."""

    def __init__(self, path: str, **options):
        super().__init__(bootstrap_servers="none:9092", topic="samples", **options)
        self.path = path

    def send(self, records: DataFrame) -> None:
        records.write.mode("append").parquet(self.path)


def sink_messages(spark, d):
    """Messages that are sent and those that are too large for a request and set aside; samples of every fifth process have a long path."""
    sent, aside = scratch_path(spark, "messages"), scratch_path(spark, "too-large")
    sink, rows = _MessageFiles(sent, tracked=TRACKED, set_aside=aside, max_request_size=4096), written(samples(spark, d), "all-samples")
    rows = rows.withColumn("REMOTE_PATH", F.when(F.col("PID") % 5 == 0, F.repeat(F.lit("/p"), 2048)).otherwise(F.col("REMOTE_PATH")))
    for batch_id in (0, 1):
        sink.write(rows.where(F.pmod(F.unix_seconds("TIMESTAMP") / DAY, F.lit(2)) == batch_id), batch_id)
    stored = spark.read.parquet(sent).withColumn("sent", F.lit(True)).unionByName(
        spark.read.parquet(f"{aside}/batch=*").withColumn("sent", F.lit(False))
    )
    body = F.from_json(F.col("value").cast("string"), "TIMESTAMP LONG, MOUNT STRING, READ_COUNT LONG, REMOTE_PATH STRING")
    return stored.select(
        "sent", F.col("key").cast("string").alias("key"), F.size("headers").alias("headers"), body.alias("b")
    ).select("sent", "key", "headers", "b.TIMESTAMP", "b.MOUNT", "b.READ_COUNT", F.length("b.REMOTE_PATH").alias("path_length"))


def sink_retry(spark, d):
    """A column that is added after the schema was read: the first write fails, the second one has it."""
    table = f"callscope_check.samples_{uuid.uuid4().hex[:12]}"
    create_sample_table(spark, table)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_JOBID STRING)")
    sink = TableSink(table, learn_tags=True)
    sink.setup(spark)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_SCHEDID STRING)")
    sink.write(samples(spark, d), 0)
    return plain(spark.table(table).drop("batch_id").withColumn("retries", F.lit(sink.retries).cast("long")))


def sink_once(spark, d):
    """A table without partitions: every micro-batch is replayed, one after it was cut off before the ledger had it."""
    table = f"callscope_check.plain_{uuid.uuid4().hex[:12]}"
    spark.sql("CREATE DATABASE IF NOT EXISTS callscope_check")
    spark.sql(f"CREATE TABLE {table} (TIMESTAMP TIMESTAMP, HOSTNAME STRING, COMM STRING, READ_COUNT BIGINT, ENV_JOBID STRING) USING parquet")
    rows, ledger = samples(spark, d), scratch_path(spark, "ledger")
    for batch_id in (0, 1, 2):
        part = rows.where(F.pmod(F.xxhash64("HOSTNAME", "COMM"), F.lit(3)) == batch_id)
        for again in (False, True):
            sink = TableSink(table, ledger=ledger)
            sink.setup(spark)
            sink.write(part, batch_id)
            if batch_id == 1 and not again:
                delete_path(spark, f"{ledger}/{batch_id}")
    return plain(spark.table(table))


def sink_source(spark, d):
    """Stored through a registered data source, one batch twice, and read back through it."""
    path = scratch_path(spark, "source")
    sink, rows = make_sink("source", path=path), samples(spark, d)
    sink.setup(spark)
    for batch_id in (0, 1, 0):
        sink.write(rows.where(F.pmod(F.xxhash64("HOSTNAME"), F.lit(2)) == batch_id), batch_id)
    return plain(spark.read.format(sink.source.name()).load(path))


def _hourly_batches(spark, d, parts=8):
    """Counters by the hour, in micro-batches of some days each."""
    counters = count_calls(views.calls(spark, d), HOUR)
    days = 30 * DAY // parts
    for batch_id in range(parts):
        since = F.unix_seconds("TIMESTAMP") - 1704067200 - HOUR
        yield batch_id, counters.where(F.floor(since / F.lit(days)) == batch_id)


def _filled_buffer(spark, d):
    buffer = BufferSink(scratch_path(spark, "buffer"), buffer_size=150)
    for batch_id, rows in _hourly_batches(spark, d):
        buffer.write(rows, batch_id)
        if batch_id in (0, 5):
            buffer.write(rows, batch_id)  # replayed
    return buffer


def stream_ring(spark, d):
    """What the buffer holds after eight micro-batches."""
    return plain(_filled_buffer(spark, d).samples(spark))


def stream_ring_usage(spark, d):
    """How full each host's buffer was after each of them."""
    return plain(_filled_buffer(spark, d).usage(spark).withColumn("batch", F.col("batch").cast("long")))


def scrape_drain(spark, d):
    """Three scrapes between micro-batches; the second one fails after it has stored its rows and is repeated."""
    buffer, out = BufferSink(scratch_path(spark, "buffer"), buffer_size=100_000), scratch_path(spark, "scrapes")
    rows = _command_samples(spark, d)
    failing = {2}

    def store(held, number):
        to_metrics(held, ["JOBID"]).write.mode("overwrite").parquet(f"{out}/scrape={number}")
        if number in failing:
            failing.remove(number)
            raise ConnectionError("the scraper went away")

    for batch_id in range(6):
        days = F.floor((F.unix_seconds("TIMESTAMP") - 1704067200) / F.lit(5 * DAY))
        part = rows.where(F.least(days, F.lit(5)) == batch_id)
        buffer.write(part, batch_id)
        if batch_id in (1, 3, 5):
            try:
                buffer.scrape(spark, store)
            except ConnectionError:
                buffer.write(part, batch_id)  # replayed meanwhile: the scrape has it already
                buffer.scrape(spark, store)
    buffer.scrape(spark, store)  # nothing since
    scraped = spark.read.parquet(out)
    label = [F.try_element_at("labels", F.lit(n)).alias(n) for n in _LABELS]
    return plain(scraped.select(F.col("scrape").cast("long").alias("scrape"), "TIMESTAMP", *label, "name", "help", "value"))


def stream_tumble(spark, d):
    return plain(streams.tumbled_counters(spark, d, DAY))


def stream_late(spark, d):
    return plain(streams.late_counters(spark, d, DAY))


def stream_pairs(spark, d):
    return plain(streams.paired_calls(spark, d))


def stream_tags(spark, d):
    return plain(streams.tagged_samples(spark, d))


def stream_pairs_sliced(spark, d):
    return plain(streams.sliced_calls(spark, d))


def stream_tags_sliced(spark, d):
    return plain(streams.sliced_tags(spark, d))


def stream_samples(spark, d):
    return plain(streams.collected_samples(spark, d, DAY).select(*SAMPLE_COLUMNS))


def stream_samples_sliced(spark, d):
    return plain(streams.sliced_samples(spark, d, DAY).select(*SAMPLE_COLUMNS))


def stream_stop(spark, d):
    """A collector that is stopped and goes on from its checkpoint; how often its sink was closed by then."""
    stored, closed = streams.stopped_samples(spark, d, DAY)
    return plain(stored.select(*SAMPLE_COLUMNS, F.lit(closed).cast("long").alias("closed")))


def stream_ttl(spark, d):
    return plain(streams.forgetting(spark, d)[0].select(*SAMPLE_COLUMNS))


def stream_ttl_state(spark, d):
    """Rows that are kept after each micro-batch but the last, of open calls and of execs."""
    kept = streams.forgetting(spark, d)[1].where(F.col("name").isin("rows", "execs") & (F.col("batch") < streams.FEW_PARTS))
    return plain(kept.withColumn("batch", F.col("batch").cast("long")))


def stream_late_rows(spark, d):
    late = streams.set_aside(spark, d)
    return plain(late.select("HOSTNAME", "TID", "seq", "phase", "t_ns", F.col("batch").cast("long").alias("batch")))


def stream_late_tags(spark, d):
    return plain(streams.asked_late(spark, d).select(*SAMPLE_COLUMNS))


def stream_mounts(spark, d):
    return plain(streams.mounts_seen(spark, d, DAY // 4).select(*SAMPLE_COLUMNS))


def stream_learned(spark, d):
    """A tag column is added when half of the events have arrived; processes that started before have it, too."""
    table = f"callscope_check.samples_{uuid.uuid4().hex[:12]}"
    create_sample_table(spark, table)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_JOBID STRING)")
    stored = streams.learned_names(spark, d, table, lambda: spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_SCHEDID STRING)"))
    return plain(stored.drop("batch_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "call_counters": call_counters,
    "counter_flatten": counter_flatten,
    "call_errors": call_errors,
    "item_counters": item_counters,
    "samples_squash": samples_squash,
    "samples_per_pid": samples_per_pid,
    "probe_samples": probe_samples,
    "group_by_mount": group_by_mount,
    "group_by_comm_pid": group_by_comm_pid,
    "group_last_nulls": group_last_nulls,
    "tag_filter_any": tag_filter_any,
    "tag_filter_all": tag_filter_all,
    "anonymize": anonymized,
    "anonymize_allowed": anonymize_allowed,
    "option_rules": option_rules,
    "learned_order": learned_order,
    "mount_lookup": mount_lookup,
    "mount_precedence": mount_precedence,
    "mount_upsert": mount_upsert,
    "mount_asof": mount_asof,
    "remote_path": remote_paths,
    "devt_format": devt_format,
    "mountinfo_parse": mountinfo_parse,
    "env_parse": env_parse,
    "pair_calls": paired,
    "pair_calls_fine": paired_fine,
    "tags_asof": tags_asof,
    "tags_alive": tags_alive,
    "tag_key_drift": key_drift,
    "metrics_long": metrics_long,
    "metrics_merged": metrics_merged,
    "metrics_drained": metrics_drained,
    "ring_latest": ring_latest,
    "buffer_usage": buffer_fill,
    "retention": retention,
    "kafka_records": kafka_records,
    "json_iso": iso,
    "json_unix": unix,
    "conform_env_columns": conform_env_columns,
    "sample_transpose": sample_transpose,
    "stream_tumble": stream_tumble,
    "stream_late": stream_late,
    "stream_pairs": stream_pairs,
    "source_probe": source_probe,
    "source_counters": source_counters,
    "source_execs": source_execs,
    "source_parts": source_parts,
    "source_mountinfo": source_mountinfo,
    "sink_table": sink_table,
    "sink_metrics": sink_metrics,
    "sink_fanout": sink_fanout,
    "stream_tags": stream_tags,
    "stream_pairs_sliced": stream_pairs_sliced,
    "stream_tags_sliced": stream_tags_sliced,
    "stream_samples": stream_samples,
    "stream_samples_sliced": stream_samples_sliced,
    "sink_console": sink_console,
    "sink_messages": sink_messages,
    "sink_rotation": sink_rotation,
    "sink_retry": sink_retry,
    "sink_once": sink_once,
    "sink_source": sink_source,
    "stream_ring": stream_ring,
    "stream_ring_usage": stream_ring_usage,
    "scrape_drain": scrape_drain,
    "stream_stop": stream_stop,
    "stream_ttl": stream_ttl,
    "stream_ttl_state": stream_ttl_state,
    "stream_late_rows": stream_late_rows,
    "stream_late_tags": stream_late_tags,
    "stream_mounts": stream_mounts,
    "stream_learned": stream_learned,
}
