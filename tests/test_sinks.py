import json
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.model import TABLE_SCHEMA
from callscope.operators.conform import SchemaError, conform, tag_column_changes, tag_columns
from callscope.sinks import (
    BufferSink, ConsoleSink, JsonFileSink, MetricsSink, Sink, SourceSink, TableSink, fan_out, make_sink, register_sink,
)
from callscope.sinks.files import in_volumes
from callscope.sinks.kafka import KafkaSink, kafka_options, message_records
from callscope.sinks.table import create_sample_table
from callscope.sources.logs import stored_samples


@pytest.fixture
def table(spark):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_conform(spark, samples):
    target = T.StructType.fromDDL("PID int, OPEN_COUNT int, ENV_JOB string")
    rows = conform(samples, target).collect()
    assert [r.PID for r in rows] == [1, 1, 2, 2]
    assert [r.OPEN_COUNT for r in rows] == [2, 2, 1, 1]
    assert [r.ENV_JOB for r in rows] == ["1", "", "", "2"]
    assert conform(samples, TABLE_SCHEMA).schema.simpleString() == TABLE_SCHEMA.simpleString()
    with pytest.raises(AnalysisException):
        conform(samples, T.StructType.fromDDL("NOT_THERE int"))


def test_tag_columns(spark):
    assert tag_columns(T.StructType.fromDDL("ENV_VAR_2 string, column_1 int, ENV_VAR_1 string")) == ["VAR_1", "VAR_2"]
    with pytest.raises(SchemaError):
        tag_columns(T.StructType.fromDDL("ENV_A int"))
    assert tag_column_changes(["A", "B"], ["B", "C"]) == (["C"], ["A"])


def test_table(spark, samples, table):
    create_sample_table(spark, table)
    create_sample_table(spark, table)
    sink = TableSink(table)
    fan_out([sink])(samples, 0)
    assert spark.table(table).count() == 4
    assert spark.table(table).agg(F.sum("OPEN_COUNT")).first()[0] == 6


def test_table_learns_tags_and_retries(spark, samples, table):
    spark.sql(f"CREATE TABLE {table} (PID int, ENV_JOB string) USING parquet")
    clock, learned = [0.0], []
    sink = TableSink(table, learn_tags=True, refresh_seconds=300, on_tags=learned.append, clock=lambda: clock[0])
    sink.setup(spark)
    sink.write(samples, 0)
    assert learned == [["JOB"]]
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_TAR string)")
    sink.write(samples, 1)  # does not fit: read again and tried again
    assert learned[-1] == ["JOB", "TAR"] and sink.tracked == ["JOB", "TAR"]
    assert spark.table(table).count() == 8
    clock[0] = 301.0
    sink.write(samples, 2)
    assert len(learned) == 3


def test_table_without_learning_fails(spark, samples, table):
    spark.sql(f"CREATE TABLE {table} (PID int) USING parquet")
    sink = TableSink(table)
    sink.setup(spark)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (ENV_TAR string)")
    with pytest.raises(AnalysisException):
        sink.write(samples, 0)


def test_missing_column_is_not_retried(spark, samples, table):
    spark.sql(f"CREATE TABLE {table} (NOT_THERE int) USING parquet")
    sink = TableSink(table, learn_tags=True)
    sink.setup(spark)
    read_at = sink.read_at
    with pytest.raises(AnalysisException, match="NOT_THERE"):
        sink.write(samples, 0)
    assert sink.read_at == read_at


def test_files_read_back_and_replay(spark, samples, tmp_path):
    sink = JsonFileSink(str(tmp_path / "out"))
    deliver = fan_out([sink])
    deliver(samples, 0)
    deliver(samples, 0)
    deliver(samples, 1)
    back = stored_samples(spark, sink.path)
    assert back.count() == 8
    order = ["READDIR_DURATION", "COMM"]
    got = back.where("batch = 0").select(samples.columns).orderBy(*order).collect()
    assert got == samples.orderBy(*order).collect()


def test_metrics_sink(spark, samples, tmp_path):
    MetricsSink(str(tmp_path / "m"), ["JOB"]).write(samples, 0)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 260
    MetricsSink(str(tmp_path / "t"), as_text=True).write(samples, 0)
    assert spark.read.text(str(tmp_path / "t")).count() == 260 + 2 * 65


def test_console(samples, capfd):
    ConsoleSink().write(samples, 0)
    ConsoleSink(table_format=True).write(samples, 0)
    shown = capfd.readouterr().out
    assert '"COMM":"bash"' in shown and " COMM bash" in shown


def test_console_shows_every_sample(spark, samples, capfd):
    many = samples.crossJoin(spark.range(60)).drop("id").repartition(7)
    ConsoleSink().write(many, 0)
    assert capfd.readouterr().out.count('"HOSTNAME"') == 240


def test_fan_out(spark, samples):
    seen = []

    @register_sink("probe")
    class Probe(Sink):
        def __init__(self, name):
            self.name = name

        def setup(self, spark):
            seen.append((self.name, "setup"))

        def write(self, batch, batch_id):
            seen.append((self.name, batch_id, batch.count()))

    deliver = fan_out([make_sink("probe", name="a"), make_sink("probe", name="b")])
    deliver(samples, 0)
    deliver(samples.where("false"), 1)
    assert sorted(map(str, seen)) == sorted(map(str, [("a", "setup"), ("b", "setup"), ("a", 0, 4), ("b", 0, 4)]))
    with pytest.raises(ValueError):
        make_sink("nowhere")

    class Broken(Sink):
        def write(self, batch, batch_id):
            raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        fan_out([Broken()])(samples, 0)


def test_message_records(samples):
    records = message_records(samples, ["JOB"])
    assert records.schema.simpleString() == (
        "struct<key:binary,value:binary,headers:array<struct<key:string,value:binary>>>"
    )
    row = records.first()
    body = json.loads(bytes(row.value))
    assert bytes(row.key) == b"worker-a:ls:1000:1"
    assert body["TIMESTAMP"] == 1723678588 and body["TAGS"] == {"FOO": "BAR", "JOB": "1"}
    assert [h.key for h in row.headers][-1] == "JOB"


def test_kafka_options(tmp_path):
    cert, key = tmp_path / "c.pem", tmp_path / "k.pem"
    cert.write_text("C")
    key.write_text("K")
    tls = dict(ssl_cert=str(cert), ssl_key=str(key))
    login = dict(sasl_username="u", sasl_password="p")
    base = dict(bootstrap_servers=["a:1", "b:2"], topic="t")
    plain = kafka_options(**base)
    assert plain["kafka.bootstrap.servers"] == "a:1,b:2" and plain["kafka.batch.size"] == "16384"
    full = kafka_options(**base, **tls, **login, security_protocol="SASL_SSL", sasl_mechanism="SCRAM-SHA-256")
    assert 'username="u"' in full["kafka.sasl.jaas.config"] and full["kafka.ssl.keystore.key"] == "K"
    for wrong in [
        login, tls, dict(security_protocol="SASL_PLAINTEXT"), dict(security_protocol="SSL"),
        dict(security_protocol="SASL_SSL", **login), dict(security_protocol="SASL_SSL", **tls),
        dict(security_protocol="NONE"), dict(compression_type="zip"), dict(sasl_mechanism="X"),
    ]:
        with pytest.raises(ValueError):
            kafka_options(**base, **wrong)


def test_table_replaces_a_replayed_batch(spark, samples, table):
    create_sample_table(spark, table)
    sink = TableSink(table)
    sink.setup(spark)
    sink.write(samples, 3)
    sink.write(samples, 3)
    sink.write(samples, 4)
    stored = spark.table(table)
    assert stored.count() == 8
    assert sorted({(r["date"], r["batch_id"]) for r in stored.collect()}) == [("2024-08-14", 3), ("2024-08-14", 4)]
    assert "PartitionFilters: [isnotnull(date" in stored.where("date = '2024-08-14'")._jdf.queryExecution().toString()


def volumes(spark, sink):
    rows = spark.read.text(sink.path).groupBy("volume").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count("*").alias("n"))
    return {r["volume"]: (r["bytes"], r["n"]) for r in rows.collect()}


def test_small_batches_share_a_volume(spark, samples, tmp_path):
    sink = JsonFileSink(str(tmp_path / "out"), max_size_mb=1, max_backups=2)
    for n in range(5):
        sink.write(samples, n)
        sink.write(samples, n)  # replayed
    assert stored_samples(spark, sink.path).count() == 20 and list(volumes(spark, sink)) == [0]


def test_rotation_keeps_the_newest_batch_whole(spark, samples, tmp_path):
    many = samples.crossJoin(spark.range(500)).withColumn("PID", F.col("id")).drop("id").repartition(20)
    sink = JsonFileSink(str(tmp_path / "out"), max_size_mb=0.5, max_backups=1, lane_bytes=300_000)
    sink.write(samples, 0)
    sink.write(many, 1)
    held = volumes(spark, sink)
    assert stored_samples(spark, sink.path).where("batch = 1").count() == 2000  # more than the log may hold
    assert max(held.values())[0] <= 512 * 1024 and min(b for b, _ in list(held.values())) > 0
    sink.write(many.limit(900), 2)
    held = volumes(spark, sink)
    assert stored_samples(spark, sink.path).where("batch = 2").count() == 900
    assert sorted(held)[-1] - sorted(held)[0] <= 3 and all(b <= 512 * 1024 for b, _ in held.values())
    sink.write(samples.where("false"), 3)
    assert volumes(spark, sink) == held


def test_rotation_orders_a_batch_in_the_tasks_it_is_given(spark, samples):
    lines = samples.select(F.to_json(F.struct("PID", "COMM", "TAGS")).alias("value")).withColumn("bytes", F.octet_length("value").cast("long") + 1)
    total = lines.agg(F.sum("bytes")).first()[0]
    placed = in_volumes(lines.repartition(60), 3, 10, 60, 2, 2)
    assert placed.rdd.getNumPartitions() <= 2  # not the partitions of the batch, nor of the session
    ends = sorted((r["volume"] for r in placed.collect()))
    assert len(ends) == 4 and ends[-1] == 3 + (total + 10 - 1) // 60


def test_a_kept_batch_has_the_partitions_its_bytes_need(spark, samples):
    kept = samples.groupBy("PID", "COMM").count().persist()
    try:
        assert kept.count() == 3 and kept.rdd.getNumPartitions() == 1
    finally:
        kept.unpersist()


def test_lines_longer_than_a_volume(spark, samples, tmp_path):
    sink = JsonFileSink(str(tmp_path / "out"), max_size_mb=0.001, max_backups=10)
    sink.write(samples, 0)
    assert [n for _, n in volumes(spark, sink).values()] == [1, 1, 1, 1]


def timed(spark, samples, count, start=0):
    """One row for each of ``count`` intervals of two hosts."""
    rows = spark.range(start, start + count).select(F.timestamp_seconds(F.col("id") * 5).alias("at"))
    one = samples.limit(1).crossJoin(rows).withColumn("TIMESTAMP", F.col("at")).drop("at")
    return one.withColumn("HOSTNAME", F.explode(F.array(F.lit("a"), F.lit("b"))))


def test_buffer_drops_the_oldest_and_warns(spark, samples, tmp_path, caplog):
    buffer = BufferSink(str(tmp_path / "buffer"), buffer_size=10)
    buffer.write(timed(spark, samples, 8), 0)
    assert not caplog.records  # 80 % is not above 80 %
    buffer.write(timed(spark, samples, 1, 8), 1)
    assert "90.00 %" in caplog.text
    buffer.write(timed(spark, samples, 6, 9), 4)
    buffer.write(timed(spark, samples, 6, 9), 4)  # replayed
    held = buffer.samples(spark)
    assert held.count() == 20 and held.agg(F.min(F.unix_seconds("TIMESTAMP"))).first()[0] == 25
    usage = {(r["batch"], r["HOSTNAME"]): r["samples"] for r in buffer.usage(spark).collect()}
    assert usage == {(b, h): n for b, n in ((0, 8), (1, 9), (4, 10)) for h in "ab"}
    for batch_id in (5, 6):
        buffer.write(timed(spark, samples, 10, batch_id * 100), batch_id)
    left = sorted(p.name for p in (tmp_path / "buffer" / "rows").iterdir())
    assert left == ["batch_id=5", "batch_id=6"]  # the newest, and what a replay of it starts from


def test_scrapes_share_nothing_and_lose_nothing(spark, samples, tmp_path):
    buffer, seen = BufferSink(str(tmp_path / "buffer")), {}

    def deliver(rows, number, fail=False):
        seen[number] = sorted(r[0] for r in rows.select(F.unix_seconds("TIMESTAMP")).where("HOSTNAME = 'a'").collect())
        if fail:
            raise ConnectionError("gone")

    assert buffer.scrape(spark, deliver) is None
    buffer.write(timed(spark, samples, 3), 0)
    assert buffer.scrape(spark, deliver) == 1
    buffer.write(timed(spark, samples, 3), 0)  # replayed after the scrape took it
    assert buffer.samples(spark) is None
    buffer.write(timed(spark, samples, 2, 3), 1)
    with pytest.raises(ConnectionError):
        buffer.scrape(spark, lambda rows, n: deliver(rows, n, fail=True))
    again = BufferSink(str(tmp_path / "buffer"))  # a new driver
    again.write(timed(spark, samples, 2, 5), 2)
    assert again.scrape(spark, deliver) == 2 and seen[2] == [15, 20]
    assert again.scrape(spark, deliver) == 3 and again.scrape(spark, deliver) is None
    assert seen == {1: [0, 5, 10], 2: [15, 20], 3: [25, 30]}


def test_ledger_stores_each_batch_once(spark, samples, table, tmp_path):
    spark.sql(f"CREATE TABLE {table} (PID int, COMM string) USING parquet")
    store = lambda batch_id: TableSink(table, ledger=str(tmp_path / "ledger")).write(samples, batch_id)
    for batch_id in (0, 0, 1):
        store(batch_id)
    assert spark.table(table).count() == 8
    (tmp_path / "ledger" / "1").unlink()  # cut off between moving and entering
    store(1)
    assert spark.table(table).count() == 8
    spark.sql(f"CREATE TABLE {table}_p (PID int, COMM string) USING parquet PARTITIONED BY (COMM)")
    with pytest.raises(ValueError, match="partitions"):
        TableSink(f"{table}_p", ledger=str(tmp_path / "other")).write(samples, 0)
    spark.sql(f"DROP TABLE {table}_p")


def test_overwriting_leaves_the_session_alone(spark, samples, table):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    create_sample_table(spark, table)
    TableSink(table).write(samples, 0)
    assert spark.conf.get(key) == before


class FoundSink(Sink):
    def write(self, batch, batch_id):
        pass


def test_sinks_of_installed_packages(monkeypatch, caplog):
    from importlib.metadata import EntryPoint

    from callscope.sinks import SINKS, base, discover_sinks

    offered = [
        EntryPoint("found", "test_sinks:FoundSink", "callscope.sinks"), EntryPoint("broken", "no_such_module:X", "callscope.sinks"),
        EntryPoint("file", "test_sinks:FoundSink", "callscope.sinks"),
    ]
    monkeypatch.setattr(base, "entry_points", lambda group: [e for e in offered if e.group == group])
    monkeypatch.setitem(SINKS, "found", None)
    del SINKS["found"]
    assert discover_sinks() == ["found"] and "broken" in caplog.text
    assert type(make_sink("found")).__name__ == "FoundSink" and SINKS["file"] is JsonFileSink
    monkeypatch.setattr(base, "entry_points", lambda group: [EntryPoint("wrong", "json:dumps", group)])
    with pytest.raises(TypeError, match="wrong"):
        discover_sinks()


def test_source_writes_are_whole(spark, samples, tmp_path):
    path = str(tmp_path / "source")
    sink = SourceSink(path)
    sink.setup(spark)
    for batch_id in (0, 1, 0):
        sink.write(samples, batch_id)
    back = spark.read.format("callscope").load(path)
    order = ["READDIR_DURATION", "COMM"]
    assert back.count() == 8
    assert back.orderBy(*order).limit(2).collect() == samples.orderBy(*order).limit(1).collect() * 2
    fails = samples.withColumn("PID", F.when(F.col("COMM") == "bash", F.raise_error(F.lit("down")).cast("long")).otherwise(F.col("PID")))
    with pytest.raises(Exception, match="down"):
        fails.repartition(4).write.format("callscope").mode("append").save(path)
    assert spark.read.format("callscope").load(path).count() == 8
    assert not any((tmp_path / "source" / "_staged").iterdir())
    samples.limit(1).write.format("callscope").mode("overwrite").save(path)
    assert spark.read.format("callscope").load(path).count() == 1


def test_messages_that_are_too_large_are_set_aside(spark, samples, tmp_path):
    sent = []

    class Recorded(KafkaSink):
        def send(self, records):
            sent.extend(records.collect())

    sink = Recorded(set_aside=str(tmp_path / "aside"), bootstrap_servers="a:1", topic="t", max_request_size=10_000)
    sink.write(samples.withColumn("MOUNT", F.when(F.col("COMM") == "bash", F.repeat(F.lit("x"), 20_000)).otherwise(F.col("MOUNT"))), 5)
    assert len(sent) == 3 and spark.read.parquet(str(tmp_path / "aside" / "batch=5")).count() == 1
