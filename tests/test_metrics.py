from datetime import timedelta

from helpers import utc
from pyspark.sql import functions as F

from callscope.operators.metrics import (
    buffer_usage,
    drain_metrics,
    exposition_lines,
    newest_samples,
    to_metrics,
)
from callscope.operators.reshape import transpose
from callscope.operators.retention import retained_files


def test_65_metrics_per_row(samples):
    metrics = to_metrics(samples, ["JOB"]).collect()
    assert len(metrics) == 260
    opens = [m for m in metrics if m.name == "vnfs_OPEN_COUNT"]
    assert sorted(m.value for m in opens) == [1.0, 1.0, 2.0, 2.0]
    assert opens[0].help == "vnfs_Number of NFS OPEN calls"
    names = to_metrics(samples, ["JOB"]).select(F.map_keys("labels").alias("n")).first().n
    assert names == ["HOSTNAME", "UID", "COMM", "MOUNT", "REMOTE_PATH", "JOB"]
    assert sorted(m.labels["JOB"] for m in opens) == ["", "", "1", "2"]


def test_merge_adds_repeated_series(samples):
    merged = to_metrics(samples, merge=True)
    by_comm = {(m.labels["COMM"], m.TIMESTAMP.second): m.value for m in merged.where("name = 'vnfs_OPEN_COUNT'").collect()}
    assert by_comm == {("ls", 28): 4.0, ("bash", 33): 1.0, ("ls", 33): 1.0}


def test_tracked_name_like_a_label(samples):
    labels = to_metrics(samples, ["COMM"]).first().labels
    assert set(labels) == {"HOSTNAME", "UID", "COMM", "MOUNT", "REMOTE_PATH"} and labels["COMM"] == ""


def test_exposition(samples):
    quoted = samples.where("COMM = 'bash'").withColumn("MOUNT", F.lit('/a"b\\c'))
    lines = [r.value for r in exposition_lines(to_metrics(quoted)).collect()]
    assert (
        'vnfs_OPEN_COUNT{HOSTNAME="worker-a",UID="1000",COMM="bash",MOUNT="/a\\"b\\\\c",REMOTE_PATH="/remote/mnt"} 1.0'
        in lines
    )
    at = lines.index("# HELP vnfs_OPEN_COUNT vnfs_Number of NFS OPEN calls")
    assert lines[at + 1] == "# TYPE vnfs_OPEN_COUNT gauge" and lines[at + 2].startswith("vnfs_OPEN_COUNT{")


def test_drain(samples):
    metrics = to_metrics(samples)
    first, second = utc(2024, 8, 14, 23, 36, 28), utc(2024, 8, 14, 23, 36, 33)
    assert drain_metrics(metrics, None, first).count() == 130
    assert drain_metrics(metrics, first, second).count() == 130
    assert drain_metrics(metrics, second, second).count() == 0


def ring(spark, counts):
    start = utc(2024, 1, 1)
    rows = [(h, start + timedelta(seconds=5 * i), i, c) for h, n in counts.items() for i in range(n) for c in "xy"]
    return spark.createDataFrame(rows, "HOSTNAME string, TIMESTAMP timestamp, i int, c string")


def test_newest_samples(spark):
    kept = newest_samples(ring(spark, {"a": 20, "b": 3}), buffer_size=5)
    assert {(r.HOSTNAME, r.i) for r in kept.collect()} == {("a", i) for i in range(15, 20)} | {("b", i) for i in range(3)}
    assert kept.count() == 16


def test_buffer_usage(spark):
    got = {r.HOSTNAME: (r.samples, r.usage_pct, r.over_limit) for r in buffer_usage(
        ring(spark, {"a": 801, "b": 800, "c": 1001})).collect()}
    assert got == {"a": (801, 801 / 1000 * 100, True), "b": (800, 80.0, False), "c": (1000, 100.0, True)}


def test_retention(spark):
    start = utc(2024, 1, 1)
    files = spark.createDataFrame(
        [("a", f"p{i}", start + timedelta(hours=i), 400_000) for i in range(10)]
        + [("b", f"q{i}", start + timedelta(hours=i), 2_000_000) for i in range(3)],
        "HOSTNAME string, path string, modified timestamp, bytes long",
    )
    kept = {r.path for r in retained_files(files, max_size_mb=1, max_backups=2).collect()}
    assert kept == {"p9", "p8", "p7", "q2"}


def test_transpose(samples):
    rows = transpose(samples, ["MOUNT", "COMM", "PID", "TAGS"])
    assert rows.count() == 4 * 72
    bash = rows.where("field = 'COMM' AND value = 'bash'").first()
    assert (bash.sample_no, bash.TIMESTAMP.second) == (0, 33)
