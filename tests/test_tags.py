import random
from datetime import timedelta

import pytest
from helpers import utc
from pyspark.sql import functions as F

from callscope.model import EXEC_SCHEMA
from callscope.operators.tagging import attach_tags, exec_tags, live_tags, tag_key_changes, tag_key_drift
from callscope.plans import lookup as lookups

SAMPLE = "HOSTNAME string, PID long, TIMESTAMP timestamp, n long"
HISTORY = "HOSTNAME string, PID long, ts timestamp, seq long, TAGS map<string,string>"
START = utc(2024, 1, 1)


def random_case(seed):
    rng = random.Random(seed)
    at = lambda: START + timedelta(seconds=rng.randint(0, 300))
    pid = lambda: 1 if rng.random() < 0.4 else rng.randint(2, 9)
    samples = [(f"h{rng.randint(0, 1)}", pid(), at(), n) for n in range(400)]
    execs = [(f"h{rng.randint(0, 1)}", pid(), at(), s, {"S": str(s)}) for s in range(40)]
    return samples, execs


def newest(samples, execs, late):
    got = {}
    for host, pid, ts, n in samples:
        known = [e for e in execs if e[0] == host and e[1] == pid and e[2] <= ts]
        got[n] = max(known, key=lambda e: (e[2], e[3]))[4] if known else late.get((host, pid), {})
    return got


@pytest.mark.parametrize("slice_seconds", [1, 30, 86400])
def test_as_of_equals_search(spark, slice_seconds):
    samples, execs = random_case(slice_seconds)
    late = {("h0", 1): {"L": "1"}, ("h1", 5): {"L": "2"}}
    got = attach_tags(
        spark.createDataFrame(samples, SAMPLE),
        spark.createDataFrame(execs, HISTORY),
        spark.createDataFrame([(*k, v) for k, v in late.items()], "HOSTNAME string, PID long, TAGS map<string,string>"),
        slice_seconds=slice_seconds,
    )
    assert got.columns == ["HOSTNAME", "PID", "TIMESTAMP", "n", "TAGS"]
    assert {r.n: r.TAGS for r in got.collect()} == newest(samples, execs, late)


def test_nothing_tracked(spark):
    rows = spark.createDataFrame([("h", 1, START, 0)], SAMPLE)
    assert attach_tags(rows, None).first().TAGS == {}


def test_exec_rows_without_tags_are_dropped(spark):
    execs = spark.createDataFrame(
        [("h", 1, START, 0, "JOB=1\0A=2\0"), ("h", 2, START, 1, "A=2\0"), ("h", 3, START, 2, None)], EXEC_SCHEMA
    )
    assert [(r.PID, r.TAGS) for r in exec_tags(execs, ["JOB"]).collect()] == [(1, {"JOB": "1"})]


def test_live_tags(spark):
    tags = spark.createDataFrame([("h", p, START, p, {"A": "1"}) for p in (1, 2, 2, 3)], HISTORY)
    live = spark.createDataFrame([("h", 2), ("h", 2), ("x", 3)], "HOSTNAME string, PID long")
    assert [r.PID for r in live_tags(tags, live).collect()] == [2, 2]


def test_drift(spark):
    minute = lambda m: START + timedelta(minutes=m)
    rows = spark.createDataFrame(
        [(minute(1), {"A": "1"}), (minute(2), {"A": "1", "B": "1"}), (minute(3), {}), (minute(4), {"B": "2"})],
        "TIMESTAMP timestamp, TAGS map<string,string>",
    )
    got = {(r.TIMESTAMP.minute, r.tag, r.change) for r in tag_key_drift(rows, 60).collect()}
    assert got == {(1, "A", "added"), (2, "B", "added"), (3, "A", "removed"), (3, "B", "removed"), (4, "B", "added")}
    changes = tag_key_changes(rows.where("minute(TIMESTAMP) = 1"), rows.where("minute(TIMESTAMP) = 4"))
    assert {tuple(r) for r in changes.collect()} == {("B", "added"), ("A", "removed")}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_lookup_equals_plain(spark, how):
    facts = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), "id",
        F.create_map(F.lit("a"), F.col("id").cast("string")).alias("m"),
    )
    side = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    near = lookups.lookup(facts, side, ["k"], how)
    far = lookups.lookup(facts, side, ["k"], how, salts=4)
    assert far.columns == near.columns
    key = lambda df: sorted((r.id, r.k, str(r)) for r in df.collect())
    assert key(far) == key(near)


def test_lookup_kind(spark):
    with pytest.raises(ValueError):
        lookups.lookup(spark.range(1), spark.range(1), ["id"], "full")
