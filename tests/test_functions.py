import json

import pytest
from helpers import utc
from pyspark.sql import functions as F

from callscope.functions.environ import parse_environ
from callscope.functions.records import json_iso, json_unix, message_headers, message_key
from callscope.functions.scalars import command_text, device_text, ns_to_seconds, remote_path, sample_time
from callscope.functions.tags import tag_text, tag_value

ADDRESSES = ["10.20.30.40", "fe80::7", "[fe80::7]", "filer", "filer.lab.example", "filer.lab.example:2049"]
PATHS = ["/", "/vol", "/vol/deep/er"]


def test_remote_path(spark):
    cases = [(f"{a}:{p}", p) for a in ADDRESSES for p in PATHS] + [("/dev/sda1", ""), ("tmpfs", "")]
    rows = spark.createDataFrame(cases, "device string, want string")
    wrong = rows.where(remote_path(F.col("device")) != F.col("want")).collect()
    assert wrong == []


def test_device_text(spark):
    rows = spark.createDataFrame([(420, "0:420"), (8388610, "8:2"), (654321, "0:654321")], "d long, want string")
    assert rows.where(device_text(F.col("d")) != F.col("want")).collect() == []


def test_scalars(spark):
    row = spark.range(1).select(
        ns_to_seconds(F.lit(1502957)).alias("s"),
        command_text(F.lit(bytearray(b"ab\xffc"))).alias("c"),
        sample_time(F.lit(utc(2024, 1, 1, 1, 2, 3).replace(microsecond=999))).alias("t"),
    ).first()
    assert row.s == 0.001502957
    assert row.c == "ab\ufffdc"
    assert row.t.second == 3 and row.t.microsecond == 0


@pytest.mark.parametrize(
    "environ, tags",
    [
        ("JOB=1\0PATH=/bin\0", {"JOB": "1"}),
        ("JOBID=7\0JOB=1\0", {"JOBID": "7", "JOB": "1"}),      # prefix match
        ("JOB=a=b\0", {"JOB": "a"}),                            # cut at the second =
        ("JOB=1\0JOBX\0", {}),                                  # a tracked entry without = empties all
        ("PATH\0JOB=1\0", {"JOB": "1"}),                        # an untracked one does not
        ("JOB=1\0JOB=2\0", {"JOB": "2"}),                       # last wins
        ("JOB=\0", {"JOB": ""}),
        ("JOB=1\0JOB=tail", {"JOB": "1"}),                      # no NUL, no entry
        ("", {}),
        (None, {}),
    ],
)
def test_parse_environ(spark, environ, tags):
    rows = spark.createDataFrame([(environ,)], "e string")
    assert rows.select(parse_environ(F.col("e"), ["JOB"]).alias("t")).first().t == tags


def test_nothing_tracked(spark):
    rows = spark.createDataFrame([("JOB=1\0",)], "e string")
    assert rows.select(parse_environ(F.col("e"), []).alias("t")).first().t == {}


def test_tag_columns(samples):
    rows = samples.orderBy("PID", "COMM", "READDIR_DURATION").select(
        tag_value(F.col("TAGS"), "JOB").alias("j"), tag_text(F.col("TAGS")).alias("t")
    ).collect()
    assert sorted(r.j for r in rows) == ["", "", "1", "2"]
    assert {r.t for r in rows} == {"FOO=BAR;JOB=1", "FOO=BAR;TAR=1", "FOO=BAR", "FOO=BAR;JOB=2"}


def test_json_forms(samples):
    texts = samples.select(json_iso(samples).alias("iso"), json_unix(samples).alias("unix")).collect()
    iso = [json.loads(r.iso) for r in texts]
    unix = [json.loads(r.unix) for r in texts]
    assert len(iso[0]) == 74
    assert {d["TIMESTAMP"] for d in iso} == {"2024-08-14T23:36:28", "2024-08-14T23:36:33"}
    assert {d["TIMESTAMP"] for d in unix} == {1723678588, 1723678593}
    assert iso[0]["TAGS"] == {"FOO": "BAR", "JOB": "1"}
    assert iso[0]["READDIR_DURATION"] == 0.001502957


def test_json_keeps_nulls_and_decodes_bytes(spark):
    df = spark.createDataFrame([(None, bytearray(b"x"))], "a string, b binary")
    assert json.loads(df.select(json_iso(df).alias("j")).first().j) == {"a": None, "b": "x"}


def test_json_fraction_and_unsupported(spark):
    df = spark.createDataFrame([(utc(2024, 1, 1, 0, 0, 0).replace(microsecond=5),)], "t timestamp")
    assert json.loads(df.select(json_iso(df).alias("j")).first().j) == {"t": "2024-01-01T00:00:00.000005"}
    with pytest.raises(TypeError):
        json_iso(df.select(F.array("t").alias("a")))


def test_message_parts(samples):
    row = samples.where("COMM = 'bash'").select(
        message_key().alias("k"), message_headers(["FOO", "JOB"]).alias("h")
    ).first()
    assert bytes(row.k) == b"worker-a:bash:1000:2"
    assert [(h.key, bytes(h.value)) for h in row.h] == [
        ("HOSTNAME", b"worker-a"), ("UID", b"1000"), ("COMM", b"bash"), ("MOUNT", b"/mnt"),
        ("REMOTE_PATH", b"/remote/mnt"), ("FOO", b"BAR"), ("JOB", b""),
    ]
