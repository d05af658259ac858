from helpers import utc
from pyspark.sql import functions as F

from callscope.model import PARTITION_SCHEMA
from callscope.operators.mounts import attach_mounts, resolve_mounts, upsert_mounts
from callscope.sources.mounts import parse_mountinfo, parse_partitions, read_mountinfo

SELF = """22 1 8:2 / / rw,relatime shared:1 - ext4 /dev/sda2 rw
30 22 0:4 net:[4026532281] /run/netns/x rw shared:9 - nsfs nsfs rw
41 22 0:511 / /net/alpha rw,relatime shared:200 - nfs4 10.9.8.3:/ rw,vers=4.2
42 22 0:77 / /net/beta rw,relatime - nfs4 10.9.8.2:/ rw,vers=4.2
"""
LATER = "50 22 0:640 / {} rw,relatime shared:300 - nfs4 10.9.8.5:/remote rw\n"


def candidates(spark, rows):
    return spark.createDataFrame(
        rows, "HOSTNAME string, devt string, MOUNT string, device string, source int, seen_at timestamp, line_no int"
    )


def test_parse_lines(spark):
    lines = spark.createDataFrame([(line,) for line in SELF.splitlines()], "value string")
    got = sorted(tuple(r) for r in parse_mountinfo(lines).collect())
    assert got == [
        ("0:511", "/net/alpha", "nfs4", "10.9.8.3:/"), ("0:77", "/net/beta", "nfs4", "10.9.8.2:/"),
    ]


def test_read_files(spark, tmp_path):
    for host, pid, text in [("h1", "self", SELF), ("h1", "77", LATER.format("/mnt/proj")), ("h2", "self", SELF)]:
        folder = tmp_path / host / pid
        folder.mkdir(parents=True)
        (folder / "mountinfo").write_text(text)
    got = read_mountinfo(spark, f"{tmp_path}/*/*/mountinfo").select("HOSTNAME", "devt", "source").collect()
    assert sorted(map(tuple, got)) == [
        ("h1", "0:511", 1), ("h1", "0:640", 0), ("h1", "0:77", 1), ("h2", "0:511", 1), ("h2", "0:77", 1),
    ]
    assert upsert_mounts(read_mountinfo(spark, f"{tmp_path}/*/*/mountinfo")).count() == 5


def test_partitions(spark):
    now = utc(2024, 1, 1)
    rows = spark.createDataFrame(
        [("h", 99887, "/net/first", "10.9.8.1:/net/first", "nfs", now),
         ("h", 99888, "/net/beta", "10.9.8.2:/net/beta", "nfs", now),
         ("h", 5, "/", "/dev/sda", "ext4", now)], PARTITION_SCHEMA)
    got = parse_partitions(rows).select("devt", "MOUNT").collect()
    assert sorted(map(tuple, got)) == [("0:99887", "/net/first"), ("0:99888", "/net/beta")]


def test_first_seen_sticks_until_vacuum(spark):
    early, later, next_epoch = utc(2024, 1, 1, 0, 0, 1), utc(2024, 1, 1, 0, 0, 2), utc(2024, 1, 1, 0, 10, 1)
    rows = candidates(spark, [
        ("h", "0:640", "/mnt/proj", "10.9.8.5:/remote", 0, early, 0),
        ("h", "0:640", "/mnt/proj2", "10.9.8.5:/remote", 0, later, 0),
        ("h", "0:640", "/mnt/proj2", "10.9.8.5:/remote", 0, next_epoch, 0),
        ("h", "0:1", "/a", "s:/a", 2, early, 0),
        ("h", "0:1", "/b", "s:/b", 0, early, 3),
        ("h", "0:1", "/c", "s:/c", 0, early, 4),
    ])
    resolved = resolve_mounts(rows, vacuum=600)
    got = {(r.devt, r.epoch % 2): r.MOUNT for r in resolved.collect()}
    assert got == {("0:640", 0): "/mnt/proj", ("0:640", 1): "/mnt/proj2", ("0:1", 0): "/c"}

    facts = spark.createDataFrame(
        [("h", 640, later), ("h", 640, next_epoch), ("h", 641, later), ("other", 640, later)],
        "HOSTNAME string, SBDEV long, TIMESTAMP timestamp",
    )
    found = attach_mounts(facts, resolved, vacuum=600)
    assert sorted((r.HOSTNAME, r.SBDEV, r.MOUNT, r.REMOTE_PATH) for r in found.collect()) == [
        ("h", 640, "/mnt/proj", "/remote"), ("h", 640, "/mnt/proj2", "/remote"), ("h", 641, "", ""),
        ("other", 640, "", ""),
    ]


def test_upsert_latest_write_wins(spark):
    rows = candidates(spark, [
        ("h", "0:1", "/old", "s:/old", 0, utc(2024, 1, 1), 0), ("h", "0:1", "/new", "s:/new", 0, utc(2024, 1, 2), 0),
    ])
    assert [r.MOUNT for r in upsert_mounts(rows).collect()] == ["/new"]


def test_mount_of_device_number(spark):
    facts = spark.range(1).select(F.lit("h").alias("HOSTNAME"), F.lit(8388610).cast("long").alias("SBDEV"), F.lit(utc(2024, 1, 1)).alias("TIMESTAMP"))
    mounts = spark.createDataFrame([("h", "8:2", "/m", "/r")], "HOSTNAME string, devt string, MOUNT string, REMOTE_PATH string")
    assert attach_mounts(facts, mounts).first().MOUNT == "/m"
