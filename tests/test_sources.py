import pytest
from helpers import utc

from callscope.model import EXEC_SCHEMA, OPERATIONS, PARTITION_SCHEMA, RAW_COUNTER_SCHEMA
from callscope.operators.tagging import late_tags, with_tag_columns
from callscope.plans import storage
from callscope.sources import logs

START = utc(2024, 1, 1)


def test_raw_counters(spark, tmp_path):
    stats = [{"count": i, "duration": 10 * i, "errors": i % 2} for i in range(len(OPERATIONS))]
    row = (START.replace(microsecond=7), "h", 11, 1, 0, "c", 5, 3, *stats, 4096, 8192)
    spark.createDataFrame([row], RAW_COUNTER_SCHEMA).write.parquet(str(tmp_path / "raw"))
    got = logs.raw_counters(spark, str(tmp_path / "raw")).first()
    assert (got.OPEN_COUNT, got.CLOSE_COUNT, got.CLOSE_ERRORS, got.LISTXATTR_DURATION) == (0, 1, 1, 200)
    assert (got.READ_BYTES, got.WRITE_BYTES, got.PID, got.TID) == (4096, 8192, 1, 11)
    assert got.TIMESTAMP.microsecond == 0
    assert logs.raw_counters(spark, str(tmp_path / "raw"), stream=True).isStreaming


def test_execs_and_late_tags(spark, tmp_path):
    rows = [("h", 1, START, 0, "JOB=1\0"), ("h", 2, START, 1, "A=1\0"), ("h", 2, START, 2, "JOB=2\0")]
    spark.createDataFrame(rows, EXEC_SCHEMA).write.json(str(tmp_path / "execs"))
    tagged = logs.tagged_execs(spark, str(tmp_path / "execs"), ["JOB"], fmt="json")
    assert sorted((r.PID, r.TAGS["JOB"]) for r in tagged.collect()) == [(1, "1"), (2, "2")]
    late = late_tags(logs.exec_events(spark, str(tmp_path / "execs"), fmt="json"), ["JOB"])
    assert {r.PID: r.TAGS for r in late.collect()} == {1: {"JOB": "1"}, 2: {}}


def test_partition_list_and_table_schema(spark, tmp_path):
    spark.createDataFrame([("h", 1, "/m", "s:/m", "nfs", START)], PARTITION_SCHEMA).write.parquet(str(tmp_path / "p"))
    assert logs.partition_list(spark, str(tmp_path / "p")).first().mountpoint == "/m"
    spark.sql("CREATE TABLE IF NOT EXISTS known_columns (PID int, ENV_JOB string) USING parquet")
    assert logs.table_schema(spark, "known_columns").names == ["PID", "ENV_JOB"]
    spark.sql("DROP TABLE known_columns")


def test_tag_columns(samples):
    rows = with_tag_columns(samples, ["JOB", "NONE"], "ENV_").collect()
    assert [(r.ENV_JOB, r.ENV_NONE) for r in rows] == [("1", ""), ("", ""), ("", ""), ("2", "")]


class OtherSession:
    """Stands for a session elsewhere: settings and master only."""

    def __init__(self, master, folder=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.folder, self.applicationId = master, folder, f"app-{master}"

    def get(self, key, default):
        return self.folder or default


def test_work_folder(spark):
    assert storage.work_folder(OtherSession("spark://x", "s3://shared/tmp")) == "s3://shared/tmp"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.work_folder(OtherSession("spark://x"))
    local = storage.work_folder(OtherSession("local[2]"))
    assert local == storage.work_folder(OtherSession("local[2]"))
    assert storage.written(spark.range(3), "three").count() == 3
