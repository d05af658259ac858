import pytest

from helpers import utc

from callscope.operators.mounts import resolve_mounts
from callscope.plans.collect import check_options, collect_samples
from workload.queries import QUERIES


def test_option_rules():
    check_options(["JOB"], "any", ["COMM"])
    check_options(tracked_from_table=True)
    with pytest.raises(ValueError, match="tracked names"):
        check_options([], "any")
    with pytest.raises(ValueError, match="not both"):
        check_options(["JOB"], tracked_from_table=True)
    with pytest.raises(NotImplementedError):
        check_options(["JOB"], "some")
    with pytest.raises(ValueError, match="HOSTNAME"):
        check_options(anon_fields=["HOSTNAME"])


def test_a_known_mount_stays_known(spark):
    """One mount table collected once, samples long after it."""
    seen = spark.createDataFrame(
        [("h", "0:7", "/mnt/a", "10.1.1.1:/x", 0, utc(2024, 1, 1, 0, 0, 1), 1), ("h", "0:7", "/mnt/b", "10.1.1.1:/y", 0, utc(2024, 1, 1, 1, 0, 1), 1)],
        "HOSTNAME string, devt string, MOUNT string, device string, source int, seen_at timestamp, line_no long",
    )
    calls = spark.createDataFrame(
        [("h", 1, 1, 0, "c", 7, 0, utc(2024, 1, 1, *t), i, 5, None, 0) for i, t in enumerate([(0, 4), (0, 14), (0, 24), (1, 9, 30), (5, 0)])],
        "HOSTNAME string, TID long, PID long, UID long, COMM string, SBDEV long, OP_NO int, TS timestamp, SEQ long, DURATION_NS long, RC long, REQ_BYTES long",
    )
    rows = collect_samples(calls, resolve_mounts(seen), interval=60).orderBy("TIMESTAMP").collect()
    assert [(r["MOUNT"], r["REMOTE_PATH"]) for r in rows] == [("/mnt/a", "/x")] * 3 + [("/mnt/b", "/y")] * 2
    assert [r["OPEN_ERRORS"] for r in rows] == [0] * 5


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "sink_", "source_", "scrape_"))))
def test_building_a_query_runs_nothing(spark, name):
    """Only reading the schema and footers of files may happen before the action."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build {name}", name)
    try:
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert list(tracker.getJobIdsForGroup(f"build {name}")) == []
    finally:
        spark.sparkContext.setJobGroup("", "")
