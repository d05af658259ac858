import pytest
from pyspark.sql import functions as F

from callscope.operators.stats import anonymize, filter_stats, group_stats, keep_processes, squash_processes

ORDER = ["TIMESTAMP", "ROW"]


@pytest.fixture(scope="module")
def ordered(samples):
    # Row order of the fixture within one second.
    return samples.withColumn("ROW", F.when(F.col("COMM") == "bash", 3).when(F.col("PID") == 2, 4).otherwise(1))


def test_group_by_command(ordered):
    bash, ls = group_stats(ordered, ["MOUNT", "COMM"], ORDER, sort=True).collect()
    assert (bash.COMM, ls.COMM) == ("bash", "ls")
    assert (bash.PID, ls.PID) == (2, 2)
    assert (bash.OPEN_COUNT, ls.OPEN_COUNT) == (1, 5)
    assert bash.READDIR_DURATION == 0.000100742
    assert ls.READDIR_DURATION == pytest.approx(0.001703467, abs=1e-15)


def test_group_by_process(ordered):
    one, two = group_stats(ordered, ["MOUNT", "PID"], ORDER, sort=True).collect()
    assert (one.PID, two.PID) == (1, 2)
    assert (one.COMM, two.COMM) == ("ls", "ls")
    assert (one.OPEN_COUNT, two.OPEN_COUNT) == (4, 2)
    assert one.READDIR_DURATION == 0.0016027250000000002
    assert two.READDIR_DURATION == 0.000201484


def test_group_by_tags_ignores_key_order(spark):
    df = spark.sql(
        "SELECT map('a','1','b','2') AS TAGS, 1L AS OPEN_COUNT, 1 AS ROW "
        "UNION ALL SELECT map('b','2','a','1'), 2L, 2 UNION ALL SELECT map('a','1'), 4L, 3"
    )
    rows = group_stats(df, ["TAGS"], ["ROW"], sort=True).collect()
    assert [(r.TAGS, r.OPEN_COUNT) for r in rows] == [({"a": "1"}, 4), ({"a": "1", "b": "2"}, 3)]


def test_null_keys_and_last_non_null(spark):
    df = spark.createDataFrame(
        [("a", "x", 1, 1), ("a", None, 1, 2), (None, "y", 1, 3)], "HOSTNAME string, MOUNT string, OPEN_COUNT long, ROW int"
    )
    rows = group_stats(df, ["HOSTNAME"], ["ROW"]).collect()
    assert [(r.HOSTNAME, r.MOUNT, r.OPEN_COUNT, r.ROW) for r in rows] == [("a", "x", 2, 2)]


def test_presets(ordered):
    assert squash_processes(ordered, ["ROW"]).count() == 4
    assert keep_processes(ordered.withColumn("TAGS", F.create_map().cast("map<string,string>")), ["ROW"]).count() == 2


@pytest.mark.parametrize(
    "tags, how, rows",
    [
        (["FOO"], "any", 4), (["JOB"], "any", 2), (["TAR"], "any", 1), (["TAR", "JOB"], "any", 3), ([], "any", 0),
        (["FOO"], "all", 4), (["FOO", "JOB"], "all", 2), (["FOO", "TAR"], "all", 1), (["TAR", "JOB"], "all", 0),
        ([], "all", 4), (["FO"], "any", 0),
    ],
)
def test_tag_filter(samples, tags, how, rows):
    assert filter_stats(samples, tags, how).count() == rows


def test_unknown_tag_filter(samples):
    with pytest.raises(NotImplementedError):
        filter_stats(samples, ["FOO"], "none")


def test_anonymize(samples):
    rows = anonymize(samples, ["MOUNT", "COMM", "PID", "TAGS"]).collect()
    assert [(r.MOUNT, r.COMM, r.PID, r.UID) for r in rows] == [("--", "--", 0, 1000)] * 4
    assert [r.TAGS for r in rows] == [
        {"FOO": "--", "JOB": "--"}, {"FOO": "--", "TAR": "--"}, {"FOO": "--"}, {"FOO": "--", "JOB": "--"},
    ]


def test_anonymize_refuses(samples):
    with pytest.raises(ValueError, match="HOSTNAME"):
        anonymize(samples, ["HOSTNAME"])
    with pytest.raises(ValueError, match="cannot be masked"):
        anonymize(samples.withColumn("PID", F.col("TIMESTAMP")), ["PID"])


def test_last_is_the_same_for_any_order_of_rows(samples):
    """Without a sequence all other columns decide, so that rows that tie are equal."""
    shuffled = samples.orderBy(F.desc("COMM"), F.desc("OPEN_COUNT"))
    first, second = (group_stats(df, ["MOUNT"]).collect() for df in (samples, shuffled.coalesce(1)))
    assert first == second
