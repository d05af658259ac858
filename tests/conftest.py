import pytest
from helpers import sample_row, utc

from callscope.model import SAMPLE_SCHEMA
from callscope.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__warehouse__dir="/tmp/callscope-tests-warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def samples(spark):
    """Four known sample rows."""
    early, late = utc(2024, 8, 14, 23, 36, 28), utc(2024, 8, 14, 23, 36, 33)
    rows = [
        sample_row(PID=1, COMM="ls", OPEN_COUNT=2, READDIR_DURATION=0.001502957, ACCESS_DURATION=0.000503295,
                   TIMESTAMP=early, TAGS={"FOO": "BAR", "JOB": "1"}),
        sample_row(PID=1, COMM="ls", OPEN_COUNT=2, READDIR_DURATION=0.000099768, ACCESS_DURATION=0.000509714,
                   MMAP_ERRORS=1, TIMESTAMP=early, TAGS={"FOO": "BAR", "TAR": "1"}),
        sample_row(PID=2, COMM="bash", OPEN_COUNT=1, READDIR_DURATION=0.000100742, ACCESS_DURATION=0.000451683,
                   TIMESTAMP=late, TAGS={"FOO": "BAR"}),
        sample_row(PID=2, COMM="ls", OPEN_COUNT=1, READDIR_DURATION=0.000100742, ACCESS_DURATION=0.000451683,
                   TIMESTAMP=late, TAGS={"FOO": "BAR", "JOB": "2"}),
    ]
    return spark.createDataFrame(rows, SAMPLE_SCHEMA).coalesce(1)
