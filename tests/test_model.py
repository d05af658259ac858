from callscope import model


def test_statistics():
    assert len(model.OPERATIONS) == 21
    assert len(model.STAT_COLUMNS) == len(set(model.STAT_COLUMNS)) == 65
    assert model.STAT_COLUMNS[:10] == [
        "OPEN_COUNT", "OPEN_ERRORS", "OPEN_DURATION", "CLOSE_COUNT", "CLOSE_ERRORS", "CLOSE_DURATION",
        "READ_COUNT", "READ_ERRORS", "READ_DURATION", "READ_BYTES",
    ]
    assert model.METRIC_HELP["READ_BYTES"] == "Total NFS READ bytes"
    assert model.METRIC_HELP["MKDIR_ERRORS"] == "Number of NFS MKDIR errors"


def test_probes_cover_all_operations():
    assert len(model.PROBES) == 26
    assert set(model.PROBES.values()) == set(model.OPERATIONS)


def test_sample_schemas():
    assert len(model.SAMPLE_COLUMNS) == 74
    assert sorted(model.TABLE_SCHEMA.names) == sorted(model.SAMPLE_COLUMNS)
    assert model.TABLE_SCHEMA["PID"].dataType.simpleString() == "int"
    assert model.SAMPLE_SCHEMA["PID"].dataType.simpleString() == "bigint"
