"""What several test modules build their rows from."""

from datetime import datetime, timezone

from callscope.model import SAMPLE_SCHEMA, STAT_COLUMNS


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def sample_row(**values):
    row = {f.name: 0 for f in SAMPLE_SCHEMA.fields}
    row.update({c: 0.0 for c in STAT_COLUMNS if c.endswith("_DURATION")})
    row.update(
        TIMEDELTA=5, HOSTNAME="worker-a", UID=1000, MOUNT="/mnt", REMOTE_PATH="/remote/mnt",
        READDIR_COUNT=2, ACCESS_COUNT=1, ACCESS_ERRORS=1,
    )
    row.update(values)
    return tuple(row[f.name] for f in SAMPLE_SCHEMA.fields)
