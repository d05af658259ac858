"""The data model: operations, statistics, probe names and schemas.

Everything downstream (aggregates, flattening, metrics, table definitions) is
generated from the single ordered list of operations below.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Operation families, in the column order of a sample row.
OPERATIONS = [
    "OPEN", "CLOSE", "READ", "WRITE", "GETATTR", "SETATTR", "FLUSH", "FSYNC",
    "LOCK", "MMAP", "READDIR", "CREATE", "LINK", "UNLINK", "SYMLINK", "LOOKUP",
    "RENAME", "ACCESS", "MKDIR", "RMDIR", "LISTXATTR",
]

# Operations that move data and so carry a byte total.
BYTE_OPERATIONS = ["READ", "WRITE"]

# Operations whose entry is kept only for a named file, directory or symlink.
FILE_OPERATIONS = [
    "OPEN", "CLOSE", "READ", "WRITE", "FLUSH", "FSYNC", "LOCK", "MMAP", "READDIR",
]

# Probe name -> operation.
PROBES = {
    "nfs_file_open": "OPEN",
    "nfs4_file_open": "OPEN",
    "nfs_file_release": "CLOSE",
    "nfs_file_read": "READ",
    "nfs_file_splice_read": "READ",
    "nfs_file_write": "WRITE",
    "nfs_getattr": "GETATTR",
    "nfs_setattr": "SETATTR",
    "nfs_file_flush": "FLUSH",
    "nfs4_file_flush": "FLUSH",
    "nfs_file_fsync": "FSYNC",
    "nfs_lock": "LOCK",
    "nfs_flock": "LOCK",
    "nfs_file_mmap": "MMAP",
    "nfs_readdir": "READDIR",
    "nfs_create": "CREATE",
    "nfs_link": "LINK",
    "nfs_unlink": "UNLINK",
    "nfs_symlink": "SYMLINK",
    "nfs_lookup": "LOOKUP",
    "nfs_rename": "RENAME",
    "nfs_do_access": "ACCESS",
    "nfs_mkdir": "MKDIR",
    "nfs_rmdir": "RMDIR",
    "nfs4_listxattr": "LISTXATTR",
    "nfs3_listxattr": "LISTXATTR",
}

# File type bits of a mode word, and the types a filtered operation keeps:
# directory, regular file, symbolic link.
MODE_TYPE_MASK = 0o170000
KEPT_FILE_TYPES = [0o040000, 0o100000, 0o120000]

# Low bits of a device number that hold the minor number.
DEVICE_MINOR_BITS = 20

# Fields that may be anonymized.
ANONYMIZABLE = ["COMM", "MOUNT", "PID", "UID", "TAGS", "REMOTE_PATH"]

# Prefix of target-table columns that are filled from a tag.
TAG_COLUMN_PREFIX = "ENV_"

# Prefix of every exported metric name and help text.
METRIC_PREFIX = "vnfs_"

# Operating defaults: interval, tag/mount state lifetime and schema refresh in
# seconds, number of buffered samples and the fill level that warns (percent).
DEFAULT_INTERVAL = 5
DEFAULT_VACUUM = 600
DEFAULT_SCHEMA_REFRESH = 300
DEFAULT_BUFFER_SAMPLES = 1000
BUFFER_WARN_PERCENT = 80
DEFAULT_FILE_MB = 200
DEFAULT_FILE_BACKUPS = 5
# --- end of fixed values ----------------------------------------------------

OP_NUMBER = {op: i for i, op in enumerate(OPERATIONS)}


def stat_columns_of(op: str) -> list[str]:
    """The statistics columns of one operation, in sample-row order."""
    kinds = ["COUNT", "ERRORS", "DURATION"] + (["BYTES"] if op in BYTE_OPERATIONS else [])
    return [f"{op}_{kind}" for kind in kinds]


STAT_COLUMNS = [c for op in OPERATIONS for c in stat_columns_of(op)]
DURATION_COLUMNS = [f"{op}_DURATION" for op in OPERATIONS]


def _help_text(column: str) -> str:
    op, kind = column.rsplit("_", 1)
    if kind == "DURATION":
        return f"Total NFS {op} duration (in seconds)"
    if kind == "BYTES":
        return f"Total NFS {op} bytes"
    return f"Number of NFS {op} {'calls' if kind == 'COUNT' else 'errors'}"


METRIC_HELP = {c: _help_text(c) for c in STAT_COLUMNS}

SAMPLE_COLUMNS = (
    ["TIMEDELTA", "TIMESTAMP", "HOSTNAME", "PID", "UID", "COMM"]
    + STAT_COLUMNS
    + ["TAGS", "MOUNT", "REMOTE_PATH"]
)

TAGS_TYPE = T.MapType(T.StringType(), T.StringType())


def _fields(*pairs) -> list[T.StructField]:
    return [T.StructField(name, dtype) for name, dtype in pairs]


_LONG, _STR, _INT, _DBL = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType()


def struct_of(**columns: T.DataType) -> T.StructType:
    """A schema of named columns, usable before there is a session."""
    return T.StructType(_fields(*columns.items()))


# Who made a call: one kernel thread of a process on a host.
CALLER_COLUMNS = ["HOSTNAME", "TID", "PID", "UID", "COMM"]
_CALLER = [("HOSTNAME", _STR), ("TID", _LONG), ("PID", _LONG), ("UID", _LONG), ("COMM", _STR)]

# One probe hit. phase is "E" at function entry and "R" at its return.
# name_len and mode describe the file (entry rows), sbdev the device, bytes the
# requested size (entry rows), rc the return code (return rows).
PROBE_SCHEMA = T.StructType(_fields(
    *_CALLER,
    ("probe", _STR), ("phase", _STR), ("t_ns", _LONG), ("seq", _LONG),
    ("name_len", _INT), ("mode", _INT), ("sbdev", _LONG), ("bytes", _LONG), ("rc", _LONG),
))

# One completed call. OP_NO indexes OPERATIONS.
CALL_SCHEMA = T.StructType(_fields(
    *_CALLER,
    ("SBDEV", _LONG), ("OP_NO", _INT), ("TS", T.TimestampType()), ("SEQ", _LONG),
    ("DURATION_NS", _LONG), ("RC", _LONG), ("REQ_BYTES", _LONG),
))

_STAT_STRUCT = T.StructType(_fields(("count", _LONG), ("duration", _LONG), ("errors", _LONG)))

# Raw per-thread counters as drained from a host: one struct per operation.
RAW_COUNTER_SCHEMA = T.StructType(
    _fields(("TIMESTAMP", T.TimestampType()), *_CALLER, ("SBDEV", _LONG), ("SEQ", _LONG))
    + [T.StructField(op.lower(), _STAT_STRUCT) for op in OPERATIONS]
    + _fields(("rbytes", _LONG), ("wbytes", _LONG))
)

# A started process and its environment block (NUL-separated text).
EXEC_SCHEMA = T.StructType(_fields(
    ("HOSTNAME", _STR), ("PID", _LONG), ("ts", T.TimestampType()), ("seq", _LONG), ("environ", _STR),
))

# A row of a host's partition list.
PARTITION_SCHEMA = T.StructType(_fields(
    ("HOSTNAME", _STR), ("st_dev", _LONG), ("mountpoint", _STR), ("device", _STR),
    ("fstype", _STR), ("seen_at", T.TimestampType()),
))


def _sample_type(column: str, narrow: bool) -> T.DataType:
    if column == "TIMESTAMP":
        return T.TimestampType()
    if column in ("HOSTNAME", "COMM", "MOUNT", "REMOTE_PATH"):
        return _STR
    if column == "TAGS":
        return TAGS_TYPE
    if column.endswith("_DURATION"):
        return _DBL
    if narrow and (column in ("PID", "UID", "TIMEDELTA") or column.endswith("_ERRORS")):
        return _INT
    return _LONG


# A sample row as computed (counters 64 bit) and as stored in a table.
SAMPLE_SCHEMA = T.StructType([T.StructField(c, _sample_type(c, False)) for c in SAMPLE_COLUMNS])

_TABLE_ORDER = (
    ["TIMESTAMP", "HOSTNAME", "PID", "UID", "COMM"]
    + STAT_COLUMNS
    + ["MOUNT", "TAGS", "TIMEDELTA", "REMOTE_PATH"]
)
TABLE_SCHEMA = T.StructType([T.StructField(c, _sample_type(c, True)) for c in _TABLE_ORDER])
