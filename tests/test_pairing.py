import random

import pytest

from callscope.model import FILE_OPERATIONS, OP_NUMBER, PROBE_SCHEMA, PROBES
from callscope.operators.counters import count_calls
from callscope.operators.pairing import pair_calls

COLUMNS = ["HOSTNAME", "TID", "SBDEV", "OP_NO", "SEQ", "DURATION_NS", "RC", "REQ_BYTES"]


def random_events(seed, n, hot=0.5):
    rng = random.Random(seed)
    probes = list(PROBES) + ["not_a_probe"]
    rows = []
    for seq in range(n):
        tid = 1 if rng.random() < hot else rng.randint(2, 6)
        entry = rng.random() < 0.55
        rows.append((
            f"h{rng.randint(0, 1)}", tid, tid // 2, 1000, f"c{tid}", rng.choice(probes), "E" if entry else "R",
            rng.randint(0, 40 * 10**9), seq,
            rng.choice([0, 5]) if entry else None, rng.choice([0o100644, 0o040755, 0o120777, 0o140644]) if entry else None,
            rng.randint(0, 9) if entry else None, rng.randint(0, 9999) if entry else None,
            None if entry else rng.choice([0, 3, -5]),
        ))
    return rows


def state_machine(rows):
    """One open entry per thread; a return takes it."""
    opened, done = {}, []
    for r in sorted(rows, key=lambda r: (r[7], r[8], r[6])):
        host, tid, _, _, _, probe, phase, t, seq, name_len, mode, dev, size, rc = r
        if probe not in PROBES:
            continue
        op = PROBES[probe]
        if phase == "E":
            if op in FILE_OPERATIONS and not (name_len > 0 and mode & 0o170000 in (0o100000, 0o040000, 0o120000)):
                continue
            opened[host, tid] = (t, dev, size)
        elif (host, tid) in opened:
            start, dev, size = opened.pop((host, tid))
            done.append((host, tid, dev, OP_NUMBER[op], seq, t - start, rc, size))
    return sorted(done)


@pytest.mark.parametrize("slice_seconds", [1, 7, 3600])
def test_pairs_equal_state_machine(spark, slice_seconds):
    rows = random_events(slice_seconds, 1500)
    events = spark.createDataFrame(rows, PROBE_SCHEMA)
    got = pair_calls(events, slice_seconds).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == state_machine(rows)


def test_rules(spark):
    def hit(probe, phase, t, **kw):
        row = dict(HOSTNAME="h", TID=1, PID=1, UID=0, COMM="c", probe=probe, phase=phase, t_ns=t, seq=t,
                   name_len=3, mode=0o100644, sbdev=9, bytes=100, rc=0)
        row.update(kw)
        return tuple(row[f] for f in PROBE_SCHEMA.names)

    events = spark.createDataFrame([
        hit("nfs_getattr", "E", 1), hit("nfs_getattr", "R", 2),                    # plain
        hit("nfs_file_open", "E", 10), hit("nfs_lookup", "E", 11),                 # nested: inner replaces outer
        hit("nfs_lookup", "R", 12), hit("nfs_file_open", "R", 13),                 # so the outer return finds nothing
        hit("nfs_file_splice_read", "E", 20, bytes=7), hit("nfs_file_splice_read", "R", 25, rc=-5),
        hit("nfs_file_read", "E", 30, name_len=0), hit("nfs_file_read", "R", 31),  # no name: no entry
    ], PROBE_SCHEMA)
    got = sorted(map(tuple, pair_calls(events).select("OP_NO", "DURATION_NS", "REQ_BYTES", "RC").collect()))
    assert got == sorted([
        (OP_NUMBER["GETATTR"], 1, 100, 0), (OP_NUMBER["LOOKUP"], 1, 100, 0), (OP_NUMBER["READ"], 5, 7, -5),
    ])


def test_counting_rules(spark):
    calls = spark.createDataFrame(
        [("h", 1, 1, 0, "c", 5, OP_NUMBER[op], 1_000_000 * s, s, 10, rc, 4096) for s, (op, rc) in enumerate([
            ("READ", 5), ("READ", -5), ("WRITE", 0), ("OPEN", 2), ("OPEN", 0), ("MKDIR", -1)])],
        "HOSTNAME string, TID long, PID long, UID long, COMM string, SBDEV long, OP_NO int, us long, SEQ long, "
        "DURATION_NS long, RC long, REQ_BYTES long",
    ).selectExpr("* EXCEPT (us)", "timestamp_micros(us) AS TS")
    row = count_calls(calls, 60).first()
    assert (row.READ_COUNT, row.READ_ERRORS, row.READ_BYTES, row.READ_DURATION) == (2, 1, 8192, 20)
    assert (row.WRITE_COUNT, row.WRITE_ERRORS, row.WRITE_BYTES) == (1, 0, 4096)
    assert (row.OPEN_COUNT, row.OPEN_ERRORS, row.MKDIR_ERRORS, row.RMDIR_COUNT) == (2, 1, 1, 0)
    assert row.SEQ == 5 and row.TIMESTAMP.minute == 1
