"""Streams give what the batch operators give, also when rows come out of order."""

import random
from datetime import timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from helpers import utc
from pyspark.sql import functions as F
from test_pairing import COLUMNS, random_events, state_machine
from test_tags import HISTORY, SAMPLE, newest, random_case

from callscope.model import PROBE_SCHEMA
from callscope.operators.counters import count_calls
from callscope.operators.pairing import pair_calls
from callscope.sinks import JsonFileSink
from callscope.sources.logs import probe_events, stored_samples
from callscope.streaming.collect import start_collect, stop_collect, stream_counters
from callscope.streaming.pairing import OpenCalls, stream_calls
from callscope.operators.mounts import attach_mounts
from callscope.operators.tagging import attach_tags, execs_around
from callscope.plans.collect import samples_from_counters
from callscope.streaming.kept import kept_sizes
from callscope.streaming.sliced import SlicedCollector, start_sliced_collect, together
from callscope.streaming.steps import start_sliced_calls, start_sliced_tags, to_parquet
from callscope.streaming.tagging import stream_tags

FAR = 4_000_000_000 * 10**9


def write_batches(spark, folder, batches, schema):
    """One file per batch, in this order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n:03d}")


def end_row(t=FAR):
    return ("end", 0, 0, 0, "end", "nfs_lookup", "E", t, -1, 1, 0, 0, 0, 0)


def mixed_up(rows, seconds, size):
    """Rows in batches, each row up to ``seconds`` out of place."""
    rng = random.Random(7)
    arrival = sorted(rows, key=lambda r: r[7] + rng.random() * seconds * 10**9)
    return [arrival[i:i + size] for i in range(0, len(arrival), size)]


def read(spark, folder):
    return probe_events(spark, f"{folder}/*", stream=True, maxFilesPerTrigger=1)


def run(stream, tmp_path, name):
    spark = stream.sparkSession
    out, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_pairs_of_late_rows(spark, tmp_path):
    rows = random_events(3, 400)
    write_batches(spark, tmp_path / "in", mixed_up(rows, 5, 150) + [[end_row()]], PROBE_SCHEMA)
    got = run(stream_calls(read(spark, tmp_path / "in"), "10 seconds"), tmp_path, "pairs")
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == state_machine(rows)


class CountedState:
    """One key's state in memory, counting the entries that go to and from it; list, map and value state in one."""

    def __init__(self):
        self.held, self.written, self.read, self.timers = {}, 0, 0, set()

    def getValueState(self, name, schema):
        held = self.held.setdefault(name, {})
        get, put = lambda: held["v"], lambda v: held.update(v=v)
        return SimpleNamespace(get=get, update=put, exists=lambda: "v" in held, clear=held.clear)

    def _put(self, held, rows):
        self.written += len(rows)
        held.update(rows)

    def _take(self, value):
        self.read += 1
        return value

    def getMapState(self, name, key_schema, schema):
        held = self.held.setdefault(name, {})
        return SimpleNamespace(
            keys=lambda: iter(list(held)), getValue=lambda k: self._take(held[k]), removeKey=held.pop,
            updateValue=lambda k, v: self._put(held, {k: v}),
        )

    def getListState(self, name, schema):
        held = self.held.setdefault(name, {})
        add = lambda rows: self._put(held, {len(held) + n: r for n, r in enumerate(rows)})
        return SimpleNamespace(
            get=lambda: map(self._take, list(held.values())), appendList=add, clear=held.clear,
            put=lambda rows: (held.clear(), add(rows)),
        )

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_rows_of_a_thread_are_few_entries_of_the_state():
    """Thousands of rows of a thread, out of order in two micro-batches, travel to and from the state some thousands at a time."""
    n, second = 40_000, 10**9
    rows = pd.DataFrame({
        "HOSTNAME": "h", "TID": 1, "PID": 1, "UID": 0, "COMM": "c", "phase": ["E", "R"] * n, "t_ns": [i * second for i in range(2 * n)],
        "seq": [i // 2 for i in range(2 * n)], "OP_NO": 1, "sbdev": 1, "bytes": 0, "rc": 0,
    })
    late = rows["seq"] % 7 == 3
    state, calls = CountedState(), OpenCalls()
    calls.init(state)
    got = []

    def batch(new, watermark_s):
        frames = [new.iloc[at:at + 10_000] for at in range(0, len(new), 10_000)]
        assert not list(calls.handleInputRows(("h", 1), iter(frames), None))
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_s * 1000)
        for at in sorted(t for t in state.timers if t <= watermark_s * 1000):
            state.timers.remove(at)
            got.extend(calls.handleExpiredTimer(("h", 1), now, None))

    batch(rows[~late].sample(frac=1, random_state=1), 0)
    assert not got
    before = state.read
    batch(rows[late].sample(frac=1, random_state=2), 10_001)
    assert sorted(pd.concat(got)["SEQ"]) == list(range(5000))
    assert state.read - before <= 6  # two entries were reached of those that came first, one or two of the others
    batch(rows[:0], 3 * n)
    calls_done = pd.concat(got)
    assert calls_done["SEQ"].tolist() == list(range(n)) and set(calls_done["DURATION_NS"]) == {second}
    assert state.written <= 24 and not state.held["pending"] and not state.timers


def test_sliced_pairs_of_late_rows_stop_and_go_on(spark, tmp_path):
    rows = random_events(3, 400)
    batches = mixed_up(rows, 5, 150)
    too_late = ("h0", 1, 1, 0, "late", "nfs_lookup", "E", 1, -7, 1, 0, 0, 0, 0)

    write_batches(spark, tmp_path / "in" / "a", batches[:2], PROBE_SCHEMA)
    go_on = lambda: start_sliced_calls(
        probe_events(spark, f"{tmp_path}/in/*/*", stream=True, maxFilesPerTrigger=1), to_parquet(f"{tmp_path}/out"),
        f"{tmp_path}/state", {"availableNow": True}, delay_seconds=10, slice_seconds=2, late_rows=f"{tmp_path}/late",
    ).awaitTermination()
    go_on()
    write_batches(spark, tmp_path / "in" / "b", batches[2:] + [[end_row()], [too_late]], PROBE_SCHEMA)
    go_on()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == state_machine(rows)
    assert [r["seq"] for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [-7]


def test_sliced_pairs_forget_open_calls(spark, tmp_path):
    second = 10**9
    hit = lambda tid, phase, t, seq: ("h", tid, 1, 0, "c", "nfs_lookup", phase, t * second, seq, 1, 0, 0, 0, 0)
    batches = [[hit(1, "E", 1, 1), hit(2, "E", 1, 2), hit(3, "E", 40, 3)], [hit(1, "R", 5, 4), hit(2, "R", 41, 5)], [end_row(100 * second)], [hit(3, "R", 101, 6)], [end_row()]]
    write_batches(spark, tmp_path / "in", batches, PROBE_SCHEMA)
    start_sliced_calls(
        read(spark, tmp_path / "in"), to_parquet(f"{tmp_path}/out"), f"{tmp_path}/state", {"availableNow": True},
        delay_seconds=60, ttl_seconds=30,
    ).awaitTermination()
    assert [(r["TID"], r["DURATION_NS"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 4 * second)]
    assert kept_sizes(spark, f"{tmp_path}/state/kept").where("name = 'rows'").orderBy("batch").first()["n"] == 3


def test_counters_of_pairs(spark, tmp_path):
    rows = random_events(4, 400)
    write_batches(spark, tmp_path / "in", mixed_up(rows, 5, 200) + [[end_row()]], PROBE_SCHEMA)
    calls = stream_calls(read(spark, tmp_path / "in"), "10 seconds")
    got = run(stream_counters(calls, 5), tmp_path, "counters")
    want = count_calls(pair_calls(spark.createDataFrame(rows, PROBE_SCHEMA)), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tags(spark, tmp_path):
    samples, execs = random_case(11)
    far = utc(2090, 1, 1)
    for half, part in enumerate([lambda t: t < utc(2024, 1, 1, 0, 2, 30), lambda t: t >= utc(2024, 1, 1, 0, 2, 30)]):
        rows = [s for s in samples if part(s[2])] + ([("end", 0, far, -1)] if half else [])
        write = lambda rows, schema, to: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(to))
        write(rows, SAMPLE, tmp_path / "s" / str(half))
        write([e for e in execs if part(e[2])], HISTORY, tmp_path / "e" / str(half))
    stream = lambda sub, schema: (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{sub}/*")
    )
    got = run(stream_tags(stream("s", SAMPLE), stream("e", HISTORY), delay="200 seconds"), tmp_path, "tagged")
    assert {r.n: r.TAGS for r in got.collect()} == newest(samples, execs, {})
    start_sliced_tags(
        stream("s", SAMPLE), stream("e", HISTORY), to_parquet(f"{tmp_path}/sliced"), f"{tmp_path}/sliced-state",
        {"availableNow": True}, delay_seconds=200, slice_seconds=30,
    ).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/sliced")
    assert {r.n: r.TAGS for r in got.collect()} == newest(samples, execs, {})


def test_tag_state_expires(spark, tmp_path):
    start = utc(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    spark.createDataFrame([("h", 1, at(0), 0, {"A": "1"})], HISTORY).write.parquet(f"{tmp_path}/e")
    spark.createDataFrame(
        [("h", 1, at(5), 0), ("h", 1, at(50), 1), ("end", 0, at(10**6), 2)], SAMPLE
    ).coalesce(1).write.parquet(f"{tmp_path}/s")
    stream = lambda sub, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{sub}")
    got = run(stream_tags(stream("s", SAMPLE), stream("e", HISTORY), ttl_seconds=10), tmp_path, "out")
    assert {r.n: r.TAGS for r in got.collect()} == {0: {"A": "1"}, 1: {}}
    start_sliced_tags(
        stream("s", SAMPLE), stream("e", HISTORY), to_parquet(f"{tmp_path}/sliced"), f"{tmp_path}/sliced-state",
        {"availableNow": True}, ttl_seconds=10,
    ).awaitTermination()
    assert {r.n: r.TAGS for r in spark.read.parquet(f"{tmp_path}/sliced").collect()} == {0: {"A": "1"}, 1: {}}
    assert kept_sizes(spark, f"{tmp_path}/sliced-state/kept").where("name = 'execs'").agg(F.min("n")).first()[0] == 0


@pytest.mark.parametrize("start", [start_collect, start_sliced_collect])
def test_collect_stops_and_goes_on(spark, tmp_path, start):
    rows = random_events(5, 200)
    batches = mixed_up(rows, 5, 100)
    mounts = spark.range(10).select(
        F.explode(F.array(F.lit("h0"), F.lit("h1"))).alias("HOSTNAME"), F.concat(F.lit("0:"), "id").alias("devt"),
        F.concat(F.lit("/m"), "id").alias("MOUNT"), F.concat(F.lit("/r"), "id").alias("REMOTE_PATH"),
    )
    sink = JsonFileSink(str(tmp_path / "out"))
    folder = tmp_path / "in"

    def go_on():
        query = start(
            read(spark, folder), lambda: mounts, [sink], str(tmp_path / "state"), interval=5,
            trigger={"availableNow": True}, anon_fields=["UID"],
        )
        query.awaitTermination()
        stop_collect(query, [sink])

    write_batches(spark, folder, batches[:1], PROBE_SCHEMA)
    go_on()
    spark.createDataFrame(batches[1], PROBE_SCHEMA).coalesce(1).write.parquet(f"{folder}/900")
    go_on()
    spark.createDataFrame([end_row()], PROBE_SCHEMA).coalesce(1).write.parquet(f"{folder}/999")
    go_on()

    got = stored_samples(spark, sink.path)
    done = state_machine(rows)
    totals = got.selectExpr(
        "sum(" + " + ".join(c for c in got.columns if c.endswith("_COUNT")) + ") AS n", "max(UID) AS uid",
        "count_if(MOUNT = '') AS unknown", "sum(READ_BYTES) AS bytes",
    ).first()
    assert totals.n == len(done)
    assert totals.uid == 0 and totals.unknown == 0
    assert totals.bytes == sum(size for *_, op, _, _, _, size in done if op == 2)
    assert got.groupBy("TIMESTAMP", "HOSTNAME", "MOUNT", "COMM").count().where("count > 1").count() == 0


def test_collect_takes_the_execs_around_a_micro_batch(spark, tmp_path, monkeypatch):
    """Each micro-batch tags its rows from the execs of its own time, not from the whole history."""
    hit = lambda phase, t: ("h", 1, 1, 0, "c", "nfs_lookup", phase, t * 10**9, t, 1, 0, 0, 0, 0)
    calls = [hit("ER"[t % 2], t) for t in range(400)]
    write_batches(spark, tmp_path / "in", [calls[:200], calls[200:], [end_row()]], PROBE_SCHEMA)
    start = utc(1970, 1, 1)
    execs = spark.createDataFrame([("h", 1, start + timedelta(seconds=2 * n), n, {"S": str(n)}) for n in range(500)], HISTORY)
    taken = []

    def counted(*args, execs, **options):
        taken.append(execs.count())
        return samples_from_counters(*args, execs=execs, **options)

    monkeypatch.setattr("callscope.streaming.collect.samples_from_counters", counted)
    sink = JsonFileSink(str(tmp_path / "out"))
    mounts = spark.createDataFrame([], "HOSTNAME string, devt string, MOUNT string, REMOTE_PATH string")
    start_collect(
        read(spark, tmp_path / "in"), mounts, [sink], str(tmp_path / "state"), interval=5, execs=execs, delay="10300 milliseconds",
        trigger={"availableNow": True},
    ).awaitTermination()
    got = {int(r.TIMESTAMP.timestamp()): dict(r.TAGS) for r in stored_samples(spark, sink.path).where("COMM = 'c'").collect()}
    assert got == {t: {"S": str(t // 2)} for t in range(5, 401, 5)}
    assert len(taken) >= 2 and max(taken) <= 110


def test_execs_around_rows_give_the_same_tags(spark):
    """Also for processes without a name or number, whose tags come from repeated execs alone."""
    samples, execs = random_case(12)
    nameless = lambda rows: [(None if r[0] == "h1" else r[0], None if r[1] == 3 else r[1], *r[2:]) for r in rows]
    at = lambda seconds: utc(2024, 1, 1) + timedelta(seconds=seconds)
    rows = spark.createDataFrame([s for s in nameless(samples) if at(100) <= s[2] <= at(160)], SAMPLE)
    history = spark.createDataFrame(nameless(execs), HISTORY)
    micros = [int(t.timestamp() * 10**6) for t in (at(100), at(160))]
    for width in (1, 30, 86400):
        want, got = (
            {r.n: dict(r.TAGS) for r in attach_tags(rows, known, slice_seconds=width).collect()}
            for known in (history, execs_around(history, *micros))
        )
        assert got == want and any(want.values())


def test_sliced_counters_of_late_rows(spark, tmp_path):
    rows = random_events(6, 400, hot=0.7)
    parts = []
    collector = SlicedCollector(
        str(tmp_path / "kept"), lambda counters, n: parts.append(counters.collect()), interval=5, delay_seconds=10,
    )
    batches = [spark.createDataFrame(b, PROBE_SCHEMA) for b in mixed_up(rows, 5, 100) + [[end_row()]]]
    collector(batches[0], 0)
    for n, batch in enumerate(batches[1:], 1):
        before = len(parts)
        collector(batch, n)
        again = parts[before:]
        collector(batch, n)  # a replayed micro-batch gives the same rows again
        assert [sorted(p) for p in parts[before + len(again):]] == [sorted(p) for p in again]
        del parts[before + len(again):]
    want = count_calls(pair_calls(spark.createDataFrame(rows, PROBE_SCHEMA)), 5).collect()
    got = [r for p in parts for r in p]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sliced_drops_rows_of_finished_intervals(spark, tmp_path):
    counted = []
    collector = SlicedCollector(
        str(tmp_path / "kept"), lambda counters, n: counted.extend(counters.collect()), interval=5, delay_seconds=1,
    )
    hit = lambda phase, t: ("h", 1, 1, 0, "c", "nfs_lookup", phase, t * 10**9, t, 1, 0, 0, 0, 0)
    for n, rows in enumerate([[hit("E", 1), hit("R", 2), end_row(20 * 10**9)], [hit("E", 3), hit("R", 4)], [end_row()]]):
        collector(spark.createDataFrame(rows, PROBE_SCHEMA), n)
    assert sum(r.LOOKUP_COUNT for r in counted) == 1


def exec_batch(spark, hits, execs):
    return together(
        spark.createDataFrame(hits, PROBE_SCHEMA),
        spark.createDataFrame(execs, "HOSTNAME string, PID long, ts timestamp, seq long, TAGS map<string,string>"),
    )


def test_sliced_keeps_what_lives(spark, tmp_path):
    """Open calls and newest execs of processes that are gone leave the kept tables; the others' tags still serve."""
    hit = lambda pid, phase, t: ("h", pid, pid, 0, "c", "nfs_lookup", phase, t * 10**9, t, 1, 0, 0, 0, 0)
    second = lambda t: utc(1970, 1, 1) + timedelta(seconds=t)
    seen, alive = [], [(n,) for n in range(1, 9)]

    def deliver(counters, n):
        seen.extend(attach_tags(counters, collector.execs).select("PID", "TAGS").collect())

    collector = SlicedCollector(
        str(tmp_path / "kept"), deliver, interval=5, delay_seconds=1,
        live=lambda: spark.createDataFrame(alive, "PID long").withColumn("HOSTNAME", F.lit("h")),
    )
    kept = lambda n, what: spark.read.parquet(f"{tmp_path}/kept/{n % 2}/{what}")
    execs = [("h", p, second(1), p, {"JOB": str(p)}) for p in range(1, 9)] + [("h", 1, second(2), 9, {"JOB": "new"})]
    collector(exec_batch(spark, [hit(p, "E", 3) for p in range(1, 9)] + [hit(99, "E", 20)], execs), 0)
    assert kept(0, "execs").count() == 8  # the newest of each process
    assert kept(0, "rows").where("PID <> 99").count() == 8  # open entries
    alive[:] = [(1,), (2,)]
    collector(exec_batch(spark, [hit(p, "R", 21) for p in (1, 2)] + [hit(99, "E", 40)], []), 1)
    assert sorted(r["PID"] for r in kept(1, "execs").collect()) == [1, 2]
    assert kept(1, "rows").where("PID NOT IN (1, 2, 99)").count() == 0
    assert sorted((r["PID"], r["TAGS"]["JOB"]) for r in seen) == [(1, "new"), (2, "2")]


def test_missing_values_alike_in_tables_and_streams(spark, tmp_path):
    """A missing code is success, missing bytes none, a missing device has no mount."""
    rows = [
        ("h", 1, 1, 0, "c", "nfs_lookup", "E", 10**9, 1, 1, 0, None, None, None),
        ("h", 1, 1, 0, "c", "nfs_lookup", "R", 2 * 10**9, 2, 1, 0, None, None, None),
    ]
    write_batches(spark, tmp_path / "in", [rows, [end_row()]], PROBE_SCHEMA)
    streamed = run(stream_calls(read(spark, tmp_path / "in"), "10 seconds"), tmp_path, "out").collect()
    stored = pair_calls(spark.createDataFrame(rows, PROBE_SCHEMA))
    assert [tuple(r) for r in streamed] == [tuple(r) for r in stored.collect()]
    counted = count_calls(stored, 5).first()
    assert (counted["SBDEV"], counted["LOOKUP_ERRORS"], counted["LOOKUP_COUNT"]) == (-1, 0, 1)


def seconds(t):
    return utc(1970, 1, 1) + timedelta(seconds=t)


def call_hit(pid, phase, t):
    return ("h", pid, pid, 0, "c", "nfs_lookup", phase, t * 10**9, t, 1, 0, 0, 0, 0)


def test_sliced_forgets_after_its_time(spark, tmp_path):
    """Old execs and open calls leave the kept tables, and what they would have served is as if they had never been."""
    seen = []

    def deliver(counters, n):
        seen.extend(attach_tags(counters, collector.execs, ttl_seconds=30).select("PID", "LOOKUP_COUNT", "TAGS").collect())

    collector = SlicedCollector(str(tmp_path / "kept"), deliver, interval=5, delay_seconds=1, ttl_seconds=30)
    batches = [
        ([call_hit(p, "E", 3) for p in (1, 2)] + [call_hit(9, "E", 12)], [("h", p, seconds(1), p, {"JOB": str(p)}) for p in (1, 2, 3)]),
        ([call_hit(1, "R", 20), call_hit(9, "R", 50)], []),
        ([call_hit(2, "R", 60), call_hit(3, "E", 61), call_hit(3, "R", 62), call_hit(9, "E", 80)], [("h", 3, seconds(55), 9, {"JOB": "new"})]),
    ]
    for n, (hits, execs) in enumerate(batches):
        collector(exec_batch(spark, hits, execs), n)
    sizes = {(r["batch"], r["name"]): r["n"] for r in kept_sizes(spark, str(tmp_path / "kept")).collect()}
    assert [sizes[n, "execs"] for n in range(3)] == [3, 0, 1]  # the state grows and falls
    assert sizes[0, "rows"] == 3 and sizes[1, "rows"] == 1
    assert sorted((r["PID"], r["LOOKUP_COUNT"], r["TAGS"].get("JOB")) for r in seen) == [(1, 1, "1"), (3, 1, "new")]


def test_sliced_asks_once_for_late_tags(spark, tmp_path):
    """The environment is read when a process is first counted without an exec; later changes and empty answers change nothing."""
    seen, environment = [], {}

    def deliver(counters, n):
        seen.extend((n, r["PID"], r["TAGS"]) for r in attach_tags(counters, collector.execs, collector.late_tags).collect())

    def late():
        rows = [("h", p, tags) for p, tags in environment.items()]
        return spark.createDataFrame(rows, "HOSTNAME string, PID long, TAGS map<string,string>")

    collector = SlicedCollector(str(tmp_path / "kept"), deliver, interval=5, delay_seconds=1, late=late)
    call = lambda p, t: [call_hit(p, "E", t), call_hit(p, "R", t + 1)]
    environment[1] = {"JOB": "first"}
    collector(exec_batch(spark, call(1, 1) + call(2, 1) + call(3, 1) + call(9, 10), [("h", 3, seconds(1), 0, {"JOB": "exec"})]), 0)
    environment.update({p: {"JOB": "later"} for p in (1, 2, 3)})
    collector(exec_batch(spark, call(1, 11) + call(2, 11) + call(4, 11) + call(9, 20), [("h", 2, seconds(16), 0, {"JOB": "exec"})]), 1)
    collector(exec_batch(spark, call(2, 21) + call(9, 40), []), 2)
    assert sorted(s for s in seen if s[1] != 9) == [
        (0, 1, {"JOB": "first"}), (0, 2, {}), (0, 3, {"JOB": "exec"}), (1, 1, {"JOB": "first"}), (1, 2, {}), (1, 4, {}), (2, 2, {"JOB": "exec"}),
    ]


def test_sliced_sets_late_rows_aside(spark, tmp_path):
    rows = random_events(8, 300)
    batches = mixed_up(rows, 60, 80) + [[end_row()]]
    counted, aside = {}, str(tmp_path / "late")
    collector = SlicedCollector(
        str(tmp_path / "kept"), lambda counters, n: counted.update({n: counters.collect()}), interval=5, delay_seconds=1, late_rows=aside,
    )
    for n, batch in enumerate(batches):
        collector(spark.createDataFrame(batch, PROBE_SCHEMA), n)
        collector(spark.createDataFrame(batch, PROBE_SCHEMA), n)
    late = {(r["HOSTNAME"], r["TID"], r["t_ns"], r["seq"], r["phase"]) for r in spark.read.parquet(aside).collect()}
    assert late
    kept = [r for r in rows if (r[0], r[1], r[7], r[8], r[6]) not in late]
    want = count_calls(pair_calls(spark.createDataFrame(kept, PROBE_SCHEMA)), 5).collect()
    assert sorted(tuple(r) for part in counted.values() for r in part) == sorted(map(tuple, want))


def test_sliced_keeps_the_mounts_in_force(spark, tmp_path):
    """Of each device the mount of the newest period and those after it; the first one seen in a period stays."""
    seen = []

    def deliver(counters, n):
        found = attach_mounts(counters, collector.mounts, vacuum=10)
        seen.extend((n, r["SBDEV"], r["MOUNT"]) for r in found.collect())

    collector = SlicedCollector(str(tmp_path / "kept"), deliver, interval=5, delay_seconds=1, vacuum=10)
    mount = lambda dev, name, t, source=0: ("h", f"0:{dev}", f"/{name}", f"s:/{name}", source, seconds(t), 1)
    call = lambda dev, t: [(*hit[:11], dev, 0, 0) for hit in (call_hit(dev, "E", t), call_hit(dev, "R", t + 1))]

    def batch(hits, mounts):
        return together(
            spark.createDataFrame(hits, PROBE_SCHEMA), None,
            spark.createDataFrame(mounts, "HOSTNAME string, devt string, MOUNT string, device string, source int, seen_at timestamp, line_no long"),
        )

    collector(batch(call(1, 1) + call(2, 1) + call(99, 12), [mount(1, "b", 2, 1), mount(1, "a", 2), mount(1, "c", 3), mount(2, "x", 1)]), 0)
    collector(batch(call(1, 21) + call(2, 21) + call(99, 40), [mount(1, "d", 25), mount(1, "late", 4)]), 1)
    assert sorted(s for s in seen if s[1] != 99) == [(0, 1, "/a"), (0, 2, "/x"), (1, 1, "/d"), (1, 2, "/x")]
    kept = spark.read.parquet(f"{tmp_path}/kept/1/mounts")
    assert sorted((r["devt"], r["MOUNT"]) for r in kept.collect()) == [("0:1", "/d"), ("0:2", "/x")]


def test_kept_tables_of_another_batch_are_not_read(spark, tmp_path):
    collector = SlicedCollector(str(tmp_path / "kept"), lambda counters, n: None, interval=5, delay_seconds=1)
    collector(spark.createDataFrame([call_hit(1, "E", 1)], PROBE_SCHEMA), 0)
    with pytest.raises(RuntimeError, match="micro-batch"):
        collector(spark.createDataFrame([call_hit(1, "R", 2)], PROBE_SCHEMA), 2)
