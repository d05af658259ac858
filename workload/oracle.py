"""The same queries in SQL over the same tables, for comparison.

The views below restate ``workload.views``; each query then uses plain SQL (windows, as-of
joins, conditional sums) rather than the operators under test.
"""

from __future__ import annotations

from callscope.model import (
    BYTE_OPERATIONS,
    DURATION_COLUMNS,
    METRIC_HELP,
    METRIC_PREFIX,
    OP_NUMBER,
    OPERATIONS,
    STAT_COLUMNS,
)

DAY = 86400
HOUR = 3600

EVENTS = """ev AS (
  SELECT event_id, ts, event_type, value, user_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         'host' || (user_id % 4) AS HOSTNAME,
         CAST(1000 + user_id % 50 AS BIGINT) AS PID,
         CAST((1000 + user_id % 50) * 10 + event_id % 2 AS BIGINT) AS TID,
         CAST(1000 + user_id % 5 AS BIGINT) AS UID,
         event_type AS COMM
  FROM events)"""

TAG_TEXT = """concat_ws(';',
         CASE WHEN k % 2 = 0 THEN 'JOBID=' || (user_id % 7) END,
         CASE WHEN k % 3 = 0 THEN 'SCHEDID=' || (k % 4) END)"""

CALLS = f"""calls AS (
  SELECT HOSTNAME, TID, PID, UID, COMM, CAST(k % 30 AS BIGINT) AS SBDEV,
         CAST(event_id % {len(OPERATIONS)} AS INTEGER) AS OP_NO, ts AS TS, event_id AS SEQ,
         CAST(round(value * 1000000) AS BIGINT) AS DURATION_NS,
         CAST(CASE WHEN event_type = 'error' THEN -5 ELSE 0 END AS BIGINT) AS RC,
         CAST(k * 4096 AS BIGINT) AS REQ_BYTES
  FROM ev)"""

EXECS = f"""execs AS (
  SELECT HOSTNAME, PID, ts, event_id AS seq, {TAG_TEXT} AS tags
  FROM ev WHERE event_type = 'signup' AND (k % 2 = 0 OR k % 3 = 0))"""

MOUNTS = """mounts AS (
  SELECT h.HOSTNAME, CAST(n_nationkey AS BIGINT) AS dev, '/mnt/' || lower(n_name) AS MOUNT,
         '/export/' || lower(n_name) AS REMOTE_PATH
  FROM nation CROSS JOIN (VALUES ('host0'), ('host1'), ('host2'), ('host3')) h(HOSTNAME))"""

_FAILED = (
    f"CASE WHEN OP_NO IN ({', '.join(str(OP_NUMBER[o]) for o in BYTE_OPERATIONS)}) "
    "THEN RC < 0 ELSE RC <> 0 END"
)


def _stat_sums() -> str:
    parts = []
    for op, n in OP_NUMBER.items():
        total = lambda v, c: f"CAST(sum(CASE WHEN OP_NO = {n} THEN {v} ELSE 0 END) AS BIGINT) AS {op}_{c}"  # noqa: E731,B023
        parts += [total("1", "COUNT"), total(f"CASE WHEN {_FAILED} THEN 1 ELSE 0 END", "ERRORS")]
        parts.append(total("DURATION_NS", "DURATION"))
        if op in BYTE_OPERATIONS:
            parts.append(total("REQ_BYTES", "BYTES"))
    return ",\n    ".join(parts)


def _window_end(width: int, ts: str = "TS") -> str:
    return f"make_timestamp((epoch_us({ts}) // {width * 1000000} + 1) * {width * 1000000})"


def counters(width: int = DAY, source: str = "calls") -> str:
    return f"""counters AS (
  SELECT {_window_end(width)} AS TIMESTAMP, HOSTNAME, TID, PID, UID, COMM, SBDEV, max(SEQ) AS SEQ,
    {_stat_sums()}
  FROM {source} GROUP BY ALL)"""


LOCATED = """located AS (
  SELECT c.*, coalesce(m.MOUNT, '') AS MOUNT, coalesce(m.REMOTE_PATH, '') AS REMOTE_PATH
  FROM counters c LEFT JOIN mounts m ON c.HOSTNAME = m.HOSTNAME AND c.SBDEV = m.dev)"""

TAGGED = """tagged AS (
  SELECT l.*, coalesce(x.tags, '') AS TAGS
  FROM located l ASOF LEFT JOIN execs x
    ON l.HOSTNAME = x.HOSTNAME AND l.PID = x.PID AND l.TIMESTAMP >= x.ts)"""


def seconds(columns=STAT_COLUMNS) -> str:
    return ", ".join(f"{c} / 1e9 AS {c}" if c in DURATION_COLUMNS else c for c in columns)


def _grouped(keys: str, last: list[str], order: str = "SEQ", source: str = "tagged") -> str:
    sums = ",\n    ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in STAT_COLUMNS)
    lasts = "".join(f", arg_max({c}, {order}) AS {c}" for c in last)
    return f"grouped AS (SELECT {keys}{lasts},\n    {sums}\n  FROM {source} GROUP BY {keys})"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def chain(width: int = DAY) -> list[str]:
    return [EVENTS, CALLS, counters(width), MOUNTS, LOCATED, EXECS, TAGGED]


SQUASH = _grouped("TIMESTAMP, HOSTNAME, MOUNT, COMM, TAGS", ["PID", "UID", "REMOTE_PATH"])
PER_PID = _grouped("TIMESTAMP, HOSTNAME, MOUNT, PID, TAGS", ["COMM", "UID", "REMOTE_PATH"])


def _samples(width: int, squash: bool) -> str:
    return with_(*chain(width), SQUASH if squash else PER_PID) + (
        f"SELECT CAST({width} AS BIGINT) AS TIMEDELTA, TIMESTAMP, HOSTNAME, PID, UID, COMM, "
        f"{seconds()}, TAGS, MOUNT, REMOTE_PATH FROM grouped"
    )


def _sample_view(width: int, squash: bool) -> str:
    return f"samples AS ({_samples(width, squash)})"


# --- fixed values: numbers of the operations whose entries are filtered by file, the type bits
# of a mode word, and the types that are kept (directory, regular file, symbolic link) ---
FILTERED = "0, 1, 2, 3, 6, 7, 8, 9, 10"
TYPE_BITS, KEPT_TYPES = 61440, "16384, 32768, 40960"
# --- end of fixed values ------------------------------------------------------------------

PROBE_EVENTS = f"""pe AS (
  SELECT HOSTNAME, TID, PID, UID, COMM, CAST(event_id % {len(OPERATIONS)} AS INTEGER) AS OP_NO, k, event_id AS seq,
         k % 11 AS name_len,
         CASE WHEN k % 13 = 0 THEN {0o140644} WHEN k % 5 = 0 THEN {0o040755}
              WHEN k % 7 = 0 THEN {0o120777} ELSE {0o100644} END AS mode,
         CAST(k % 30 AS BIGINT) AS sbdev, CAST(k * 4096 AS BIGINT) AS bytes,
         CAST(CASE WHEN event_type = 'error' THEN -5 ELSE 0 END AS BIGINT) AS rc,
         epoch_us(ts) AS t0, epoch_us(ts) + CAST(round(value * 1e8) AS BIGINT) AS t1
  FROM ev),
hits AS (
  SELECT *, 'E' AS phase, t0 AS t FROM pe
  WHERE OP_NO NOT IN ({FILTERED}) OR (name_len > 0 AND (mode & {TYPE_BITS}) IN ({KEPT_TYPES}))
  UNION ALL SELECT *, 'R' AS phase, t1 AS t FROM pe),
looked AS (
  SELECT *, lag(phase) OVER w AS p_phase, lag(t) OVER w AS p_t, lag(sbdev) OVER w AS p_dev,
         lag(bytes) OVER w AS p_bytes
  FROM hits WINDOW w AS (PARTITION BY HOSTNAME, TID ORDER BY t, seq, phase)),
paired AS (
  SELECT HOSTNAME, TID, PID, UID, COMM, p_dev AS SBDEV, OP_NO, make_timestamp(t) AS TS, seq AS SEQ,
         (t - p_t) * 1000 AS DURATION_NS, rc AS RC, p_bytes AS REQ_BYTES
  FROM looked WHERE phase = 'R' AND p_phase = 'E')"""

_HELP = "(VALUES " + ", ".join(f"('{m}', '{METRIC_PREFIX}{t}')" for m, t in METRIC_HELP.items()) + ") h(metric, help)"


def _metrics(source: str, ids: str) -> str:
    wide = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in STAT_COLUMNS)
    return (
        f"SELECT {ids}, '{METRIC_PREFIX}' || u.metric AS name, h.help, u.value FROM "
        f"(UNPIVOT (SELECT {ids}, {wide} FROM {source}) ON {', '.join(STAT_COLUMNS)} INTO NAME metric VALUE value) u "
        f"JOIN {_HELP} ON u.metric = h.metric"
    )


_CANDIDATES = """cand AS (
  SELECT 'host' || (o_custkey % 4) AS HOSTNAME, '0:' || (o_custkey % 40) AS devt,
         '/mnt/' || lower(o_orderpriority) AS MOUNT, '10.0.0.' || (o_custkey % 7) || ':/export/o' || o_orderkey AS device,
         CAST(o_orderkey % 3 AS INTEGER) AS source, o_orderdate AS seen_at, o_orderkey AS line_no
  FROM orders)"""

_MOUNT_LINES = """lines AS (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE '' END || c_custkey || ' 25  0:' || (c_custkey % 977)
    || ' / /mnt/' || lower(c_mktsegment) || c_custkey || '\trw,relatime '
    || CASE WHEN c_custkey % 2 = 0 THEN 'shared:' || c_nationkey || ' master:1 ' ELSE '' END || '- '
    || CASE WHEN c_custkey % 5 = 0 THEN 'ext4' WHEN c_custkey % 7 = 0 THEN 'nfs' ELSE 'nfs4' END
    || ' 10.1.0.' || c_nationkey || ':/vol - rw,vers=4' AS value
  FROM customer)"""

_ENVIRON = """env AS (
  SELECT event_id, CASE WHEN k = 0 THEN NULL ELSE
    'JOBID=' || (user_id % 7) || chr(0) || 'PATH=/bin' || chr(0) || 'JOB=a=b' || chr(0)
    || CASE WHEN k % 5 = 0 THEN 'JOBX' || chr(0) ELSE '' END
    || CASE WHEN k % 4 = 0 THEN 'JOBID=again' || chr(0) ELSE '' END
    || CASE WHEN k % 3 = 0 THEN 'SCHEDID=' || chr(0) ELSE '' END || 'JOBTAIL' END AS environ
  FROM ev)"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["call_counters"] = with_(EVENTS, CALLS, counters()) + "SELECT * FROM counters"
    q["counter_flatten"] = q["call_counters"]
    q["call_errors"] = with_(EVENTS, CALLS) + (
        f"SELECT HOSTNAME, OP_NO, count(*) AS n, CAST(sum(CASE WHEN {_FAILED} THEN 1 ELSE 0 END) AS BIGINT) AS errors "
        "FROM calls GROUP BY ALL"
    )
    item = f"""calls AS (
      SELECT 'host' || (l_suppkey % 4) AS HOSTNAME, l_partkey % 100 AS TID, l_partkey % 50 AS PID, l_suppkey % 5 AS UID,
        l_returnflag || l_linestatus AS COMM, l_suppkey % 30 AS SBDEV,
        CAST((l_orderkey + l_linenumber) % {len(OPERATIONS)} AS INTEGER) AS OP_NO, l_shipdate AS TS, l_orderkey AS SEQ,
        CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 AS DURATION_NS,
        CAST(CASE WHEN l_discount > 0.09 THEN -5 ELSE 0 END AS BIGINT) AS RC,
        CAST(round(l_quantity) AS BIGINT) * 4096 AS REQ_BYTES
      FROM lineitem)"""
    q["item_counters"] = with_(
        item, counters(30 * DAY), _grouped("TIMESTAMP, HOSTNAME, COMM", [], source="counters")
    ) + f"SELECT TIMESTAMP, HOSTNAME, COMM, {seconds()} FROM grouped"
    q["samples_squash"] = _samples(DAY, True)
    q["samples_per_pid"] = _samples(DAY, False)
    q["probe_samples"] = with_(
        EVENTS, PROBE_EVENTS, counters(DAY, "paired"), MOUNTS, LOCATED, EXECS, TAGGED, SQUASH
    ) + (
        f"SELECT CAST({DAY} AS BIGINT) AS TIMEDELTA, TIMESTAMP, HOSTNAME, PID, UID, COMM, "
        f"{seconds()}, TAGS, MOUNT, REMOTE_PATH FROM grouped"
    )
    base = [EVENTS, CALLS, counters(), MOUNTS, LOCATED]
    total = "row(TIMESTAMP, SEQ)"
    q["group_by_mount"] = with_(
        *base, _grouped("MOUNT", ["TIMESTAMP", "HOSTNAME", "PID", "UID", "COMM", "REMOTE_PATH"], total, "located")
    ) + f"SELECT MOUNT, TIMESTAMP, HOSTNAME, PID, UID, COMM, REMOTE_PATH, {seconds()} FROM grouped"
    q["group_by_comm_pid"] = with_(
        *base, _grouped("COMM, PID", ["TIMESTAMP", "HOSTNAME", "UID", "MOUNT", "REMOTE_PATH"], total, "located")
    ) + f"SELECT COMM, PID, TIMESTAMP, HOSTNAME, UID, MOUNT, REMOTE_PATH, {seconds()} FROM grouped"
    q["group_last_nulls"] = with_(EVENTS) + """
      SELECT h AS HOSTNAME, arg_max(MOUNT, event_id) FILTER (WHERE MOUNT IS NOT NULL) AS MOUNT,
             arg_max(PID, event_id) AS PID, max(event_id) AS SEQ, CAST(sum(k) AS BIGINT) AS READ_BYTES
      FROM (SELECT CASE WHEN k % 10 = 0 THEN NULL ELSE HOSTNAME || (k % 100) END AS h,
                   CASE WHEN k % 3 = 0 OR event_id % 2 = 0 THEN NULL ELSE '/mnt/' || event_id END AS MOUNT, PID, event_id, k
            FROM ev) WHERE h IS NOT NULL GROUP BY h"""
    tagged_calls = f"SELECT event_id AS SEQ, HOSTNAME, PID, {TAG_TEXT} AS TAGS FROM ev"
    q["tag_filter_any"] = with_(EVENTS) + f"{tagged_calls} WHERE k % 2 = 0 OR k % 3 = 0"
    q["tag_filter_all"] = with_(EVENTS) + f"{tagged_calls} WHERE k % 2 = 0 AND k % 3 = 0"
    q["anonymize"] = with_(_sample_view(DAY, True)) + (
        "SELECT TIMESTAMP, HOSTNAME, CAST(0 AS BIGINT) AS PID, UID, '--' AS COMM, '--' AS MOUNT, '--' AS REMOTE_PATH, "
        f"regexp_replace(TAGS, '=[^;]*', '=--', 'g') AS TAGS, TIMEDELTA, {', '.join(STAT_COLUMNS)} FROM samples"
    )
    q["mount_lookup"] = with_(EVENTS, CALLS, MOUNTS) + (
        "SELECT c.SEQ, c.HOSTNAME, '0:' || c.SBDEV AS devt, coalesce(m.MOUNT, '') AS MOUNT, "
        "coalesce(m.REMOTE_PATH, '') AS REMOTE_PATH "
        "FROM calls c LEFT JOIN mounts m ON c.HOSTNAME = m.HOSTNAME AND c.SBDEV = m.dev"
    )
    pick = "HOSTNAME, devt, MOUNT, device, regexp_extract(device, '.*:(/.*)$', 1) AS REMOTE_PATH"
    q["mount_precedence"] = with_(_CANDIDATES) + (
        f"SELECT {pick}, CAST(epoch AS BIGINT) AS epoch FROM (SELECT *, row_number() OVER (PARTITION BY HOSTNAME, devt, epoch "
        f"ORDER BY seen_at, source, line_no DESC) AS rn FROM (SELECT *, epoch_us(seen_at) // {30 * DAY * 1000000} AS epoch FROM cand)) "
        "WHERE rn = 1"
    )
    q["mount_asof"] = with_(EVENTS, CALLS, f"""seen AS (
      SELECT *, row_number() OVER (PARTITION BY HOSTNAME, dev, epoch ORDER BY ts, event_id % 3, event_id DESC) AS rn
      FROM (SELECT HOSTNAME, CAST(k % 30 AS BIGINT) AS dev, ts, event_id, epoch_us(ts) // {DAY // 4 * 1000000} AS epoch
            FROM ev WHERE event_type = 'signup'))""") + f"""
      SELECT SEQ, c.HOSTNAME, SBDEV, coalesce('/mnt/' || m.event_id, '') AS MOUNT,
             coalesce('/export/' || m.event_id, '') AS REMOTE_PATH
      FROM (SELECT *, epoch_us(TS) // {DAY // 4 * 1000000} AS epoch FROM calls) c
      ASOF LEFT JOIN (SELECT * FROM seen WHERE rn = 1) m
        ON c.HOSTNAME = m.HOSTNAME AND c.SBDEV = m.dev AND c.epoch >= m.epoch"""
    q["mount_upsert"] = with_(_CANDIDATES) + (
        f"SELECT {pick} FROM (SELECT *, row_number() OVER (PARTITION BY HOSTNAME, devt "
        "ORDER BY seen_at DESC, line_no DESC) AS rn FROM cand) WHERE rn = 1"
    )
    q["remote_path"] = """
      SELECT c_custkey, device, regexp_extract(device, '.*:(/.*)$', 1) AS REMOTE_PATH FROM (
        SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '10.0.0.' || c_nationkey || ':/' || c_mktsegment
          WHEN 1 THEN '[2001::' || c_nationkey || ']:/vol/' || c_custkey WHEN 2 THEN 'filer.local:8080:/'
          WHEN 3 THEN ':::/mnt' WHEN 4 THEN '/dev/sd' || c_custkey ELSE 'srv:/a:/b/' || c_custkey END AS device
        FROM customer)"""
    q["devt_format"] = (
        "SELECT o_orderkey, st_dev, (st_dev // 1048576) || ':' || (st_dev % 1048576) AS devt "
        "FROM (SELECT o_orderkey, (o_orderkey * 2654435) % 4294967296 AS st_dev FROM orders)"
    )
    q["mountinfo_parse"] = with_(_MOUNT_LINES) + """
      SELECT c_custkey, p[3] AS devt, p[5] AS MOUNT, p[list_position(p, '-') + 1] AS fstype,
             p[list_position(p, '-') + 2] AS device
      FROM (SELECT c_custkey, regexp_split_to_array(trim(value), '\\s+') AS p FROM lines)
      WHERE contains(p[list_position(p, '-') + 1], 'nfs')"""
    q["env_parse"] = with_(EVENTS, _ENVIRON) + """
      SELECT event_id, CASE
          WHEN environ IS NULL OR len(list_filter(kept, lambda e: NOT contains(e, '='))) > 0 THEN ''
          ELSE array_to_string(list_sort(list_transform(list_distinct(list_transform(kept, lambda e: string_split(e, '=')[1])),
             lambda n: n || '=' || string_split(list_filter(kept, lambda e: string_split(e, '=')[1] = n)[-1], '=')[2])), ';')
        END AS TAGS
      FROM (SELECT event_id, environ, list_filter(string_split(environ, chr(0))[:-2],
              lambda e: starts_with(e, 'JOB') OR starts_with(e, 'SCHEDID')) AS kept FROM env)"""
    q["pair_calls"] = with_(EVENTS, PROBE_EVENTS) + "SELECT * FROM paired"
    q["pair_calls_fine"] = q["pair_calls"]
    q["tags_asof"] = with_(EVENTS, EXECS) + """
      SELECT s.event_id AS SEQ, s.HOSTNAME, s.PID, coalesce(x.tags, CASE WHEN s.PID % 2 = 0 THEN 'LATE=' || s.PID ELSE '' END) AS TAGS
      FROM (SELECT * FROM ev WHERE event_type <> 'signup') s ASOF LEFT JOIN execs x
        ON s.HOSTNAME = x.HOSTNAME AND s.PID = x.PID AND s.ts >= x.ts"""
    q["tags_alive"] = with_(EVENTS, EXECS) + """
      SELECT HOSTNAME, PID, seq, tags AS TAGS FROM execs x WHERE EXISTS (
        SELECT 1 FROM ev WHERE ev.HOSTNAME = x.HOSTNAME AND ev.PID = x.PID AND ev.event_type = 'click' AND ev.k >= 95)"""
    q["tag_key_drift"] = with_(EVENTS) + f"""
      , smp AS (SELECT {_window_end(600, 'ts')} AS TIMESTAMP, k FROM ev),
      present AS (SELECT DISTINCT TIMESTAMP, 'JOBID' AS tag FROM smp WHERE k % 2 = 0
                  UNION SELECT DISTINCT TIMESTAMP, 'SCHEDID' FROM smp WHERE k % 3 = 0),
      before AS (SELECT TIMESTAMP + INTERVAL 600 SECOND AS TIMESTAMP, tag FROM present)
      SELECT TIMESTAMP, tag, 'added' AS change FROM (SELECT * FROM present EXCEPT SELECT * FROM before)
      UNION ALL SELECT TIMESTAMP, tag, 'removed' FROM (SELECT * FROM before EXCEPT SELECT * FROM present)
      WHERE TIMESTAMP IN (SELECT TIMESTAMP FROM smp)"""
    labels = "TIMESTAMP, HOSTNAME, UID, COMM, MOUNT, REMOTE_PATH, JOBID"
    job = "regexp_extract(TAGS, 'JOBID=([^;]*)', 1) AS JOBID"
    as_labels = f"SELECT TIMESTAMP, HOSTNAME, CAST(UID AS VARCHAR) AS UID, COMM, MOUNT, REMOTE_PATH, {job}"
    by_comm = _grouped("TIMESTAMP, HOSTNAME, COMM", ["PID", "UID", "MOUNT", "REMOTE_PATH", "TAGS"])
    q["metrics_long"] = with_(
        *chain(), by_comm, f"labelled AS ({as_labels}, {seconds()} FROM grouped)"
    ) + _metrics("labelled", labels)
    sums = ", ".join(
        f"CAST(sum(CAST(round({c} * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 AS {c}" if c in DURATION_COLUMNS else f"sum({c}) AS {c}"
        for c in STAT_COLUMNS
    )
    q["metrics_merged"] = with_(
        _sample_view(30 * DAY, False),
        f"labelled AS ({as_labels}, {', '.join(STAT_COLUMNS)} FROM samples)",
        f"merged AS (SELECT {labels}, {sums} FROM labelled GROUP BY {labels})",
    ) + _metrics("merged", labels)
    q["metrics_drained"] = q["metrics_long"] + (
        " WHERE TIMESTAMP > TIMESTAMP '2024-01-08' AND TIMESTAMP <= TIMESTAMP '2024-01-20'"
    )
    hourly = with_(EVENTS, CALLS, counters(HOUR))
    q["ring_latest"] = hourly + """
      SELECT * FROM counters JOIN (
        SELECT HOSTNAME, TIMESTAMP FROM (
          SELECT *, row_number() OVER (PARTITION BY HOSTNAME ORDER BY TIMESTAMP DESC) AS rn
          FROM (SELECT DISTINCT HOSTNAME, TIMESTAMP FROM counters)) WHERE rn <= 100) USING (HOSTNAME, TIMESTAMP)"""
    q["buffer_usage"] = hourly + """
      SELECT HOSTNAME, CAST(least(n, 800) AS BIGINT) AS samples, least(n, 800) / 800 * 100.0 AS usage_pct,
             least(n, 800) / 800 * 100.0 > 80 AS over_limit
      FROM (SELECT HOSTNAME, count(DISTINCT TIMESTAMP) AS n FROM counters GROUP BY HOSTNAME)"""
    q["retention"] = with_(EVENTS) + f"""
      , files AS (SELECT HOSTNAME, HOSTNAME || '/' || strftime(ts, '%Y-%m-%d') AS path, max(ts) AS modified,
                  CAST(sum(k * 4096) AS BIGINT) AS bytes FROM ev GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER w AS slot, CAST(sum(bytes) OVER w AS BIGINT) AS total_bytes FROM files
                 WINDOW w AS (PARTITION BY HOSTNAME ORDER BY modified DESC, path DESC))
      SELECT HOSTNAME, path, modified, bytes, slot, total_bytes FROM ranked
      WHERE slot <= 6 AND total_bytes <= 6 * 14 * 1048576"""
    q["kafka_records"] = with_(_sample_view(DAY, True)) + f"""
      SELECT HOSTNAME || ':' || COMM || ':' || UID || ':' || PID AS key,
        'HOSTNAME|UID|COMM|MOUNT|REMOTE_PATH|JOBID|SCHEDID' AS header_names,
        concat_ws('|', HOSTNAME, UID, COMM, MOUNT, REMOTE_PATH, regexp_extract(TAGS, 'JOBID=([^;]*)', 1),
                  regexp_extract(TAGS, 'SCHEDID=([^;]*)', 1)) AS header_values,
        epoch_us(TIMESTAMP) // 1000000 AS TIMESTAMP, TIMEDELTA, HOSTNAME, PID, UID, COMM, {', '.join(STAT_COLUMNS)},
        TAGS, MOUNT, REMOTE_PATH FROM samples"""
    body = ", ".join(c for c in ["HOSTNAME", "PID", "UID", "COMM", *STAT_COLUMNS, "TAGS", "MOUNT", "REMOTE_PATH"])
    q["json_iso"] = with_(_sample_view(DAY, True)) + (
        f"SELECT strftime(TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP, TIMEDELTA, {body} FROM samples"
    )
    q["json_unix"] = with_(_sample_view(DAY, True)) + (
        f"SELECT epoch_us(TIMESTAMP) // 1000000 AS TIMESTAMP, TIMEDELTA, {body} FROM samples"
    )
    q["conform_env_columns"] = with_(_sample_view(DAY, False)) + """
      SELECT TIMESTAMP, CAST(PID AS INTEGER) AS PID, CAST(OPEN_COUNT AS INTEGER) AS OPEN_COUNT, READ_DURATION,
             regexp_extract(TAGS, 'JOBID=([^;]*)', 1) AS ENV_JOBID, '' AS ENV_NOPE FROM samples"""
    kept = ["TIMEDELTA", "MOUNT", "COMM", "PID", "UID", "REMOTE_PATH", "TAGS"] + list(STAT_COLUMNS)
    texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in kept)
    turned = (
        "SELECT TIMESTAMP, HOSTNAME, sample_no, field, CASE WHEN NOT ends_with(field, '_DURATION') THEN value END AS value, "
        "CASE WHEN ends_with(field, '_DURATION') THEN CAST(value AS DOUBLE) END AS seconds FROM "
        f"(UNPIVOT (SELECT TIMESTAMP, HOSTNAME, CAST(row_number() OVER (PARTITION BY TIMESTAMP, HOSTNAME "
        f"ORDER BY MOUNT, COMM, TAGS) - 1 AS INTEGER) AS sample_no, {texts} FROM samples) ON {', '.join(kept)} "
        "INTO NAME field VALUE value)"
    )
    q["sample_transpose"] = with_(_sample_view(7 * DAY, True)) + turned
    by_process = with_(_sample_view(7 * DAY, False)) + turned.replace("ORDER BY MOUNT, COMM, TAGS", "ORDER BY MOUNT, PID, TAGS")
    q["sink_console"] = f"""
      SELECT strftime(TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP, HOSTNAME, sample_no, field,
             CASE WHEN seconds IS NULL THEN coalesce(value, '') END AS value, seconds FROM ({by_process})"""
    q["source_probe"] = q["pair_calls"]
    q["source_counters"] = q["counter_flatten"]
    parsed = q["env_parse"].partition("SELECT event_id, CASE")
    q["source_execs"] = f"""
      SELECT HOSTNAME, 1000 + user_id % 50 AS PID, e.event_id AS seq, TAGS
      FROM (SELECT *, 'host' || (user_id % 4) AS HOSTNAME FROM events) e
      JOIN ({parsed[0]}{parsed[1]}{parsed[2]}) p ON e.event_id = p.event_id WHERE TAGS <> ''"""
    q["source_parts"] = """
      SELECT 'host' || (c_custkey % 4) AS HOSTNAME, make_timestamp((1704067200 + c_custkey) * 1000000) AS seen_at, 2 AS source,
             0 AS line_no, (st_dev // 1048576) || ':' || (st_dev % 1048576) AS devt, '/mnt/' || lower(c_mktsegment) || c_custkey AS MOUNT,
             '10.2.0.' || c_nationkey || ':/vol' AS device
      FROM (SELECT *, (c_custkey * 2654435) % 4294967296 AS st_dev FROM customer) WHERE c_custkey % 5 <> 0"""
    q["source_mountinfo"] = f"""
      SELECT 'host' || (c_custkey % 3) AS HOSTNAME, devt, MOUNT, device, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS source
      FROM ({q["mountinfo_parse"]})"""
    tag = lambda n: f"regexp_extract(TAGS, '{n}=([^;]*)', 1) AS ENV_{n}"
    narrow = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ["TIMEDELTA", "PID", "UID", *[c for c in STAT_COLUMNS if c.endswith("_ERRORS")]])
    wide = ", ".join(c for c in STAT_COLUMNS if not c.endswith("_ERRORS"))
    q["sink_table"] = with_(_sample_view(DAY, True)) + (
        f"SELECT TIMESTAMP, HOSTNAME, COMM, {narrow}, {wide}, MOUNT, TAGS, REMOTE_PATH, {tag('JOBID')}, {tag('SCHEDID')}, "
        "strftime(TIMESTAMP, '%Y-%m-%d') AS date FROM samples"
    )
    q["sink_metrics"] = q["metrics_long"]
    q["sink_fanout"] = with_(_sample_view(DAY, True)) + (
        "SELECT HOSTNAME, TIMESTAMP, count(*) AS samples, CAST(sum(READ_COUNT) AS BIGINT) AS stored_reads, "
        "CAST(sum(READ_COUNT) AS BIGINT) AS reads FROM samples GROUP BY ALL"
    )
    # Spark holds late rows against the watermark of the micro-batch before.
    late = f"""arriving AS (
      SELECT *, {_part("SEQ", "epoch_us(TS)", VERY_LATE, 8)} AS part FROM calls),
    marks AS (SELECT part, max(epoch_us(TS)) // 1000 - 3600000 AS mark FROM arriving GROUP BY part),
    seen AS (SELECT * FROM arriving a WHERE (epoch_us(TS) // {DAY * 1000000} + 1) * {DAY * 1000}
      > coalesce((SELECT max(mark) FROM marks m WHERE m.part < a.part - 1), 0))"""
    q["stream_late"] = with_(EVENTS, CALLS, late, counters(source="seen")) + "SELECT * FROM counters"
    q["stream_tumble"] = q["call_counters"]
    q["stream_pairs"] = q["pair_calls"]
    q["stream_tags"] = with_(EVENTS, EXECS) + """
      SELECT s.event_id AS SEQ, s.HOSTNAME, s.PID, coalesce(x.tags, '') AS TAGS
      FROM (SELECT * FROM ev WHERE event_type <> 'signup') s ASOF LEFT JOIN execs x
        ON s.HOSTNAME = x.HOSTNAME AND s.PID = x.PID AND s.ts >= x.ts"""
    q["stream_pairs_sliced"], q["stream_tags_sliced"] = q["pair_calls"], q["stream_tags"]
    q["stream_samples"] = q["probe_samples"]
    q["stream_samples_sliced"] = q["probe_samples"]
    _add_kept_state(q)
    _add_sinks(q, narrow, wide, tag)
    _add_options(q)
    return q


LATE, VERY_LATE = 6 * HOUR, 6 * DAY
TTL = 6 * HOUR


def _part(seq: str, micros: str, late: int = LATE, parts: int = 4) -> str:
    """The part in which an event arrives."""
    return f"CAST(greatest(0, least({parts - 1}, floor(({micros} // 1000000 + {seq} % 3 * {late} - 1704067200) * {parts} / (30 * 86400)))) AS BIGINT)"


def _arrived(late: int = LATE, delay: int = DAY, width: int = DAY) -> str:
    """Hits with their part, and for each part the time up to which intervals are over after it."""
    return f"""arrived AS (SELECT *, {_part("seq", "t0", late)} AS part FROM hits),
overs AS (
  SELECT part, ((max(max(t)) OVER (ORDER BY part) - {delay * 1000000}) // {width * 1000000}) * {width * 1000000} AS until
  FROM arrived GROUP BY part)"""


_EXEC_PARTS = f"exec_parts AS (SELECT HOSTNAME, PID, ts, event_id AS seq, {_part('event_id', 'epoch_us(ts)')} AS part, {TAG_TEXT} AS tags FROM ev WHERE event_type = 'signup' AND (k % 2 = 0 OR k % 3 = 0))"


def _sample_rows(width: int = DAY) -> str:
    return (
        f"SELECT CAST({width} AS BIGINT) AS TIMEDELTA, TIMESTAMP, HOSTNAME, PID, UID, COMM, "
        f"{seconds()}, TAGS, MOUNT, REMOTE_PATH FROM grouped"
    )


def _add_kept_state(q: dict[str, str]) -> None:
    """Streams that keep rows from one micro-batch to the next."""
    in_time = f"in_time AS (SELECT * FROM paired WHERE DURATION_NS <= {TTL * 1000000000})"
    remembered = f"""tagged AS (
  SELECT l.*, CASE WHEN epoch_us(l.TIMESTAMP) - epoch_us(x.ts) <= {TTL * 1000000} THEN x.tags ELSE '' END AS TAGS
  FROM located l ASOF LEFT JOIN execs x ON l.HOSTNAME = x.HOSTNAME AND l.PID = x.PID AND l.TIMESTAMP >= x.ts)"""
    q["stream_ttl"] = with_(EVENTS, PROBE_EVENTS, in_time, counters(DAY, "in_time"), MOUNTS, LOCATED, EXECS, remembered, SQUASH) + _sample_rows()
    q["stream_ttl_state"] = with_(EVENTS, PROBE_EVENTS, _arrived(), _EXEC_PARTS) + f"""
      , ready AS (
        SELECT o.part AS batch, until, a.*, row_number() OVER (PARTITION BY o.part, HOSTNAME, TID ORDER BY t DESC, seq DESC, phase DESC) AS n
        FROM overs o JOIN arrived a ON a.part <= o.part AND t < until),
      known AS (
        SELECT o.part AS batch, until, epoch_us(ts) AS t, HOSTNAME, PID,
               row_number() OVER (PARTITION BY o.part, HOSTNAME, PID, epoch_us(ts) < until ORDER BY ts DESC, seq DESC) AS n
        FROM overs o JOIN exec_parts e ON e.part <= o.part)
      SELECT o.part AS batch, 'rows' AS name,
             (SELECT count(*) FROM arrived a WHERE a.part <= o.part AND t >= until)
             + (SELECT count(*) FROM ready r WHERE r.batch = o.part AND n = 1 AND phase = 'E' AND t >= o.until - {TTL * 1000000}) AS n
      FROM overs o
      UNION ALL SELECT o.part, 'execs', (SELECT count(*) FROM known k WHERE k.batch = o.part
        AND (t >= o.until OR (n = 1 AND t >= o.until - {TTL * 1000000}))) FROM overs o"""
    q["stream_late_rows"] = with_(EVENTS, PROBE_EVENTS, _arrived(VERY_LATE, HOUR)) + """
      SELECT HOSTNAME, TID, seq, phase, t * 1000 AS t_ns, a.part AS batch
      FROM arrived a JOIN overs o ON o.part = a.part - 1 WHERE t < until"""
    # a process is asked in the first micro-batch that counts it while no exec of it has come
    asked = """delivered AS (
      SELECT part, until, coalesce(lag(until) OVER (ORDER BY part), 0) AS since, row_number() OVER (ORDER BY part) AS n
      FROM (SELECT part, until FROM (SELECT *, lag(until) OVER (ORDER BY part) AS was FROM overs) WHERE until > coalesce(was, 0)
            UNION ALL SELECT 4, 9000000000000000)),
    counted AS (
      SELECT DISTINCT HOSTNAME, PID, d.part, d.n FROM counters c JOIN delivered d ON epoch_us(TIMESTAMP) > since AND epoch_us(TIMESTAMP) <= until),
    asked AS (
      SELECT HOSTNAME, PID, min(n) AS n FROM counted c WHERE NOT EXISTS (
        SELECT 1 FROM exec_parts e WHERE e.HOSTNAME = c.HOSTNAME AND e.PID = c.PID AND e.part <= c.part) GROUP BY HOSTNAME, PID),
    tagged AS (
      SELECT l.*, coalesce(x.tags, CASE WHEN l.PID % 2 = 0 THEN 'LATE=' || a.n END, '') AS TAGS
      FROM located l ASOF LEFT JOIN execs x ON l.HOSTNAME = x.HOSTNAME AND l.PID = x.PID AND l.TIMESTAMP >= x.ts
      LEFT JOIN asked a ON a.HOSTNAME = l.HOSTNAME AND a.PID = l.PID)"""
    q["stream_late_tags"] = with_(
        EVENTS, PROBE_EVENTS, _arrived(), _EXEC_PARTS, counters(DAY, "paired"), MOUNTS, LOCATED, EXECS, asked, SQUASH
    ) + _sample_rows()
    period = DAY // 4 * 1000000
    seen = f"""seen AS (
      SELECT *, row_number() OVER (PARTITION BY HOSTNAME, dev, epoch ORDER BY ts, event_id % 3, event_id DESC) AS rn
      FROM (SELECT HOSTNAME, CAST(k % 30 AS BIGINT) AS dev, ts, event_id, epoch_us(ts) // {period} AS epoch FROM ev WHERE event_type = 'signup')),
    located AS (
      SELECT c.* EXCLUDE (epoch), coalesce('/mnt/' || m.event_id, '') AS MOUNT, coalesce('/export/' || m.event_id, '') AS REMOTE_PATH
      FROM (SELECT *, (epoch_us(TIMESTAMP) - 1) // {period} AS epoch FROM counters) c
      ASOF LEFT JOIN (SELECT * FROM seen WHERE rn = 1) m ON c.HOSTNAME = m.HOSTNAME AND c.SBDEV = m.dev AND c.epoch >= m.epoch)"""
    q["stream_mounts"] = with_(EVENTS, PROBE_EVENTS, counters(DAY, "paired"), seen, EXECS, TAGGED, SQUASH) + _sample_rows()


def _add_sinks(q: dict[str, str], narrow: str, wide: str, tag) -> None:
    """Sinks that rotate, retry, store once, and learn."""
    stored = f"SELECT TIMESTAMP, HOSTNAME, COMM, {narrow}, {wide}, MOUNT, TAGS, REMOTE_PATH"
    day = "strftime(TIMESTAMP, '%Y-%m-%d') AS date"
    q["sink_retry"] = with_(_sample_view(DAY, True)) + f"{stored}, {tag('JOBID')}, {tag('SCHEDID')}, {day}, CAST(1 AS BIGINT) AS retries FROM samples"
    q["sink_once"] = with_(_sample_view(DAY, True)) + f"SELECT TIMESTAMP, HOSTNAME, COMM, READ_COUNT, {tag('JOBID')} FROM samples"
    q["sink_source"] = q["samples_squash"]
    # The names known in the first half are those of the first column; an exec without any of them does not count there.
    half = """cut AS (SELECT until FROM overs WHERE part = 1),
    job_execs AS (SELECT HOSTNAME, PID, ts, 'JOBID=' || (user_id % 7) AS tags FROM ev WHERE event_type = 'signup' AND k % 2 = 0),
    tagged AS (
      SELECT l.*, CASE WHEN epoch_us(l.TIMESTAMP) <= until THEN coalesce(j.tags, '') ELSE coalesce(x.tags, '') END AS TAGS
      FROM located l ASOF LEFT JOIN execs x ON l.HOSTNAME = x.HOSTNAME AND l.PID = x.PID AND l.TIMESTAMP >= x.ts
      ASOF LEFT JOIN job_execs j ON l.HOSTNAME = j.HOSTNAME AND l.PID = j.PID AND l.TIMESTAMP >= j.ts, cut)"""
    grouped = _grouped("TIMESTAMP, HOSTNAME, MOUNT, COMM, TAGS", ["PID", "UID", "REMOTE_PATH"])
    base = with_(
        EVENTS, PROBE_EVENTS, _arrived(), counters(DAY, "paired"), MOUNTS, LOCATED, EXECS,
        half, grouped,
        f"samples AS (SELECT CAST({DAY} AS BIGINT) AS TIMEDELTA, TIMESTAMP, HOSTNAME, PID, UID, COMM, {seconds()}, TAGS, MOUNT, "
        "REMOTE_PATH, epoch_us(TIMESTAMP) <= until AS early FROM grouped, cut)",
    )
    q["stream_learned"] = base + (
        f"{stored}, {tag('JOBID')}, CASE WHEN NOT early THEN {tag('SCHEDID').removesuffix(' AS ENV_SCHEDID')} END AS ENV_SCHEDID, {day} FROM samples"
    )
    ring = with_(EVENTS, CALLS, counters(HOUR), f"""batches AS (
      SELECT *, CAST((epoch_us(TIMESTAMP) // 1000000 - 1704067200 - {HOUR}) // {30 * DAY // 8} AS BIGINT) AS batch FROM counters),
    held AS (
      SELECT b.batch, HOSTNAME, TIMESTAMP, row_number() OVER (PARTITION BY b.batch, HOSTNAME ORDER BY TIMESTAMP DESC) AS n
      FROM range(8) b(batch) JOIN (SELECT DISTINCT HOSTNAME, TIMESTAMP, batch AS came FROM batches) ON came <= b.batch)""")
    q["stream_ring"] = ring + "SELECT c.* FROM counters c SEMI JOIN (SELECT * FROM held WHERE batch = 7 AND n <= 150) h USING (HOSTNAME, TIMESTAMP)"
    q["stream_ring_usage"] = ring + """
      SELECT batch, HOSTNAME, least(count(*), 150) AS samples, least(count(*), 150) / 150 * 100.0 AS usage_pct,
             least(count(*), 150) / 150 * 100.0 > 80 AS over_limit FROM held GROUP BY batch, HOSTNAME"""
    q["scrape_drain"] = q["metrics_long"].replace(
        "SELECT TIMESTAMP, HOSTNAME, UID, COMM, MOUNT, REMOTE_PATH, JOBID, ",
        f"SELECT CAST(least((epoch_us(TIMESTAMP) // 1000000 - 1704067200) // {5 * DAY}, 5) // 2 + 1 AS BIGINT) AS scrape, "
        "TIMESTAMP, HOSTNAME, UID, COMM, MOUNT, REMOTE_PATH, JOBID, ", 1,
    )
    q["sink_rotation"] = _rotation(6, 5 * DAY, int(0.2 * 1024 * 1024), 3, 50_000)


def _add_options(q: dict[str, str]) -> None:
    """What options allow, and sinks whose output is text."""
    q["anonymize_allowed"] = with_(_sample_view(DAY, True)) + (
        "SELECT TIMEDELTA, TIMESTAMP, HOSTNAME, CAST(0 AS BIGINT) AS PID, CAST(0 AS BIGINT) AS UID, '--' AS COMM, '--' AS MOUNT, "
        f"'--' AS REMOTE_PATH, regexp_replace(TAGS, '=[^;]*', '=--', 'g') AS TAGS, {', '.join(STAT_COLUMNS)}, "
        f"CAST({3 + len(STAT_COLUMNS)} AS BIGINT) AS refused FROM samples"
    )
    q["option_rules"] = with_(_sample_view(7 * DAY, True), """marked AS (
      SELECT READ_COUNT, contains(TAGS, 'JOBID=') AS job, contains(TAGS, 'SCHEDID=') AS sched FROM samples),
    rules AS (
      SELECT *, CASE WHEN tag_filter = 'none' THEN 'NotImplementedError' WHEN given AND learned THEN 'ValueError'
                     WHEN tag_filter <> '' AND NOT given THEN 'ValueError' ELSE '' END AS refused
      FROM (VALUES (''), ('any'), ('all'), ('none')) f(tag_filter), (VALUES (false), (true)) g(given), (VALUES (false), (true)) l(learned))""") + """
      SELECT tag_filter, given, learned, refused, count(READ_COUNT) AS samples, CAST(coalesce(sum(READ_COUNT), 0) AS BIGINT) AS reads
      FROM rules LEFT JOIN marked ON refused = '' AND (tag_filter = '' OR (tag_filter = 'any' AND (job OR sched)) OR (tag_filter = 'all' AND job AND sched))
      GROUP BY ALL"""
    q["learned_order"] = with_(_sample_view(DAY, True)) + """
      SELECT HOSTNAME || ':' || COMM || ':' || UID || ':' || PID AS key,
        'HOSTNAME|UID|COMM|MOUNT|REMOTE_PATH|ABSENT|JOBID|SCHEDID' AS header_names,
        concat_ws('|', HOSTNAME, UID, COMM, MOUNT, REMOTE_PATH, '', regexp_extract(TAGS, 'JOBID=([^;]*)', 1),
                  regexp_extract(TAGS, 'SCHEDID=([^;]*)', 1)) AS header_values FROM samples"""
    q["sink_messages"] = with_(_sample_view(DAY, True)) + """
      SELECT PID % 5 <> 0 AS sent, HOSTNAME || ':' || COMM || ':' || UID || ':' || PID AS key, CAST(7 AS INTEGER) AS headers,
             epoch_us(TIMESTAMP) // 1000000 AS TIMESTAMP, MOUNT, READ_COUNT,
             CAST(CASE WHEN PID % 5 = 0 THEN 4096 ELSE length(REMOTE_PATH) END AS INTEGER) AS path_length FROM samples"""
    closed = ", TAGS, MOUNT, REMOTE_PATH FROM grouped"
    q["stream_stop"] = q["probe_samples"].replace(closed, ", TAGS, MOUNT, REMOTE_PATH, CAST(1 AS BIGINT) AS closed FROM grouped")


def _rotation(batches: int, width: int, size: int, backups: int, lane_bytes: int) -> str:
    """Volumes of JSON lines, batch by batch: a running sum over lanes (by a hash of the line) and the lines in them."""
    names = ["HOSTNAME", "TID", "PID", "UID", "COMM", "SBDEV", "SEQ", *STAT_COLUMNS]
    packed = ", ".join(["'TIMESTAMP': strftime(TIMESTAMP, '%Y-%m-%dT%H:%M:%S')", *[f"'{c}': {c}" for c in names]])
    parts = [with_(EVENTS, CALLS, counters(DAY), f"""lines AS (
      SELECT (epoch_us(TIMESTAMP) // 1000000 - 1704067200) // {width} AS batch, CAST(to_json({{{packed}}}) AS VARCHAR) AS value FROM counters),
    totals AS (
      SELECT batch, sum(strlen(value) + 1) AS total, {size} - max(strlen(value) + 1) AS room FROM lines GROUP BY batch),
    laned AS (
      SELECT l.*, strlen(value) + 1 AS bytes, room, CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) % CAST(ceil(total / {lane_bytes}) AS BIGINT) AS lane
      FROM lines l JOIN totals USING (batch)),
    ended AS (SELECT *, sum(bytes) OVER (PARTITION BY batch ORDER BY lane, value ROWS UNBOUNDED PRECEDING) AS until FROM laned),
    state0 AS (SELECT 0 AS volume, 0 AS used)""").rstrip()]
    for k in range(batches):
        parts.append(f"""
    put{k} AS (SELECT e.*, s.volume + (until + used - 1) // room AS volume, s.volume AS open, used FROM ended e, state{k} s WHERE batch = {k}),
    state{k + 1} AS (
      SELECT volume, CAST(sum(bytes) + max(CASE WHEN volume = open THEN used ELSE 0 END) AS BIGINT) AS used FROM put{k}
      WHERE volume = (SELECT max(volume) FROM put{k}) GROUP BY volume)""")
    every = " UNION ALL ".join(f"SELECT volume, batch, bytes, value FROM put{k}" for k in range(batches))
    return ",".join(parts) + f""",
    every AS ({every}),
    oldest AS (SELECT least((SELECT min(volume) FROM put{batches - 1}), (SELECT max(volume) FROM every) - {backups}) AS volume)
    SELECT CAST(volume AS BIGINT) AS volume, CAST(batch AS BIGINT) AS batch, count(*) AS samples, CAST(sum(bytes) AS BIGINT) AS bytes, min(value) AS first_line
    FROM every WHERE volume >= (SELECT volume FROM oldest) GROUP BY volume, batch"""
