"""Given tables as inputs of the operators (the same views in SQL: ``workload.oracle``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.model import OPERATIONS
from callscope.session import apply_settings

DAY = 86400
TRACKED = ["JOBID", "SCHEDID"]
HOSTS = [f"host{i}" for i in range(4)]


# --- fixed values: the probes of each operation in the order of their numbers, written out
# here again so that a wrong entry of the library does not agree with itself -----------
PROBES_OF = [
    ("nfs_file_open", "nfs4_file_open"), ("nfs_file_release",), ("nfs_file_read", "nfs_file_splice_read"), ("nfs_file_write",),
    ("nfs_getattr",), ("nfs_setattr",), ("nfs_file_flush", "nfs4_file_flush"), ("nfs_file_fsync",), ("nfs_lock", "nfs_flock"),
    ("nfs_file_mmap",), ("nfs_readdir",), ("nfs_create",), ("nfs_link",), ("nfs_unlink",), ("nfs_symlink",), ("nfs_lookup",),
    ("nfs_rename",), ("nfs_do_access",), ("nfs_mkdir",), ("nfs_rmdir",), ("nfs4_listxattr", "nfs3_listxattr"),
]
# --- end of fixed values ------------------------------------------------------------------

# Columns of the given tables that the views use.
SCHEMAS = {
    "events": "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")



def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    return with_caller(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def with_caller(raw: DataFrame) -> DataFrame:
    """Host, process, thread, user and the number k of an event."""
    pid = F.lit(1000) + F.pmod("user_id", F.lit(50))
    return raw.select(
        "event_id", "ts", "event_type", "value", "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("host"), F.pmod("user_id", F.lit(4))).alias("HOSTNAME"),
        pid.alias("PID"),
        (pid * 10 + F.pmod("event_id", F.lit(2))).alias("TID"),
        (F.lit(1000) + F.pmod("user_id", F.lit(5))).alias("UID"),
        F.col("event_type").alias("COMM"),
    )


def calls_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "HOSTNAME", "TID", "PID", "UID", "COMM",
        F.pmod("k", F.lit(30)).cast("long").alias("SBDEV"),
        F.pmod("event_id", F.lit(len(OPERATIONS))).cast("int").alias("OP_NO"),
        F.col("ts").alias("TS"),
        F.col("event_id").alias("SEQ"),
        F.round(F.col("value") * 1000000).cast("long").alias("DURATION_NS"),
        F.when(F.col("event_type") == "error", F.lit(-5)).otherwise(F.lit(0)).cast("long").alias("RC"),
        (F.col("k") * 4096).cast("long").alias("REQ_BYTES"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(events(spark, sf_dir))


def event_tags():
    """JOBID when k is even, SCHEDID when k is divisible by three."""
    k, user = F.col("k"), F.col("user_id")
    pairs = F.array(
        F.when(k % 2 == 0, F.struct(F.lit("JOBID").alias("key"), F.pmod(user, F.lit(7)).cast("string").alias("value"))),
        F.when(k % 3 == 0, F.struct(F.lit("SCHEDID").alias("key"), F.pmod(k, F.lit(4)).cast("string").alias("value"))),
    )
    return F.map_from_entries(F.array_compact(pairs))


def execs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up events as started processes that carry tags."""
    return (
        events(spark, sf_dir)
        .where(F.col("event_type") == "signup")
        .select("HOSTNAME", "PID", "ts", F.col("event_id").alias("seq"), event_tags().alias("TAGS"))
        .where(F.size("TAGS") > 0)
    )


def mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as devices, the same on every host (25 of the 30 device numbers)."""
    nation = table(spark, sf_dir, "nation")
    name = F.lower("n_name")
    return nation.select(
        F.explode(F.array(*[F.lit(h) for h in HOSTS])).alias("HOSTNAME"),
        F.concat(F.lit("0:"), "n_nationkey").alias("devt"),
        F.concat(F.lit("/mnt/"), name).alias("MOUNT"),
        F.concat(F.lit("/export/"), name).alias("REMOTE_PATH"),
    )


def seen_mounts(rows: DataFrame) -> DataFrame:
    """Sign-up events as mounts that are seen: most periods of a device have none of their own."""
    n = F.col("event_id")
    return rows.where("event_type = 'signup'").select(
        "HOSTNAME", F.concat(F.lit("0:"), F.col("k") % 30).alias("devt"),
        F.concat(F.lit("/mnt/"), n).alias("MOUNT"), F.concat(F.lit("10.0.0.1:/export/"), n).alias("device"),
        (n % 3).cast("int").alias("source"), F.col("ts").alias("seen_at"), n.alias("line_no"),
    )


def probe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two probe hits per event; stretched so that the calls of a thread overlap."""
    return probe_hits(events(spark, sf_dir))


def probe_hits(rows: DataFrame) -> DataFrame:
    first = F.array(*[F.lit(names[0]) for names in PROBES_OF])
    other = F.array(*[F.lit(names[-1]) for names in PROBES_OF])
    number = F.pmod("event_id", F.lit(len(OPERATIONS))).cast("int")
    probe = F.when(F.col("k") % 2 == 0, F.get(first, number)).otherwise(F.get(other, number))
    k = F.col("k")
    mode = (
        F.when(k % 13 == 0, 0o140644).when(k % 5 == 0, 0o040755).when(k % 7 == 0, 0o120777).otherwise(0o100644)
    )
    start = F.unix_micros("ts")
    end = start + F.round(F.col("value") * 1e8).cast("long")
    hits = F.array(
        F.struct(F.lit("E").alias("phase"), (start * 1000).alias("t_ns")),
        F.struct(F.lit("R").alias("phase"), (end * 1000).alias("t_ns")),
    )
    return rows.select(
        "HOSTNAME", "TID", "PID", "UID", "COMM", probe.alias("probe"),
        F.col("event_id").alias("seq"),
        F.pmod("k", F.lit(11)).alias("name_len"), mode.alias("mode"),
        F.pmod("k", F.lit(30)).cast("long").alias("sbdev"),
        (k * 4096).cast("long").alias("bytes"),
        F.when(F.col("event_type") == "error", F.lit(-5)).otherwise(F.lit(0)).cast("long").alias("rc"),
        F.explode(hits).alias("__hit"),
    ).select("*", "__hit.phase", "__hit.t_ns").drop("__hit")


def item_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as calls: many rows, for order-independent operators."""
    line = table(spark, sf_dir, "lineitem")
    host = F.pmod("l_suppkey", F.lit(4))
    return line.select(
        F.concat(F.lit("host"), host).alias("HOSTNAME"),
        F.pmod("l_partkey", F.lit(100)).alias("TID"),
        F.pmod("l_partkey", F.lit(50)).alias("PID"),
        F.pmod("l_suppkey", F.lit(5)).alias("UID"),
        F.concat("l_returnflag", "l_linestatus").alias("COMM"),
        F.pmod("l_suppkey", F.lit(30)).alias("SBDEV"),
        F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(OPERATIONS))).cast("int").alias("OP_NO"),
        F.col("l_shipdate").cast("timestamp").alias("TS"),
        F.col("l_orderkey").alias("SEQ"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 1000).alias("DURATION_NS"),
        F.when(F.col("l_discount") > 0.09, F.lit(-5)).otherwise(F.lit(0)).cast("long").alias("RC"),
        (F.round("l_quantity").cast("long") * 4096).alias("REQ_BYTES"),
    )
