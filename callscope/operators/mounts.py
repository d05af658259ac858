"""Mount points of devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.scalars import device_text, remote_path
from callscope.model import DEFAULT_VACUUM
from callscope.plans.lookup import lookup

MOUNT_KEY = ["HOSTNAME", "devt"]

# Where a mount row was seen, in order of preference among rows seen at the same time.
OWN_PROCESS, COLLECTOR, PARTITION_LIST = 0, 1, 2


def mount_epoch(ts, vacuum: int = DEFAULT_VACUUM):
    """Number of the period in which a resolved mount stays as it is."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(vacuum))


def upsert_mounts(candidates: DataFrame) -> DataFrame:
    """One row per host and device: the latest write wins."""
    return candidates.groupBy(*MOUNT_KEY).agg(
        F.max_by(F.struct("MOUNT", "device"), F.struct("seen_at", "line_no")).alias("__m")
    ).select(*MOUNT_KEY, "__m.MOUNT", "__m.device", remote_path(F.col("__m.device")).alias("REMOTE_PATH"))


def first_mounts(candidates: DataFrame, vacuum: int = DEFAULT_VACUUM) -> DataFrame:
    """Of the candidates of a host, device and vacuum period the one that counts, with all its columns and ``epoch``.

    Taking it again from results of parts gives the result of all, so it can be kept from one micro-batch to the next."""
    key = [*MOUNT_KEY, "epoch"]
    rows = candidates.withColumn("epoch", mount_epoch(F.col("seen_at"), vacuum))
    own = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*own), F.struct("seen_at", "source", -F.col("line_no")))
    return rows.groupBy(*key).agg(first.alias("__m")).select(*[c if c in key else f"__m.{c}" for c in rows.columns])


def resolve_mounts(candidates: DataFrame, vacuum: int = DEFAULT_VACUUM) -> DataFrame:
    """One row per host, device and vacuum period: the first one seen sticks.

    Among rows seen at the same time the process's own table goes before the collector's
    and that before the partition list; inside one table a later line replaces an earlier.
    """
    epoch = mount_epoch(F.col("seen_at"), vacuum).alias("epoch")
    return (
        candidates.select("*", epoch)
        .groupBy(*MOUNT_KEY, "epoch")
        .agg(F.min_by(
            F.struct("MOUNT", "device"), F.struct("seen_at", "source", -F.col("line_no"))
        ).alias("__m"))
        .select(*MOUNT_KEY, "epoch", "__m.MOUNT", "__m.device", remote_path(F.col("__m.device")).alias("REMOTE_PATH"))
    )


def mount_periods(mounts: DataFrame) -> DataFrame:
    """Resolved mounts as (HOSTNAME, devt, since, until, ...): a known mount stays until a later period
    resolves the device anew. Periods that only repeat the mount before them are merged."""
    by = Window.partitionBy(*MOUNT_KEY).orderBy("epoch")
    what = F.struct(*[c for c in mounts.columns if c not in (*MOUNT_KEY, "epoch")])
    changes = mounts.withColumn("__before", F.lag(what).over(by)).where(~F.col("__before").eqNullSafe(what))
    return changes.drop("__before").withColumn("until", F.lead("epoch").over(by)).withColumnRenamed("epoch", "since")


def attach_mounts(
    rows: DataFrame,
    mounts: DataFrame,
    columns=("MOUNT", "REMOTE_PATH"),
    vacuum: int = DEFAULT_VACUUM,
    time: str = "TIMESTAMP",
) -> DataFrame:
    """Mount columns of each row's device (SBDEV), empty text where it is unknown.

    ``mounts`` has unique (HOSTNAME, devt), or (HOSTNAME, devt, epoch) as made by
    ``resolve_mounts`` with the same vacuum period. With periods a row takes the newest one at
    or before its own.
    """
    keyed = rows.withColumn("devt", device_text(F.col("SBDEV")))
    if "epoch" in mounts.columns:
        at = F.col(time).cast("timestamp")
        if time == "TIMESTAMP":  # a sample's time is the end of its interval
            at = at - F.expr("INTERVAL 1 MICROSECOND")
        own = mount_epoch(at, vacuum)
        side = mount_periods(mounts.select(*MOUNT_KEY, "epoch", *columns)).alias("m")
        keyed = keyed.withColumn("__epoch", own).alias("r")
        same = [F.col(f"r.{k}") == F.col(f"m.{k}") for k in MOUNT_KEY]
        within = (F.col("__epoch") >= F.col("since")) & (F.col("until").isNull() | (F.col("__epoch") < F.col("until")))
        joined = keyed.join(side, [*same, within], "left")
        found = joined.select(*[F.col(f"r.{c}") for c in rows.columns], *[F.col(f"m.{c}") for c in columns])
    else:
        found = lookup(keyed, mounts.select(*MOUNT_KEY, *columns), MOUNT_KEY).drop("devt")
    return found.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})
