"""The live buffer of newest samples, and scrapes that empty it exactly once."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.model import BUFFER_WARN_PERCENT, DEFAULT_BUFFER_SAMPLES
from callscope.operators.metrics import BATCH, buffer_usage
from callscope.plans.lookup import lookup
from callscope.plans.storage import delete_path, get_text, names_in, put_text
from callscope.sinks.base import Sink, register_sink

log = logging.getLogger(__name__)

_HELD = "HOSTNAME string, TIMESTAMP timestamp, batch_id long"
_EMPTY = {"batch": None, "held": None, "before": None, "pending": None, "scrapes": 0, "scraped": -1}


@register_sink("buffer")
class BufferSink(Sink):
    """Holds the newest ``buffer_size`` samples (intervals) of each host; older ones fall out as new ones come.

    Under ``path``: the rows of each micro-batch (``rows/batch=<id>``), which are written once; which (HOSTNAME,
    TIMESTAMP) of them are held (``held/<id>``), written anew by each micro-batch; each host's fill level after each
    micro-batch (``usage/batch=<id>``); and one small ``state`` file that names what counts. A micro-batch that is
    replayed starts from what its predecessor left. Rows that nothing holds any more are deleted batch by batch.

    ``scrape`` gives everything since the scrape before to a function and empties the buffer. What a scrape takes is
    entered in the state before the function runs, and crossed out after it: after a failure in between the next scrape
    repeats the same rows under the same number, so a function that replaces what it stored under that number stores
    each row once. Scrapes and micro-batches take turns.
    """

    def __init__(self, path: str, buffer_size: int = DEFAULT_BUFFER_SAMPLES):
        self.path = path.rstrip("/")
        self.buffer_size = buffer_size
        self.lock = Lock()

    def _state(self, spark: SparkSession) -> dict:
        text = get_text(spark, f"{self.path}/state")
        return dict(_EMPTY) if text is None else json.loads(text)

    def _put(self, spark: SparkSession, state: dict) -> None:
        put_text(spark, f"{self.path}/state", json.dumps(state))

    def _held(self, spark: SparkSession, name: str | None) -> DataFrame:
        return spark.createDataFrame([], _HELD) if name is None else spark.read.schema(_HELD).parquet(f"{self.path}/held/{name}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        with self.lock:
            self._append(batch, batch_id)

    def _append(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = self._state(spark)
        if batch_id <= state["scraped"]:
            return  # replayed after a scrape took it
        # of a replayed batch: what counted before it
        before = state["before"] if state["batch"] == batch_id else state["held"]
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch_id}")
        new = batch.select(*BATCH).distinct().withColumn("batch_id", F.lit(batch_id).cast("long"))
        newest = Window.partitionBy("HOSTNAME").orderBy(F.col("TIMESTAMP").desc())
        # an interval that two micro-batches brought is one sample
        both = self._held(spark, before).unionByName(new)
        ranked = both.withColumn("n", F.dense_rank().over(newest)).where(F.col("n") <= self.buffer_size).drop("n")
        name = str(batch_id) if before != str(batch_id) else f"{batch_id}-again"
        ranked.write.mode("overwrite").parquet(f"{self.path}/held/{name}")
        usage = buffer_usage(self._held(spark, name), self.buffer_size)
        usage.write.mode("overwrite").parquet(f"{self.path}/usage/batch={batch_id}")
        over = spark.read.schema(usage.schema).parquet(f"{self.path}/usage/batch={batch_id}").where("over_limit").agg(
            F.count(F.lit(1)).alias("hosts"), F.max("usage_pct").alias("most")
        ).first()
        if over["hosts"]:
            log.warning(
                "buffers of %d hosts are more than %d %% full, up to %.2f %%: scrapes come too slowly",
                over["hosts"], BUFFER_WARN_PERCENT, over["most"],
            )
        self._put(spark, {**state, "batch": batch_id, "held": name, "before": before})
        self._drop_unheld(spark, [name, before, (state["pending"] or {}).get("held")])

    def _drop_unheld(self, spark: SparkSession, names: list[str | None]) -> None:
        """Delete held tables that no longer count, and the rows of micro-batches before the oldest one held."""
        kept = [n for n in names if n is not None]
        for name in names_in(spark, f"{self.path}/held"):
            if name not in kept:
                delete_path(spark, f"{self.path}/held/{name}")
        oldest = [self._held(spark, n).agg(F.min("batch_id").alias("b")).first()["b"] for n in set(kept)]
        oldest = [b for b in oldest if b is not None]
        for folder in names_in(spark, f"{self.path}/rows"):
            if oldest and int(folder.partition("=")[2]) < min(oldest):
                delete_path(spark, f"{self.path}/rows/{folder}")

    def _rows(self, spark: SparkSession, held: str | None) -> DataFrame | None:
        if held is None:
            return None
        rows = spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        rows = rows.withColumn("batch_id", F.col("batch_id").cast("long"))
        return lookup(rows, self._held(spark, held), [*BATCH, "batch_id"], how="left_semi").drop("batch_id")

    def samples(self, spark: SparkSession) -> DataFrame | None:
        """The rows held now; None if the buffer is empty."""
        return self._rows(spark, self._state(spark)["held"])

    def usage(self, spark: SparkSession) -> DataFrame:
        """(batch, HOSTNAME, samples, usage_pct, over_limit) after each micro-batch."""
        return spark.read.parquet(f"{self.path}/usage")

    def scrape(self, spark: SparkSession, deliver: Callable[[DataFrame, int], None]) -> int | None:
        """Give the rows since the scrape before and the scrape's number to ``deliver``; returns the number, None if there is nothing."""
        with self.lock:
            state = self._state(spark)
            if state["pending"] is None:
                if state["held"] is None:
                    return None
                taken = {"number": state["scrapes"] + 1, "held": state["held"]}
                state = {**state, "pending": taken, "held": None, "before": None, "batch": None, "scraped": state["batch"]}
                self._put(spark, state)
            taken = state["pending"]
            deliver(self._rows(spark, taken["held"]), taken["number"])
            self._put(spark, {**state, "pending": None, "scrapes": taken["number"]})
            return taken["number"]
