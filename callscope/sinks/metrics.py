"""Samples as long-format metrics or text lines for a scraper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.metrics import exposition_lines, to_metrics
from callscope.sinks.base import Sink, register_sink


@register_sink("prometheus")
class MetricsSink(Sink):
    """Writes ``<path>/batch=<id>/``: metric rows as Parquet by day, or lines of text.

    A replayed batch replaces itself, so a path belongs to one checkpoint.
    """

    def __init__(self, path: str, tracked: Sequence[str] = (), merge: bool = False, as_text: bool = False):
        self.path = path.rstrip("/")
        self.tracked = list(tracked)
        self.merge = merge
        self.as_text = as_text

    def write(self, batch: DataFrame, batch_id: int) -> None:
        metrics = to_metrics(batch, self.tracked, self.merge)
        target = f"{self.path}/batch={batch_id}"
        if self.as_text:
            exposition_lines(metrics).write.mode("overwrite").text(target)
        else:
            days = metrics.withColumn("date", F.date_format("TIMESTAMP", "yyyy-MM-dd"))
            days.write.mode("overwrite").partitionBy("date").parquet(target)
