"""Samples on the console."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.records import json_iso
from callscope.operators.reshape import transpose
from callscope.operators.stats import BY_PROCESS, SAMPLE_SCOPE
from callscope.sinks.base import Sink, register_sink


@register_sink("screen")
class ConsoleSink(Sink):
    """Prints every sample of a batch: JSON lines, or with ``table_format`` one field per line.

    Rows reach the driver partition by partition, so it never holds more than one of them.
    """

    def __init__(self, table_format: bool = False):
        self.table_format = table_format

    def lines(self, batch: DataFrame) -> DataFrame:
        """The lines, as one column of text: in the order of the batch, or as a table by interval, host, sample and field."""
        if not self.table_format:
            return batch.select(json_iso(batch).alias("line"))
        long = transpose(batch, BY_PROCESS)
        place = [*SAMPLE_SCOPE, "sample_no", "field"]
        texts = [F.col(c).cast("string") for c in place]
        return long.orderBy(*place).select(F.concat_ws(" ", *texts, F.coalesce("value", F.lit(""))).alias("line"))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        for row in self.lines(batch).toLocalIterator():
            print(row["line"])
