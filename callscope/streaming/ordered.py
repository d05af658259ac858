"""Keyed state that sees its rows in time order.

Rows of one key can arrive late and out of order, inside a micro-batch and across batches.
They are kept until the watermark has passed them and are then handled in order, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callscope.shipping import by_value

#: Rows of one entry of the state, and rows that are put in order together before they are cut into entries.
CHUNK_ROWS, SORTED_ROWS = 10_000, 500_000


class InTimeOrder(StatefulProcessor):
    """Buffers rows per key, sorts them by ``order`` and hands them on as the watermark moves.

    ``row_schema`` are the buffered columns (``order[0]`` counts nanoseconds), ``carry_schema``
    what is kept of the past. Only rows that the watermark has not yet passed are buffered:
    the state per key is bounded by its rows within the watermark delay.

    Rows lie in the state as Arrow batches, so that what goes to and from the state store is one entry for thousands of
    rows. A batch is found by its earliest time and a number; those that the watermark has not reached are not read.
    """

    row_schema: T.StructType
    carry_schema: T.StructType
    order: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrow_schema = to_arrow_schema(self.row_schema)
        self.pending = handle.getMapState("pending", "first_ms long, number long", "rows binary")
        self.carry = handle.getValueState("carry", self.carry_schema)
        self.due = handle.getValueState("due", "ms long, number long")

    def advance(self, key, rows: pd.DataFrame, carry: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
        """Handle ordered rows; returns the output rows and the new carry."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in rows:
            held.append(self._packed(frame))
            size += len(frame)
            if size >= SORTED_ROWS:
                self._keep(held)
                held, size = [], 0
        self._keep(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        places = list(self.pending.keys())
        reached = sorted((p for p in places if p[0] < watermark_ms), key=lambda p: p[1])
        chunks = [pa.ipc.read_record_batch(pa.py_buffer(self.pending.getValue(p)[0]), self.arrow_schema) for p in reached]
        rows = pa.Table.from_batches(chunks, self.arrow_schema).to_pandas()
        passed = rows[self.order[0]] // 1_000_000 < watermark_ms
        ready, waiting = rows[passed], rows[~passed]
        for place in reached:
            self.pending.removeKey(place)
        ahead = [p for p in places if p[0] >= watermark_ms]
        if ahead:
            self._wake_at(min(p[0] for p in ahead), max(p[1] for p in ahead) + 1, fired=True)
        else:
            self.due.clear()
        if len(waiting):
            self._keep([self._packed(waiting)])
        if len(ready):
            ready = ready.sort_values(self.order, kind="stable", ignore_index=True)
            before = self.carry.get() if self.carry.exists() else None
            out, after = self.advance(key, ready, before)
            if after is None:
                self.carry.clear()
            else:
                self.carry.update(after)
            if out is not None and len(out):
                yield out

    def _packed(self, frame: pd.DataFrame) -> pa.RecordBatch:
        if frame[self.order[0]].isna().any():
            raise ValueError(f"a row without {self.order[0]}")
        columns = [pa.array(frame[f.name], f.type, from_pandas=True) for f in self.arrow_schema]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow_schema)

    def _keep(self, batches: list[pa.RecordBatch]) -> None:
        """Put rows into the state, in time order, and wake up at the earliest."""
        rows = pa.Table.from_batches(batches, self.arrow_schema)
        if not rows.num_rows:
            return
        number = self.due.get()[1] if self.due.exists() else 0
        rows = rows.sort_by(self.order[0]).combine_chunks()
        firsts = []
        for chunk in rows.to_batches(max_chunksize=CHUNK_ROWS):
            firsts.append(chunk.column(self.order[0])[0].as_py() // 1_000_000)
            self.pending.updateValue((firsts[-1], number), (chunk.serialize().to_pybytes(),))
            number += 1
        self._wake_at(firsts[0], number)

    def _wake_at(self, row_ms: int, number: int, fired: bool = False) -> None:
        """Register the timer unless an earlier one is; ``number`` is that of the next entry. A timer that fired is gone."""
        wake = row_ms + 1
        if not fired and self.due.exists():
            known = self.due.get()[0]
            if known <= wake:
                self.due.update((known, number))
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(wake)
        self.due.update((wake, number))

    def close(self) -> None:
        pass


by_value(__name__)
