"""Ranked lexical search: the best documents of each item, by a K2-treap over the grid of terms and documents.

Terms are runs of ASCII letters and digits and of all code points above 127, with A-Z lower-cased. A term of a document
has a whole-number impact that grows with its occurrences and falls with the document's length; a document's score for
an item is the sum of weight times impact over the item's different terms.

1. One pass counts the documents with terms and all their terms.
2. One pass cuts every task's documents into blocks of about ``BLOCK_BYTES`` of text. A block is a square grid, terms
   from frequent to rare down, documents from short to long across, whose cells are the impacts. The grid is halved both
   ways again and again into a quadtree: per level, each cell that is not empty has four bits (which of its quarters are
   not empty) and the largest impact inside it, stored as the difference to the cell around it. The children of a cell
   follow from the rank of its bits, so no pointers are stored. Blocks are rows of a written table, packed by the task
   that made them: what passes through Spark is about a quarter of what a search unpacks.
3. Items come in batches of at most ``BATCH_BYTES`` of text, whose terms are broadcast. A pass over the blocks' terms
   adds up in how many documents each term of the batch occurs. A second pass searches: an item's terms are rows of the
   grid, and their paths descend together, a range of documents at a time. The largest impacts of the cells that the
   rows reach in a range, times the weights, bound the scores of its documents. The ranges with the greatest bounds are
   halved first, ``BEAM`` of them at once, until no bound reaches the tenth best score found by the task. At a single
   document the bound is its score.
4. Each task returns the best documents of each item in its blocks; the best of these stay.

Nothing depends on a hot term or document: a block is bounded by its text (a longer document is a block of its own),
and terms are never a shuffle key. At most ``top`` rows per item and task are shuffled. Batches run one after the other.
Texts and blocks reach a task's worker about ``ARROW_BYTES`` at a time, not all that a task reads at once.

Defined results: a null text or one without terms is no document; items without terms, or whose terms no document has,
have no rows; a score of 0 gives no row; equal scores go by ascending doc_id, null ids last; rows that repeat an id
are documents of their own, and repeated items are ranked each; no items or no documents give no rows. ``doc_id`` and
``item_id`` are read as long numbers; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.textops import chunks
from callscope.plans.storage import LARGE_ROWS, written
from callscope.session import settings_held

#: Bytes of text in a block of the index, and of items that are searched for at once.
BLOCK_BYTES = 6_000_000
BATCH_BYTES = 4_000_000
#: Bytes of texts or blocks that are handed to a worker at once, besides the last of them.
ARROW_BYTES = 4_000_000
#: Ranges of documents that are halved at once.
BEAM = 128
TOP = 10

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_IN_TERM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_BYTE >= 128)
#: Which child a quarter of a cell is, by the cell's four bits; -1 for an empty quarter.
_RANK = np.array([[bin(bits & ((1 << q) - 1)).count("1") if bits >> q & 1 else -1 for q in range(4)] for bits in range(16)])
_CHILDREN = np.array([bin(bits).count("1") for bits in range(16)], np.int32)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the terms of consecutive texts in order, number of the first term of each text, with the total at the end)."""
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    inside = _IN_TERM[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    upto = np.cumsum(inside, dtype=np.int64)
    edges = np.append(upto[starts] - 1, upto[-1])
    letters = _LOWER[data[inside]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(letters))
    return terms, np.searchsorted(starts, offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(documents with terms, their terms) of each batch of texts."""
    for batch in batches:
        docs = total = 0
        for _, data, offsets in chunks(batch.column("text")):
            n = np.diff(terms_of(data, offsets)[1])
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["docs", "terms"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(number of documents that have terms, number of all their terms)."""
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "docs long, terms long")
    row = sums.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    return row["docs"], row["terms"]


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of a number below 2**32 with a gap after each."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times in a document of ``n`` terms, in whole numbers."""
    m = 100 - 90 + (90 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def quadtree(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the cells of a grid, no two alike: (bits of the cells of each level but the last, largest values of each level)."""
    height = max(int(row.max()), int(column.max())).bit_length()
    code = (_spread(row) << np.uint64(1)) | _spread(column)
    order = np.argsort(code)
    code, value = code[order], value[order]
    bits, largest = [], [value]
    for _ in range(height):
        around = code >> np.uint64(2)
        first = np.flatnonzero(np.append(True, around[1:] != around[:-1]))
        quarter = np.left_shift(1, (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        bits.append(np.bitwise_or.reduceat(quarter, first))
        largest.append(np.maximum.reduceat(largest[-1], first))
        code = around[first]
    return bits[::-1], largest[::-1]


def _pack(bits: list[np.ndarray], largest: list[np.ndarray]) -> tuple[bytes, list[int], bytes]:
    """(bits, two cells to a byte; cells of each level; differences of the largest values to those of the cells around)."""
    flat = np.concatenate([*bits, np.zeros(sum(map(len, bits)) % 2, np.uint8)]) if bits else np.zeros(0, np.uint8)
    drops = [largest[0]]
    for level, own in enumerate(bits):
        drops.append(np.repeat(largest[level], _CHILDREN[own]) - largest[level + 1])
    return (flat[::2] | flat[1::2] << 4).tobytes(), [len(x) for x in largest], np.concatenate(drops).astype(np.int32).tobytes()


def _packed(data) -> bytes:
    """The bytes compressed, after their number."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer) -> pa.Buffer:
    return pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8), "little"), codec="zstd")


class Grid:
    """A block's quadtree, ready to be descended. Cells are numbered level by level; the last number stands for an empty cell."""

    def __init__(self, bits: bytes, sizes: list[int], drops: bytes):
        self.height = len(sizes) - 1
        inner, cells = sum(sizes[:-1]), sum(sizes)
        packed = np.frombuffer(bits, np.uint8)
        self.bits = np.zeros(cells + 1, np.uint8)
        self.bits[:inner] = np.stack([packed & 15, packed >> 4], axis=1).ravel()[:inner]
        children = _CHILDREN[self.bits]
        self.first = np.cumsum(children, dtype=np.int32) - children + 1
        self.largest = np.zeros(cells + 1, np.int32)
        self.largest[:cells] = np.frombuffer(drops, np.int32)
        low = 0
        for size, below in zip(sizes, sizes[1:]):
            inside = slice(low + size, low + size + below)
            self.largest[inside] = np.repeat(self.largest[low : low + size], children[low : low + size]) - self.largest[inside]
            low += size
        self.empty = cells

    def search(self, rows: np.ndarray, weights: np.ndarray, top: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of all columns that may be among the ``top`` best with a score of ``least`` or more."""
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        here = rows >> self.height == 0  # a row below the grid is empty
        rows, weights = rows[here], weights[here]
        cells = np.zeros((1, len(rows)), np.int32)
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.largest[cells] @ weights
        if self.height == 0:
            keep = bound >= least
            return prefix[keep], bound[keep]
        while len(bound):
            best = np.argpartition(-bound, BEAM)[:BEAM] if len(bound) > BEAM else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[best] = False
            down = (self.height - 1 - level[best])[:, None]
            quarter = 2 * ((rows[None, :] >> down) & 1)
            inside = cells[best]
            bits, first = self.bits[inside], self.first[inside]
            halves = []
            for half in (0, 1):
                child = _RANK[bits, quarter + half]
                halves.append(np.where(child >= 0, first + child, self.empty))
            new = np.concatenate(halves)
            new_level = np.tile(level[best] + 1, 2)
            new_prefix = np.concatenate([2 * prefix[best], 2 * prefix[best] + 1])
            new_bound = self.largest[new] @ weights
            done = new_level == self.height
            found = done & (new_bound >= least)
            if found.any():
                columns, scores = np.concatenate([columns, new_prefix[found]]), np.concatenate([scores, new_bound[found]])
                if len(scores) >= top:
                    least = max(least, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
                    keep = scores >= least
                    columns, scores = columns[keep], scores[keep]
            old, go = rest & (bound >= least), ~done & (new_bound >= least)
            cells = np.concatenate([cells[old], new[go]])
            level, prefix = np.concatenate([level[old], new_level[go]]), np.concatenate([prefix[old], new_prefix[go]])
            bound = np.concatenate([bound[old], new_bound[go]])
        return columns, scores


_INDEX = "terms binary, holders binary, docs array<long>, bits binary, sizes array<int>, drops binary"


def _index(docs: int, terms: int, block_bytes: int):
    """A reader of (doc_id, text) that writes blocks of the index."""

    def block(parts: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch | None:
        ids = pa.concat_arrays([p[0] for p in parts])
        coded = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
        n = np.concatenate([p[2] for p in parts])
        if not len(coded):
            return None
        # from short to long, without the documents that have no terms
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        place = np.zeros(len(n), np.int64)
        place[order] = np.arange(len(order))
        pair = coded.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(place, n)
        pair, tf = np.unique(pair, return_counts=True)
        term, column = pair // len(order), pair % len(order)
        holders = np.bincount(term, minlength=len(coded.dictionary))
        frequent = np.argsort(-holders, kind="stable")
        row = np.zeros(len(frequent), np.int64)
        row[frequent] = np.arange(len(frequent))
        bits, sizes, drops = _pack(*quadtree(row[term], column, impacts(tf, n[order][column], docs, terms)))
        names = coded.dictionary.take(pa.array(frequent)).cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), "\n")[0].as_buffer()
        return pa.RecordBatch.from_arrays([
            pa.array([_packed(joined)], pa.binary()), pa.array([_packed(holders[frequent].astype(np.int32).tobytes())], pa.binary()),
            pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array([bits], pa.binary()),
            pa.array([sizes], pa.list_(pa.int32())), pa.array([_packed(drops)], pa.binary()),
        ], names=["terms", "holders", "docs", "bits", "sizes", "drops"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            for base, data, offsets in chunks(batch.column("text")):
                if parts and held + len(data) > block_bytes:
                    if (out := block(parts)) is not None:
                        yield out
                    parts, held = [], 0
                found, first = terms_of(data, offsets)
                parts.append((ids.slice(base, len(offsets) - 1), found, np.diff(first)))
                held += len(data)
        if parts and (out := block(parts)) is not None:
            yield out

    return read


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(the written index of all documents, number of documents that have terms)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count, total = corpus_size(rows)
    return written(rows.mapInArrow(_index(count, total, block_bytes), _INDEX), "term-grid", LARGE_ROWS), count


def _batches(items: DataFrame, batch_bytes: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """(item id, its different terms) of the items, in lists of bounded size."""
    batch, held = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        text = row["text"] or ""
        terms: set[str] = set()
        for _, data, offsets in chunks(pa.array([text])):
            terms.update(terms_of(data, offsets)[0].to_pylist())
        if batch and held + len(text) > batch_bytes:
            yield batch
            batch, held = [], 0
        batch.append((row["item_id"], sorted(terms)))
        held += len(text)
    if batch:
        yield batch


def _rows_of(names: pa.BinaryScalar, vocabulary: pa.Array) -> np.ndarray:
    """The grid row of each term of the vocabulary, -1 where a block has none; ``names`` is the block's packed joined terms."""
    joined = _unpacked(names.as_buffer())
    own = pc.split_pattern(pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, joined.size], np.int32)), joined), "\n").flatten()
    return pc.index_in(vocabulary, value_set=own).fill_null(-1).to_numpy(zero_copy_only=False)


class _Asked(NamedTuple):
    """A batch of items for the search: per item its id, the places of its terms in the vocabulary and their weights."""

    vocabulary: pa.Array
    items: list[tuple[int | None, np.ndarray, np.ndarray]]


def _holders(vocabulary):
    """A reader of the index that writes (term, documents that hold it) of each block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = _rows_of(batch.column("terms")[k], vocabulary.value)
                at = np.flatnonzero(row >= 0)
                holders = np.frombuffer(_unpacked(batch.column("holders")[k].as_buffer()), np.int32)[row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(holders, pa.int64())], names=["term", "holders"])

    return read


def _search(asked, top: int):
    """A reader of the index that writes (item, item_id, doc_id, score): the best of each item in all blocks of the task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, items = asked.value
        best: list[list] = [[] for _ in items]
        for batch in batches:
            for k in range(batch.num_rows):
                row = _rows_of(batch.column("terms")[k], vocabulary)
                sizes, ids = batch.column("sizes")[k].as_py(), batch.column("docs")[k].as_py()
                grid = Grid(batch.column("bits")[k].as_buffer(), sizes, _unpacked(batch.column("drops")[k].as_buffer()))
                for no, (_, places, weights) in enumerate(items):
                    here = row[places] >= 0
                    if not here.any():
                        continue
                    least = best[no][-1][0] if len(best[no]) == top else 1
                    columns, scores = grid.search(row[places[here]].astype(np.int64), weights[here], top, least)
                    if len(columns):
                        found = best[no] + [(score, ids[column]) for column, score in zip(columns.tolist(), scores.tolist())]
                        best[no] = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))[:top]
        rows = [(no, items[no][0], doc, score) for no, found in enumerate(best) for score, doc in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["item", "item_id", "doc_id", "score"]
        )

    return read


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents."""
    with settings_held(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}):
        found = _found(docs, items, top, block_bytes, batch_bytes)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _found(docs: DataFrame, items: DataFrame, top: int, block_bytes: int, batch_bytes: int) -> DataFrame | None:
    """item, item_id, doc_id and score of each item's best documents in each task's blocks, written; None without items."""
    spark = docs.sparkSession
    index, count = build_index(docs, block_bytes)
    found, done = None, 0
    for batch in _batches(items, batch_bytes):
        terms = sorted({t for _, own in batch for t in own})
        place = {t: k for k, t in enumerate(terms)}
        vocabulary = spark.sparkContext.broadcast(pa.array(terms, pa.string()))
        held = dict(
            index.select("terms", "holders").mapInArrow(_holders(vocabulary), "term long, holders long")
            .groupBy("term").agg(F.sum("holders")).collect()  # at most one row for each term of the batch
        )
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(terms))], np.int64)
        places = [np.array([place[t] for t in own], np.int64) for _, own in batch]
        asked = spark.sparkContext.broadcast(_Asked(
            pa.array(terms, pa.string()), [(item, at, weight[at]) for (item, _), at in zip(batch, places)]
        ))
        part = written(
            index.select("terms", "docs", "bits", "sizes", "drops")
            .mapInArrow(_search(asked, top), "item long, item_id long, doc_id long, score long")
            .withColumn("item", F.col("item") + done), "ranked",
        )
        vocabulary.destroy()
        asked.destroy()
        found, done = part if found is None else found.unionAll(part), done + len(batch)
    return found


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH words AS (
  SELECT r, doc_id, {_LOWERED.format('w')} AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(text, '{_TERM}')) AS w FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, docs),
asked AS (
  SELECT DISTINCT i, item_id, {_LOWERED.format('w')} AS term
  FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(text, '{_TERM}')) AS w FROM benchmark)),
scored AS (
  SELECT i, item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (r), corpus GROUP BY i, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
