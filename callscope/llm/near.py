"""N-gram Jaccard join: pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Texts with the same set are one class; only one text of a class goes on.
2. MinHash signatures are cut into bands. Of the numbers of rows per band for which the bands that the recall wanted at the
   threshold takes fit into ``HASHES`` hash values, the largest is chosen: then unlike texts meet as rarely as can be (at 0.8 and
   0.9999: 51 bands of 8 rows; pairs of similarity 0.3 meet with 0.3 %). Classes that share a band hash meet on it: each is tied to the smallest class of its bucket, so a
   bucket of m classes gives m - 1 ties, not m * m pairs.
3. Tied classes form clusters. A cluster is cut into tiles of about ``TILE`` classes by a hash, and a task compares two
   tiles at a time, on the full shingle sets and all pairs: it counts each class's links and returns one row per class,
   with a root of the classes it is linked to. Memory is that of two tiles; pairs never become rows.
4. Roots of the tiles are joined to groups of linked classes.

Comparing all pairs of a cluster finds every pair that shares a band and more, so recall is at least that of the bands.
A class is known by a 64-bit hash of its set.

Defined results: texts without words (null ones, too) have an empty set; they are one class without links; rows that
repeat an id count as documents of the class of their text; null ids sort last; no rows give no rows; extra columns are
left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.columns import one_row_each
from callscope.llm.components import connected_components
from callscope.llm.textops import chunks, mix, shingles, words
from callscope.plans.storage import written

WORDS = 5
THRESHOLD = 0.8
#: Chance to find a pair that is just as similar as the threshold.
RECALL = 0.9999
#: Hash values of a signature, at most.
HASHES = 416
#: Classes compared with each other at a time.
TILE = 256


def _mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands with which a pair at the threshold shares one with the recall wanted."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows per band): the most rows whose bands fit."""
    rows = 1
    while threshold < 1 and (rows + 1) * bands_for(threshold, recall, rows + 1) <= hashes:
        rows += 1
    return (bands_for(threshold, recall, rows) if threshold < 1 else 1), rows


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of texts: (shingles, sorted and distinct within each text; first of each text and the total)."""
    for _, data, offsets in chunks(texts):
        hashes, start = shingles(*words(data, offsets), n)
        owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        yield hashes, np.searchsorted(owner, np.arange(len(start)))


def _set_hash(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One hash per text of its set: the sum of mixed members, mixed with their number; 0 for an empty set."""
    size = np.diff(start).astype(np.uint64)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), start[:-1][full]) ^ size[full])
    return out


def _signatures(n: int, rows: int, bands: int):
    """A reader of (doc_id, mark, text) that writes (doc_id, mark, node, size, bands)."""
    draw = np.random.Generator(np.random.PCG64(7))
    factors = (draw.integers(1, 2**63, rows * bands, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, all_bands = [], [], []
            for hashes, start in _sets(batch.column("text"), n):
                size = np.diff(start)
                full = np.flatnonzero(size)
                found = np.zeros((len(size), bands), np.uint64)
                if len(full):
                    at = start[:-1][full]
                    for band in range(bands):
                        value = np.full(len(full), band + 1, np.uint64)
                        for k in range(band * rows, (band + 1) * rows):
                            # the shingles are mixed already: an odd factor brings them into another order
                            value = mix(value ^ np.minimum.reduceat(hashes * factors[k], at))
                        found[full, band] = value
                nodes.append(_set_hash(hashes, start))
                sizes.append(size)
                all_bands.append(found)
            flat = np.concatenate(all_bands).view(np.int64) if all_bands else np.zeros((0, bands), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("mark"),
                pa.array(np.concatenate(nodes).view(np.int64) if nodes else [], pa.int64()),
                pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands, dtype=np.int32)), pa.array(flat.ravel())),
            ], names=["doc_id", "mark", "node", "size", "bands"])

    return read


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold (a square of booleans), by the members they share."""
    count = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count), size)
    members, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[place] > 1
    owner, place = owner[shared], (np.cumsum(seen > 1) - 1)[place[shared]]
    both = np.zeros((count, count), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    step = max(256, 4_000_000 // count)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [low, low + step])
        part = np.zeros((count, min(step, int(place[-1]) + 1 - low)), np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        both += part @ part.T
    either = size[:, None] + size[None, :] - both
    # the same division as a plain comparison of two sets would make
    return both.astype(np.float64) / np.maximum(either, 1) >= threshold


def _roots(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches over the links."""
    label = nodes.copy()
    while True:
        least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(least, label)
        if (least == label).all():
            return label
        label = least


def _compare(n: int, threshold: float):
    """A reader of (cluster, low, high, tile, node, text) sorted by the first three; writes (node, links, root)."""

    def one(rows: list[tuple[int, int, np.ndarray]], low: int, high: int):
        kept = {node: (tile, s) for tile, node, s in rows}  # rows that repeat an id and a text
        nodes = np.array(sorted(kept), np.int64)
        tiles = np.array([kept[x][0] for x in nodes.tolist()])
        linked = _linked([kept[x][1] for x in nodes.tolist()], threshold)
        np.fill_diagonal(linked, False)
        if low != high:  # links inside a tile are counted where it meets itself
            linked &= tiles[:, None] != tiles[None, :]
        some = np.flatnonzero(linked.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([
                pa.array(nodes[some]), pa.array(linked.sum(axis=1)[some].astype(np.int64)), pa.array(_roots(linked, nodes)[some]),
            ], names=["node", "links", "root"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            sets = [h[s[i] : s[i + 1]] for h, s in _sets(batch.column("text"), n) for i in range(len(s) - 1)]
            own = [int(_set_hash(x, np.array([0, len(x)])).view(np.int64)[0]) for x in sets]
            columns = [batch.column(c).to_pylist() for c in ("cluster", "low", "high", "tile", "node")]
            for *now, tile, node, x, y in zip(*columns, sets, own):
                if node != y:
                    continue  # another text under the same id
                if now != key:
                    if len(rows) > 1:
                        yield from one(rows, *key[1:])
                    key, rows = now, []
                rows.append((tile, node, x))
        if len(rows) > 1:
            yield from one(rows, *key[1:])

    return read


def jaccard_classes(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, n: int = WORDS, tile: int = TILE
) -> DataFrame:
    """One row per document: doc_id, mark (a hash of its text), class_id and group_id (smallest ids), class_size, n_links (to
    other classes), kept (the first document of its group)."""
    bands, rows = choose_bands(threshold, recall, hashes)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), "text")
    # null ids sort last
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    signed = written(plain.mapInArrow(
        _signatures(n, rows, bands), "doc_id long, mark long, node long, size long, bands array<long>"
    ), "signatures")
    classes = signed.groupBy("node").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("class_size"))
    # equal sets have equal bands: copies collapse before the shuffle
    met = signed.where("size > 0").select("node", F.explode("bands").alias("band")).distinct()
    hubs = met.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = met.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = connected_components(ties)

    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiled = (
        clusters.join(sizes, "root").withColumn("tile", own).join(classes, "node")
        .select("first", "node", F.col("root").alias("cluster"), "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select("first", "node", "cluster", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    )
    texts = plain.select(first.alias("first"), "text").join(tiled, "first")
    compared = written(
        texts.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
        .select("cluster", "low", "high", "tile", "node", "text")
        .mapInArrow(_compare(n, threshold), "node long, links long, root long"), "linked",
    )
    links = compared.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = connected_components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = groups.join(classes, "node").groupBy("root").agg(F.min("first").alias("top"))
    of_node = groups.join(named, "root").join(links, "node").select("node", "top", "n_links")
    # a table of its own, so that adaptive execution can split the rows of a class with very many copies
    described = written(classes.join(of_node, "node", "left"), "classes")
    top = F.coalesce("top", "first")
    return signed.select("doc_id", "mark", "node").join(described, "node").select(
        "doc_id", "mark", F.col("first")["doc_id"].alias("class_id"), top["doc_id"].alias("group_id"), "class_size",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (first == top).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    Texts without words are copies of each other, too. Of rows that repeat this id and text, one stays.
    """
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"))
    return one_row_each(docs, jaccard_classes(docs, **options).where("kept"), key, F.struct("doc_id", "mark"))


def query(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs).drop("mark")
