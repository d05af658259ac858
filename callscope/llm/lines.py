"""Line dedup: a line found in several documents stays only in the one with the smallest id.

A line's key is the line without white space at its ends, with A-Z lower-cased; keys of fewer than ``MIN_POINTS`` code
points are left alone. Keys become 128-bit hashes. Per shard of the hashes, a minimal perfect hash over the distinct keys
indexes three arrays: a 32-bit fingerprint, the number of documents, and the owner (the smallest id). Documents probe
these arrays with the hashes of their lines; lines are never joined, and only hashes and ids are shuffled.

Probes are collapsed per batch of documents (a key with the ids that hold it), and they stream through the task that
holds a shard's arrays behind a sort, so memory is that of the arrays however many documents share a line. A shard's
arrays are copied ``SPLITS`` times and its probes spread over the copies, so a very common line is spread, too.

Defined results: a null text is one empty line; white space and short lines never count; documents without an id
count as one document with the largest id (their rows are found again by a hash of their text, so they are no hot key);
rows that repeat an id are one document, too; no rows give no rows. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.perfecthash import PerfectHash, build
from callscope.plans.storage import written

MIN_POINTS = 10
#: Distinct lines of a shard, about: there are at least as many shards as that takes.
SHARD_KEYS = 5_000_000
#: Copies of a shard's arrays over which its probes are spread.
SPLITS = 4
_SPACE = b" \t\n\x0b\x0c\r"
_LAST = np.iinfo(np.int64).max


def _key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(_SPACE)
    if len(key) < MIN_POINTS or (len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS):
        return None
    return key.lower()  # of bytes: A-Z only


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, part, unnamed, ids): each key of a batch with the documents that hold it, those without an id (by their mark) apart."""
    for batch in batches:
        holders: dict[tuple[bool, bytes], list[int]] = {}
        ids, marks = batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("mark").to_pylist()
        for doc, mark, text in zip(ids, marks, _texts(batch)):
            for key in {k for line in text.split(b"\n") if (k := _key(line)) is not None}:
                holders.setdefault((doc is None, xxhash.xxh3_128_digest(key)), []).append(mark if doc is None else doc)
        both = np.frombuffer(b"".join(key for _, key in holders), dtype=">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
        part = hash(ids[0] or marks[0] or 0) % SPLITS if ids else 0
        yield pa.RecordBatch.from_arrays([
            pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.full(len(both), part, np.int32)),
            pa.array([unnamed for unnamed, _ in holders], pa.bool_()), pa.array([sorted(set(v)) for v in holders.values()], pa.list_(pa.int64())),
        ], names=["hi", "lo", "part", "unnamed", "ids"])


def _shard_arrays(keys, pdf):
    """One row: the perfect hash of a shard's keys and the arrays it indexes."""
    hi, lo = (pdf[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
    sizes, packed = build(hi, lo)
    at = PerfectHash(sizes, packed).index(hi, lo)
    prints, counts, owners = np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.int32), np.zeros(len(hi), np.int64)
    prints[at] = (lo >> np.uint64(32)).astype(np.uint32)
    counts[at] = np.minimum(pdf["docs"].to_numpy(), np.iinfo(np.int32).max)
    owners[at] = pdf["owner"].to_numpy()
    import pandas as pd

    return pd.DataFrame({
        "shard": [int(keys[0])], "sizes": [np.array(sizes, np.int64)], "bits": [packed],
        "prints": [prints.tobytes()], "counts": [counts.tobytes()], "owners": [owners.tobytes()],
    })


_INDEX = "shard int, sizes array<long>, bits binary, prints binary, counts binary, owners binary"
_PROBE = "hi long, lo long, ids array<long>"


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, part) with the arrays first: (id, unnamed, hi, lo) of each line to drop."""
    arrays, current = None, None
    for batch in batches:
        shard, part = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
        edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
        bits = batch.column("bits")
        for low, high in zip([0, *edges], [*edges, len(shard)]):
            if low == high:
                continue
            if (shard[low], part[low]) != current:
                current = (shard[low], part[low])
                assert bits[low].is_valid, "a shard's arrays come before its probes"
                row = {c: batch.column(c)[int(low)].as_py() for c in ("sizes", "bits", "prints", "counts", "owners")}
                arrays = (
                    PerfectHash(row["sizes"], row["bits"]), np.frombuffer(row["prints"], np.uint32),
                    np.frombuffer(row["counts"], np.int32), np.frombuffer(row["owners"], np.int64),
                )
                low += 1
            if low == high:
                continue
            hasher, prints, counts, owners = arrays
            rows = batch.slice(low, high - low)
            hi, lo = (rows.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            at = hasher.index(hi, lo)
            known = (at >= 0) & (prints[at] == (lo >> np.uint64(32)).astype(np.uint32)) & (counts[at] > 1)
            if not known.any():
                continue
            hits = np.flatnonzero(known)
            ids = rows.column("ids").take(pa.array(hits))
            held = np.repeat(hits, ids.value_lengths().to_numpy())
            docs, unnamed = ids.flatten().to_numpy(), rows.column("unnamed").to_numpy(zero_copy_only=False)[held].astype(bool)
            drop = np.where(unnamed, _LAST, docs) != owners[at[held]]
            yield pa.RecordBatch.from_arrays([
                pa.array(docs[drop]), pa.array(unnamed[drop]), pa.array(hi[held[drop]].view(np.int64)), pa.array(lo[held[drop]].view(np.int64)),
            ], names=["id", "unnamed", "hi", "lo"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, dropped, texts = [], [], []
        drops = zip(batch.column("his").to_pylist(), batch.column("los").to_pylist())
        for text, (his, los) in zip(_texts(batch), drops):
            lines = text.split(b"\n")
            total.append(len(lines))
            if his:
                gone = set(zip(his, los))

                def stays(line: bytes, gone=gone) -> bool:
                    key = _key(line)
                    if key is None:
                        return True
                    d = xxhash.xxh3_128_digest(key)
                    return (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) not in gone

                lines = [line for line in lines if stays(line)]
            dropped.append(total[-1] - len(lines))
            texts.append(b"\n".join(lines))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
            pa.array(texts, pa.binary()).cast(pa.string()),
        ], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def drop_repeated_lines(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("mark", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    probes = written(rows.mapInArrow(_probes, "hi long, lo long, part int, unnamed boolean, ids array<long>"), "line-probes")
    keys = probes.agg(F.approx_count_distinct("hi").alias("n")).first()["n"]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // shard_keys))
    shard = F.pmod("hi", F.lit(shards)).cast("int").alias("shard")
    # repeated rows of one id are one document: count ids by their smallest and largest
    named = lambda place: F.when(F.col("unnamed"), F.lit(int(_LAST))).otherwise(F.element_at("ids", place))
    distinct = probes.groupBy("hi", "lo").agg(
        F.min(named(1)).alias("owner"), F.max(named(-1)).alias("last"),
        F.sum(F.size("ids")).alias("n"),
    ).select(shard, "hi", "lo", "owner", F.when(F.col("owner") == F.col("last"), 1).otherwise(F.greatest("n", F.lit(2))).alias("docs"))
    index = distinct.groupBy("shard").applyInPandas(_shard_arrays, _INDEX)
    copies = index.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("part"),
        F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("boolean").alias("unnamed"), F.lit(None).cast("array<long>").alias("ids"),
    )
    stream = copies.unionByName(probes.select(shard, "part", "hi", "lo", "unnamed", "ids"), allowMissingColumns=True)
    stream = stream.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("bits").isNull())
    drops = (
        stream.mapInArrow(_probed, "id long, unnamed boolean, hi long, lo long")
        .groupBy("id", "unnamed").agg(F.collect_list("hi").alias("his"), F.collect_list("lo").alias("los"))
    )
    found = (F.coalesce(rows["doc_id"], rows["mark"]) == drops["id"]) & (rows["doc_id"].isNull() == drops["unnamed"])
    joined = rows.join(drops, found, "left").select(rows["doc_id"], "text", "his", "los")
    return joined.mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, kept_text string")


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def query(docs: DataFrame) -> DataFrame:
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH rows AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM rows),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owned AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT keyed.doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner <> keyed.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (owner IS NULL OR owner = keyed.doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN owned ON keyed.key = owned.key
GROUP BY keyed.doc_id
"""
