"""Vector code compression: vectors cut into parts, each part replaced by the number of its codebook's nearest entry.

Components become whole numbers, floor(4096 * x), so sums and distances are exact and do not depend on the order of rows.
A codebook starts as that part of the smallest ids' vectors; each round assigns all parts and moves every entry to the
mean of its parts, rounded down.

Nearest entries are found by LAESA. A few fixed pivots per part, chosen far apart among the first entries, never move;
each part's distances to them are computed once and stored beside it. A round computes the distances between pivots and
entries only. The largest difference of the two over the pivots is a lower bound of the distance between part and
entry (triangle inequality). Entries are tried by increasing bound, in exact whole numbers, and as soon as a bound
exceeds the best distance found, no other entry of the part is tried. Bounds are lowered by more than the rounding of
the stored distances, so no entry is lost, ties included.

Vectors stay where they are: a round reads the table of parts and shuffles one row per task, part and entry. Codebooks
(parts * entries * length of a part numbers) are all that reaches the driver and is broadcast.

Defined results: vectors that are null or empty, hold a null or a number that is not finite, whose length differs from
the smallest kept id's, or is no multiple of the number of parts, are dropped; null ids come last, and rows that repeat
an id are vectors of their own, ordered by their components; with fewer vectors than entries there are fewer entries;
null labels are one label; no vectors give no rows. Extra columns are left alone. Sums stay exact while scaled
components are below 2**27 (numbers below 32,768); larger ones raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.plans.storage import written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Fixed pivots per part.
PIVOTS = 4
#: Vectors a task handles at a time.
CHUNK = 4096
_LARGEST = 1 << 27
#: More than the relative error of a stored distance (four bytes).
_SLACK = 4e-7


class Codebooks(NamedTuple):
    """Entries and pivots per part, and the distances between them."""

    entries: np.ndarray  # part, entry, position
    pivots: np.ndarray  # part, pivot, position
    apart: np.ndarray  # part, entry, pivot

    @classmethod
    def of(cls, entries: np.ndarray, pivots: np.ndarray) -> Codebooks:
        return cls(entries, pivots, np.stack([_distances(e, p) for e, p in zip(entries, pivots)]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Per part, entries far apart: each next one has the greatest sum of distances to those chosen before."""
    out = []
    for own in entries:
        apart, chosen = _distances(own, own), [0]
        while len(chosen) < min(count, len(own)):
            total = apart[chosen].sum(axis=0)
            total[chosen] = -1
            chosen.append(int(total.argmax()))
        out.append(own[chosen])
    return np.stack(out)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry of each row, the smaller number on ties; squared distance; distances evaluated)."""
    a, b = to_pivots[:, None, :], apart[None, :, :]
    bound = np.maximum((np.abs(a - b) - _SLACK * (a + b)).max(axis=2), 0.0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.full(len(x), len(entries))
    rows, evaluated = np.arange(len(x)), 0
    for k in range(len(entries)):
        entry = order[rows, k]
        near = bound[rows, entry] <= best[rows]  # bounds grow and the best distance falls: who is out stays out
        rows, entry = rows[near], entry[near]
        if not len(rows):
            break
        evaluated += len(rows)
        distance = ((x[rows] - entries[entry]) ** 2).sum(axis=1)
        better = (distance < best[rows]) | ((distance == best[rows]) & (entry < found[rows]))
        best[rows[better]], found[rows[better]] = distance[better], entry[better]
    return found, best, evaluated


def _vectors(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(vector, part, position) whole numbers of a batch."""
    flat = batch.column(batch.schema.get_field_index("parts")).flatten().to_numpy().astype(np.int64)
    if len(flat) and np.abs(flat).max() >= _LARGEST:
        raise ValueError(f"a component is too large for exact sums: {np.abs(flat).max()} after scaling")
    return flat.reshape(batch.num_rows, parts, -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, CHUNK):
            yield batch.slice(low, CHUNK)


def _measured(pivots: np.ndarray):
    """A reader of (vec_id, label, parts) that adds each part's distances to its pivots, part by part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            x = _vectors(batch, len(pivots))
            far = np.stack([_distances(x[:, p], pivots[p]) for p in range(len(pivots))], axis=1).astype(np.float32)
            width = far.shape[1] * far.shape[2]
            flat = pa.array(far.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "far"])

    return read


def _assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, entry of each part, squared distance of each part) of a batch."""
    parts, pivots = books.pivots.shape[:2]
    x = _vectors(batch, parts)
    far = batch.column(batch.schema.get_field_index("far")).flatten().to_numpy().astype(np.float64).reshape(len(x), parts, pivots)
    found = [nearest(x[:, p], far[:, p], books.entries[p], books.apart[p])[:2] for p in range(parts)]
    return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _summed(books):
    """A reader of the measured parts that writes one row (part, entry, n, sums) per part and used entry."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        parts, entries, length = own.entries.shape
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, length), np.int64)
        for batch in _pieces(batches):
            x, entry, _ = _assigned(batch, own)
            place = (entry + np.arange(parts) * entries).ravel()
            order = np.argsort(place, kind="stable")
            used, first = np.unique(place[order], return_index=True)
            sums[used] += np.add.reduceat(x.reshape(-1, length)[order], first, axis=0)
            n += np.bincount(place, minlength=len(n))
        used = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * length), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used // entries), pa.array(used % entries), pa.array(n[used]), lists], names=["part", "entry", "n", "sums"]
        )

    return read


def _coded(books):
    """A reader of the measured parts that writes (vec_id, label, code, error)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            _, entry, distance = _assigned(batch, books.value)
            codes = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))],
                names=["vec_id", "label", "code", "error"],
            )

    return read


def whole_parts(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the components as whole numbers (``parts``) of the vectors without nulls and infinities."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))
    sound = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.forall("embedding", finite))
    scaled: Column = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), "label", scaled.alias("parts"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks] | None:
    """(the measured parts, as a written table; the codebooks after the last round); None without vectors."""
    spark = vectors.sparkSession
    whole = whole_parts(vectors)
    by_id = [F.asc_nulls_last("vec_id"), F.asc("parts")]
    head = whole.where(F.size("parts") % parts == 0).orderBy(*by_id).limit(1).select(F.size("parts").alias("n")).first()
    if head is None:
        return None
    kept = whole.where(F.size("parts") == head["n"])
    first = np.array([r["parts"] for r in kept.orderBy(*by_id).limit(entries).select("parts").collect()], np.int64)
    start = first.reshape(len(first), parts, -1).transpose(1, 0, 2)
    if np.abs(start).max() >= _LARGEST:
        raise ValueError(f"a component is too large for exact sums: {np.abs(start).max()} after scaling")
    books = Codebooks.of(start, choose_pivots(start))
    label = kept.schema["label"].dataType.simpleString()
    measured = written(
        kept.mapInArrow(_measured(books.pivots), f"vec_id long, label {label}, parts array<long>, far array<float>"), "parts"
    )
    length = start.shape[2]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = (
            measured.mapInArrow(_summed(sent), "part long, entry long, n long, sums array<long>").groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(length)]).alias("sums"))
            .collect()  # one row for each part and entry
        )
        sent.destroy()
        moved = books.entries.copy()
        for row in sums:
            moved[row["part"], row["entry"]] = np.array(row["sums"], np.int64) // row["n"]
        if (moved == books.entries).all():
            break  # further rounds would change nothing
        books = Codebooks.of(moved, books.pivots)
    return measured, books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks] | None:
    """((vec_id, label, code, error) of every kept vector, as a written table; the codebooks); None without vectors."""
    trained = train(vectors, parts, entries, rounds)
    if trained is None:
        return None
    measured, books = trained
    label = measured.schema["label"].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    coded = written(measured.mapInArrow(_coded(sent), f"vec_id long, label {label}, code string, error long"), "codes")
    sent.destroy()
    return coded, books


def decode(code: Column, books: Codebooks) -> Column:
    """The components that a code stands for, as numbers of the original scale."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(c)) for c in entry]) for entry in part]) for part in books.entries])
    places = F.sequence(F.lit(0), F.lit(len(books.entries) - 1))
    entry = lambda p: F.conv(F.substr(code, p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    whole = F.flatten(F.transform(places, lambda p: F.get(F.get(table, p), entry(p))))
    return F.transform(whole, lambda c: c / SCALE)


def query(vectors: DataFrame) -> DataFrame:
    found = compress(vectors)
    if found is None:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        )
    coded, books = found
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    # few rows: a label's errors are added up before the shuffle; adaptive execution splits the rows of a hot label
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _oracle() -> str:
    steps = [f"""
WITH comps AS MATERIALIZED (
  SELECT r, vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos, len(embedding) AS d
  FROM (SELECT row_number() OVER () AS r, * FROM embeddings)),
kept AS MATERIALIZED (SELECT r FROM comps GROUP BY r HAVING count(*) = count(x) AND bool_and(isfinite(x))),
parts AS MATERIALIZED (
  SELECT r, vec_id, label, pos // (d // {PARTS}) AS part, pos % (d // {PARTS}) AS place,
         CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS c
  FROM comps SEMI JOIN kept USING (r)),
book0 AS MATERIALIZED (
  SELECT entry, part, place, c FROM parts JOIN (
    SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT r, vec_id FROM parts)) USING (r)
  WHERE entry < {ENTRIES})"""]

    def near(k: int) -> str:
        return f"""
near{k} AS MATERIALIZED (
  SELECT r, part, entry, distance FROM (
    SELECT r, part, entry, distance, row_number() OVER (PARTITION BY r, part ORDER BY distance, entry) AS n
    FROM (SELECT p.r, part, entry, CAST(sum((p.c - b.c) * (p.c - b.c)) AS BIGINT) AS distance
          FROM parts p JOIN book{k} b USING (part, place) GROUP BY ALL))
  WHERE n = 1)"""

    for k in range(ROUNDS):
        steps += [near(k), f"""
mean{k} AS MATERIALIZED (
  SELECT part, entry, place, CAST((total - ((total % n) + n) % n) // n AS BIGINT) AS c
  FROM (SELECT part, entry, place, sum(c) AS total, count(*) AS n FROM parts JOIN near{k} USING (r, part) GROUP BY ALL))""", f"""
book{k + 1} AS MATERIALIZED (
  SELECT entry, part, place, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, place))"""]
    return ",".join([*steps, near(ROUNDS)]) + f""",
rows AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
FROM rows JOIN (SELECT DISTINCT r, vec_id, label FROM parts) USING (r)
"""


ORACLE = _oracle()
