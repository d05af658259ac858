"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Units are the bytes of the UTF-8 text, upper and lower case apart, ``ORDER`` bytes to an n-gram; every language has its
own model. A text is preceded by ``ORDER`` - 1 spaces, so each of its bytes ends one n-gram.

The model is trained on all trusted documents: those with a label of good quality that is not toxic. Its tables (n-grams,
contexts and continuation counts of every order) are sharded by n-gram and joined on it, order by order; the result has
an entry per n-gram with its probability and, where it is a context, the weight of shorter ones. For scoring, documents
are dealt into blocks by id and text. A block asks for each of its distinct n-grams once; these requests are sharded by n-gram,
joined with the entries, and go back to the block, where the probabilities of its documents' bytes are put together.
Nothing of the corpus is collected or broadcast, and a very frequent n-gram costs a block one row.

Discounts come from the counts of counts per language and order. A document is rejected if its log-perplexity lies above
a threshold of its language and length class (powers of four bytes): the median of the trusted documents there plus
``SPREAD`` times the distance from the median to the ``HIGH`` quantile. Both are taken out of training: trusted documents
are dealt into two folds by a hash of the text, and each is judged by a model of the other fold. A class with fewer than
``FEW`` trusted documents takes the limit of all trusted documents of its language. Documents of a language with fewer
than ``FEW_OF_LANGUAGE`` trusted documents, or with none in a fold, have the perplexity and the limits of all trusted text.

Defined results: null texts are empty, have no n-grams, perplexity null, and are kept; null languages form one language;
rows that repeat an id and text are scored alike, in one block; a document labelled twice is trusted if any label trusts it;
no rows give no rows; without trusted text all is kept; if all trusted text is in one fold the limit is a perplexity of 256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.columns import fresh
from callscope.plans.storage import written

ORDER = 4
HIGH = 0.99
#: Of 1, 1.25, 1.5, 2 and 3 the one that rejects nearest to 1 - ``HIGH`` of clean documents out of training and limits (sf0.1).
SPREAD = 1.5
#: So many trusted documents make a length class of its own.
FEW = 50
#: So many give a language a model of its own, if there are some in each fold.
FEW_OF_LANGUAGE = 5
#: A block holds about so much text: the more, the fewer requests; a task reads it compressed.
BLOCK_BYTES = 16_000_000
#: Bytes of text whose n-grams a task holds at a time.
STEP = 500_000
# A key: 28 bits of the language's hash, 3 bits of the order, the bytes.
_ORDER_AT, _LANGUAGE_AT = 32, 35
_LANGUAGES = 1 << 28
# The lowest two bits of a language: 0 for the model of all its trusted text, 1 + f for the one without fold f.
_FOLDS = 2
#: The language of all trusted text.
_WIDE = 0


def _keys(text: bytes, language: int) -> np.ndarray:
    """The n-grams of a text as keys of the full order."""
    data = np.frombuffer(b" " * (ORDER - 1) + text, np.uint8).astype(np.int64)
    n = len(text)
    key = np.full(n, (language << 3) | ORDER, np.int64)
    for i in range(ORDER):
        key = (key << 8) | data[i : i + n]
    return key


def shorter(key, k: int):
    """Of keys of order k the last k - 1 bytes, as keys of that order."""
    bytes_ = key & ((1 << (8 * (k - 1))) - 1)
    return (key >> _LANGUAGE_AT << _LANGUAGE_AT) | ((k - 1) << _ORDER_AT) | bytes_


def context(key, k: int):
    """Of keys of order k the first k - 1 bytes, as keys of that order."""
    bytes_ = (key & ((1 << (8 * k)) - 1)) >> 8
    return (key >> _LANGUAGE_AT << _LANGUAGE_AT) | ((k - 1) << _ORDER_AT) | bytes_


def _pieces(texts: Iterator[tuple[int, bytes, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their keys one after the other, first key of each row and the total) of (row, text, language)."""
    rows, keys, size = [], [], 0
    for row, text, language in texts:
        for low in range(0, max(len(text), 1), STEP):  # a very long text comes in pieces, each with the bytes before it
            found = _keys(text, language) if len(text) <= STEP else _keys_from(text, language, low)
            rows.append(row)
            keys.append(found)
            size += len(found)
            if size >= STEP:
                yield np.array(rows), np.concatenate(keys), np.cumsum([0, *map(len, keys)])
                rows, keys, size = [], [], 0
    if rows:
        yield np.array(rows), np.concatenate(keys), np.cumsum([0, *map(len, keys)])


def _keys_from(text: bytes, language: int, low: int) -> np.ndarray:
    before = text[max(0, low - ORDER + 1) : low]
    return _keys(before + text[low : low + STEP], language)[len(before) :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, count) of trusted texts in each model they train, summed within a batch."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        own = zip(texts, batch.column("languages").to_pylist())
        rows = ((i, t or b"", lang) for i, (t, languages) in enumerate(own) for lang in languages)
        grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, keys, _ in _pieces(rows):
            own, times = np.unique(keys, return_counts=True)
            grams, where = np.unique(np.concatenate([grams, own]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, times]), minlength=len(grams)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "count"])


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a batch by block: one compressed row per block."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        batch = batch.take(pa.array(order))
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks[order])) + 1, [len(order)]])
        spans = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if a < b]

        def lists(column, kind):
            return pa.array([column[a:b] for a, b in spans], pa.list_(kind))

        yield pa.RecordBatch.from_arrays([
            pa.array([int(blocks[order[a]]) for a, _ in spans], pa.int32()),
            *[lists(batch.column(c).to_pylist(), t) for c, t in (("doc_id", pa.int64()), ("mark", pa.int64()), ("language", pa.int32()))],
            lists([len(t) for t in texts], pa.int64()),
            pa.array([pack(b"".join(texts[a:b])) for a, b in spans], pa.binary()),
            pa.array([[]] * len(spans), pa.list_(pa.int64())),
        ], names=_FRAME_NAMES)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trusted ids of a batch by block: frames without documents."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        blocks, ids = (batch.column(c).to_numpy() for c in ("block", "doc_id"))
        order = np.argsort(blocks, kind="stable")
        own, first = np.unique(blocks[order], return_index=True)
        none = [[]] * len(own)
        yield pa.RecordBatch.from_arrays([
            pa.array(own, pa.int32()), *[pa.array(none, pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())],
            pa.array([pack(b"")] * len(own), pa.binary()),
            pa.array(np.split(ids[order], first[1:]), pa.list_(pa.int64())),
        ], names=_FRAME_NAMES)


_FRAMES = "block int, ids array<long>, marks array<long>, languages array<int>, sizes array<long>, packed binary, trusted array<long>"
_FRAME_NAMES = [column.split()[0] for column in _FRAMES.split(", ")]


def _models(frames: pd.DataFrame, wide: bool) -> list[list[int]]:
    """The models of each document of a block: its language's, and for trusted ones those without their fold."""
    trusted = {int(x) for xs in frames["trusted"] for x in xs}
    out = []
    for block, ids, languages in zip(frames["block"], frames["ids"], frames["languages"]):
        held = 1 + int(block) % _FOLDS
        for i, own in zip(ids, languages):
            more = {int(own) + held, *([_WIDE + held] if wide else [])} if i in trusted else ()
            out.append([int(own), *more])
    return out


def _texts(frames: pd.DataFrame, models: list[list[int]]) -> Iterator[tuple[int, bytes, int]]:
    """(row, text, language) of a block's documents in order, a row for each of a document's models."""
    unpack = zstandard.ZstdDecompressor().decompress
    row, models = 0, iter(models)
    for packed, sizes in zip(frames["packed"], frames["sizes"]):
        data, at = unpack(packed), 0
        for size in sizes:
            for language in next(models):
                yield row, data[at : at + size], language
                row += 1
            at += size


def _requests(frames: pd.DataFrame, wide: bool) -> pd.DataFrame:
    """The distinct n-grams of a block and all shorter ones that their probabilities may come from."""
    grams = np.zeros(0, np.int64)
    for _, keys, _ in _pieces(_texts(frames, _models(frames, wide))):
        grams = np.union1d(grams, keys)
    found = [grams]
    for k in range(ORDER, 0, -1):
        found.append(np.union1d(shorter(found[-1], k), context(found[-1], k)))
    return pd.DataFrame({"block": np.int32(frames["block"].iloc[0]), "gram": np.concatenate(found)})


def _probabilities(keys: np.ndarray, k: int, grams: np.ndarray, p: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Of distinct keys of order k; an n-gram that the model lacks takes its context's spare weight of the shorter one."""
    if k == 0:
        return np.full(len(keys), 1 / 256)

    def look(wanted, values):
        if not len(grams):
            return np.full(len(wanted), np.nan)
        at = np.minimum(np.searchsorted(grams, wanted), len(grams) - 1)
        return np.where(grams[at] == wanted, values[at], np.nan)

    less, place = np.unique(shorter(keys, k), return_inverse=True)
    below = _probabilities(less, k - 1, grams, p, spare)[place]
    own, weight = look(keys, p), look(context(keys, k), spare)
    return np.where(np.isnan(own), np.where(np.isnan(weight), 1.0, weight) * below, own)


def _scored(frames: pd.DataFrame, answers: pd.DataFrame, wide: bool) -> pd.DataFrame:
    """The sum of log-probabilities of each document of a block, in each of its models."""
    answers = answers.sort_values("gram")
    grams, p, spare = (answers[c].to_numpy() for c in ("gram", "p", "spare"))
    models = _models(frames, wide)
    times = np.array([len(own) for own in models], np.int64)
    size = np.repeat(np.array([x for xs in frames["sizes"] for x in xs], np.int64), times)
    total = np.zeros(len(size))
    for rows, keys, first in _pieces(_texts(frames, models)):
        own, place = np.unique(keys, return_inverse=True)
        logs = np.log(_probabilities(own, ORDER, grams, p.astype(float), spare.astype(float)))
        values = np.concatenate([[0.0], np.cumsum(logs[place])])
        np.add.at(total, rows, values[first[1:]] - values[first[:-1]])
    flat = lambda c: pd.array([x for xs in frames[c] for x in xs], "Int64").repeat(times)
    own = pd.array([x for xs in models for x in xs], "Int32")
    return pd.DataFrame({"doc_id": flat("ids"), "mark": flat("marks"), "language": own, "n_grams": size, "logp": total})


def _model(counts: DataFrame) -> DataFrame:
    """(gram, p, spare) of the model of full-order (gram, count): joins on n-grams, order by order.

    ``p`` is an n-gram's probability after its context, ``spare`` what is left to shorter ones after it as a context.
    """
    key = F.col("gram")
    top = F.shiftleft(F.shiftright(key, _LANGUAGE_AT), _LANGUAGE_AT)

    def low(k: int) -> Column:
        return key.bitwiseAND(F.lit((1 << (8 * k)) - 1).cast("long"))

    def tagged(k: int, bytes_: Column) -> Column:
        return top.bitwiseOR(F.lit(k << _ORDER_AT).cast("long")).bitwiseOR(bytes_)

    of_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        # continuation counts: how many different bytes stand before an n-gram
        of_order[k] = of_order[k + 1].groupBy(tagged(k, low(k)).alias("gram")).agg(F.count(F.lit(1)).alias("count"))
    entries, p, c = None, None, F.col("count")
    for k in range(1, ORDER + 1):
        tallies = of_order[k].groupBy(top.alias("language")).agg(
            *[F.sum(F.when(c == i, 1).otherwise(0)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
        )
        y = F.when(F.col("t1") + 2 * F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)

        def discount(i: int, y=y) -> Column:
            some, more = F.col(f"t{i}"), F.col(f"t{i + 1}")
            value = F.when(some > 0, i - (i + 1) * y * more / some).otherwise(F.lit(0.5 * i))
            # counts of counts of small corpora can give odd values
            return F.least(F.greatest(value, F.lit(0.1)), F.lit(i - 0.1 if i > 1 else 0.9))

        cuts = tallies.select("language", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        before = tagged(k - 1, F.shiftright(low(k), 8)).alias("context")
        seen = of_order[k].select("gram", "count", before, top.alias("language"))
        contexts = seen.groupBy("context").agg(
            F.any_value("language").alias("language"), F.sum("count").cast("double").alias("total"),
            *[F.sum(F.when(test, 1).otherwise(0)).alias(f"n{i}") for i, test in ((1, c == 1), (2, c == 2), (3, c >= 3))],
        )
        spare = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")
        contexts = contexts.join(cuts, "language").select("context", "total", "d1", "d2", "d3", spare.alias("spare"))
        rows = seen.join(contexts, "context")
        if k == 1:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("less", tagged(k - 1, low(k - 1))).join(p.select(key.alias("less"), F.col("p").alias("below")), "less")
        cut = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        own = rows.select("gram", (F.greatest(c - cut, F.lit(0.0)) / F.col("total") + F.col("spare") * F.col("below")).alias("p"))
        p = written(own, f"model-{k}")  # the next order joins it; cuts a long plan
        both = p.select("gram", "p", F.lit(None).cast("double").alias("spare")).unionAll(
            contexts.select(F.col("context").alias("gram"), F.lit(None).cast("double"), "spare")
        )
        entries = both if entries is None else entries.unionAll(both)
    return entries.groupBy("gram").agg(F.max("p").alias("p"), F.max("spare").alias("spare"))


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id"))


def dealt_out(docs: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id, mark, language, fold, text of every document, in ``blocks`` blocks for each fold.

    Blocks go by id and text, so an id that very many rows share is dealt too. A block has one fold: it asks one model without it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id, mark, fold = F.col("doc_id").cast("long"), F.xxhash64(text, "lang"), F.pmod(F.xxhash64(text), F.lit(_FOLDS)).cast("int")
    language = F.shiftleft(F.pmod(F.xxhash64("lang"), F.lit((_LANGUAGES >> 2) - 1)) + 1, 2).cast("int")
    return docs.select(
        (F.pmod(F.xxhash64(doc_id, mark), F.lit(blocks)) * _FOLDS + fold).cast("int").alias("block"), doc_id.alias("doc_id"),
        mark.alias("mark"), language.alias("language"), fold.alias("fold"), text.alias("text"),
    )


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of text and language), language (a model), n_grams, logp (sum) of every document.

    A trusted document has more rows, of models that lack its fold.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fold, language = F.col("fold"), F.col("language")
    plain = dealt_out(docs, max(1, -(-size // (BLOCK_BYTES * _FOLDS))))
    # of the texts only those that may be trusted move: Spark filters the scan by a Bloom filter of the labels' ids
    trusted = plain.select("block", "doc_id", "language", "fold", "text").join(_trusted(labels), "doc_id", "left_semi")
    known = trusted.where("text != ''").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("folds"))
    known = written(known.where((F.col("n") >= FEW_OF_LANGUAGE) & (F.col("folds") == _FOLDS)).select("language", F.lit(True).alias("known")), "languages")
    # no document needs the model of all trusted text if each has a language's
    wide = not plain.select("language").distinct().join(known, "language", "left_anti").isEmpty()
    trained = F.array(*[x for own in [language, F.lit(_WIDE)][: 1 + wide] for x in (own, *[F.when(fold != f, own + 1 + f) for f in range(_FOLDS)])])
    counts = trusted.select(F.array_compact(trained).alias("languages"), "text").mapInArrow(_counted, "gram long, count long")
    model = written(_model(written(counts.groupBy("gram").agg(F.sum("count").alias("count")), "grams")), "model")
    names = trusted.select("block", "doc_id").mapInArrow(_named, _FRAMES)  # ids only: their texts do not move again
    own = F.when(F.col("known"), language).otherwise(F.lit(_WIDE)).alias("language")
    rows = plain.join(known, "language", "left") if wide else plain.withColumn("known", F.lit(True))
    rows = rows.select("block", "doc_id", "mark", own, "text").mapInArrow(_framed, _FRAMES)
    # both reads of the frames share one shuffle
    framed = rows.unionAll(names).groupBy("block")
    requests = framed.applyInPandas(lambda frames: _requests(frames, wide), "block int, gram long")
    answers = requests.join(model, "gram").select("block", "gram", "p", "spare")
    return framed.cogroup(answers.groupBy("block")).applyInPandas(
        lambda frames, answers: _scored(frames, answers, wide), "doc_id long, mark long, language int, n_grams long, logp double"
    )


def classify(docs: DataFrame, labels: DataFrame, high: float = HIGH, spread: float = SPREAD) -> DataFrame:
    """doc_id, mark, n_grams, perplexity, threshold (a perplexity, or null), kept of every document."""
    fold = F.col("language").bitwiseAND(F.lit(3))
    scored = written(score(docs, labels), "scored").withColumn(
        "loss", F.when(F.col("n_grams") > 0, -F.col("logp") / F.col("n_grams"))
    ).withColumn("class", F.floor(F.log2(F.col("n_grams") + 1) / 2).cast("int")).withColumn("fold", fold)
    known = scored.where("fold > 0 and loss is not null").withColumn("language", F.col("language") - fold)

    def limits(*by: str) -> DataFrame:
        middle, top = (F.percentile_approx("loss", F.lit(q), F.lit(10000)) for q in (0.5, high))
        return known.groupBy(*by).agg((middle + spread * (top - middle)).alias(f"limit{len(by)}"), F.count(F.lit(1)).alias(f"n{len(by)}"))

    rows = scored.where("fold = 0").join(limits("language", "class").where(F.col("n2") >= FEW), ["language", "class"], "left")
    rows = rows.join(limits("language"), "language", "left").withColumn("limit", F.coalesce("limit2", "limit1"))
    return rows.select(
        "doc_id", "mark", "n_grams", F.exp("loss").alias("perplexity"), F.exp("limit").alias("threshold"),
        F.coalesce(F.col("loss") <= F.col("limit"), F.lit(True)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    bad = classify(docs, labels, **options).where("not kept").select(F.struct("doc_id", "mark").alias("_key")).distinct()
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), "lang").alias("mark"))
    name = fresh(docs, "key")
    rows = docs.withColumn(name, key).join(bad.select(F.col("_key").alias(name)), name, "left_anti")
    return rows.select(*[f"`{c}`" for c in docs.columns])


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).select("doc_id", "n_grams", "perplexity", "threshold", "kept")
