"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a reference text. A text is parsed against it from left to right into
the longest phrases that occur in the reference; the language that needs the fewest phrases wins. Phrases are weighed by
the logarithm of the reference's length, so that references of different lengths compare.

The references are a bounded sample of labelled documents: per language the ``SAMPLE_DOCS`` documents with the smallest
hash of their id, up to ``SAMPLE_BYTES`` bytes of normalised text, and ``TOTAL_BYTES`` in all. Everything else covers whole texts of all documents:
letters are lower-cased, other ASCII characters become one space, and the UTF-8 bytes are parsed in pieces of ``PIECE``
bytes, all pieces of a batch side by side, one byte a step for all languages at once.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where nothing could be learned; equal
weights go to the smaller label; a null label teaches nothing; a null id is not held out; rows that repeat an id count
once each; no rows give no rows. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.textops import chunks

SAMPLE_DOCS = 64
SAMPLE_BYTES = 40_000
#: All references together, shared equally: a language's table has at most two states a byte.
TOTAL_BYTES = 400_000
PIECE = 2048
UNKNOWN = "und"
#: Bytes of text parsed side by side.
_TOGETHER = 4_000_000

_BYTE = np.arange(256)
_KEEP = ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_PLAIN = np.where(_KEEP, _BYTE, 32).astype(np.uint8)
_LETTER = re.compile(r"[^\W\d_]")


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (lower case) and single spaces, with the new offsets of the texts."""
    plain = _PLAIN[data]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(plain)]] = True
    return plain[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of the states of a text's suffix automaton; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Parser:
    """The automata of all languages as one table: place of a state plus a symbol gives the place of the next state."""

    def __init__(self, references: dict[str, bytes]):
        self.languages = sorted(references)
        seen = sorted(set(b"".join(references.values())))
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        width = len(seen) + 1  # the last symbol stands for all others and leads nowhere
        tables, self.root, base = [], [], 0
        for language in self.languages:
            moves = suffix_automaton(references[language])
            table = np.full((len(moves), width), -1, np.int32)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    table[state, self.symbol[c]] = base + to * width
            tables.append(table.ravel())
            self.root.append(base)
            base += table.size
        self.end = base  # a state that leads nowhere: what comes next starts a phrase
        self.table = np.concatenate([*tables, np.full(width, -1, np.int32)])
        longest = max([len(r) for r in references.values()], default=2)
        self.weight = np.array([np.log(max(len(references[x]), 2)) / np.log(max(longest, 2)) for x in self.languages])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of phrases of each text (rows) in each language (columns)."""
        length = np.diff(offsets)
        pieces = np.maximum(1, -(-length // PIECE))
        owner = np.repeat(np.arange(len(length)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][owner] + within * PIECE
        size = np.minimum(length[owner] - within * PIECE, PIECE)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        symbols = self.symbol[data]
        root = np.array(self.root, np.int32)[:, None]
        place = np.full((len(root), len(size)), self.end, np.int32)
        count = np.zeros(place.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), side="right")
        for step, n in enumerate(active):
            now = symbols[start[:n] + step]
            to = self.table[place[:, :n] + now]
            starts = to < 0
            count[:, :n] += starts
            fresh = self.table[root + now]  # a symbol that the language does not have is a phrase by itself
            place[:, :n] = np.where(starts, np.where(fresh < 0, self.end, fresh), to)
        return np.stack([np.bincount(owner, row, minlength=len(length)) for row in count], axis=1)


def _references(docs: DataFrame, sample_docs: int, sample_bytes: int) -> dict[str, bytes]:
    """Per language the normalised text of its sample."""
    usable = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        usable.select("doc_id", "lang").withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= sample_docs).select("doc_id", F.col("lang").alias("_lang")).distinct()
    )
    # at most ``sample_docs`` rows per label
    picked = usable.join(F.broadcast(chosen), "doc_id").where("lang = _lang").select(
        "lang", F.substring("text", 1, sample_bytes).alias("text"), F.xxhash64("doc_id").alias("place"), "doc_id"
    )
    texts: dict[str, bytes] = {}
    for row in picked.orderBy("lang", "place", "doc_id", "text").toLocalIterator():
        have = texts.get(row["lang"], b"")
        if len(have) < sample_bytes:
            data = np.frombuffer(row["text"].lower().encode(), np.uint8)
            plain = normalised(data, np.array([0, len(data)]))[0].tobytes().strip()
            texts[row["lang"]] = (have + b" " + plain)[:sample_bytes] if plain else have
    share = TOTAL_BYTES // max(len(texts), 1)
    return {lang: text[:share] for lang, text in texts.items() if text[:share].strip()}


_parsers: dict[int, Parser] = {}


def _parser(references) -> Parser:
    """The parser of a broadcast; a worker builds it once."""
    key = hash(tuple(sorted(references.value.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(references.value)
    return _parsers[key]


def _predicted(references):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parser = _parser(references)
            names, scores = [], []
            texts = pc.utf8_lower(batch.column("text").fill_null("").cast(pa.large_string()))
            for first, data, offsets in chunks(texts, _TOGETHER):
                lettered = [bool(_LETTER.search(t or "")) for t in batch.column("text").slice(first, len(offsets) - 1).to_pylist()]
                if not parser.languages:
                    names += [UNKNOWN] * len(lettered)
                    scores += [0.0] * len(lettered)
                    continue
                cost = parser.phrases(*normalised(data, offsets)) * parser.weight
                best = cost.argmin(axis=1)
                least = cost[np.arange(len(best)), best]
                # each phrase more halves a language's share
                share = 1 / np.exp2(-(cost - least[:, None])).sum(axis=1)
                names += [parser.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores += np.where(lettered, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
            ], names=["doc_id", "held_out", "lang_pred", "score"])

    return read


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    references = docs.sparkSession.sparkContext.broadcast(_references(docs, sample_docs, sample_bytes))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(_predicted(references), "doc_id long, held_out boolean, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    return identify(docs)
