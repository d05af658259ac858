"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

An item is a question and an answer, its last line. Both are cut into parts of at most ``PART`` shingles, which are the
index's entries. A document is read in passages of ``PASSAGE`` words that overlap by half, so every part that a document
holds in one piece lies in one passage. A passage is a query of its distinct words. An entry is retrieved if its score
reaches its threshold: the score of the whole part less its heaviest words, as many as may be missing.

How many that is follows from what a leak is: 80 % of the shingles of question and answer, standing together or
anywhere in the document. Then one of the parts holds that share, too; if the answer has at most half as many shingles as the
question, only the question's parts are entries (a short answer would be in every document) and its share is lowered by
what the answer can add; and the other way round. So question and answer may stand any number of words apart. Only a
part that is itself torn into pieces in different passages can be missed.

Retrieval is block-max WAND on arrays. Words that many entries share cannot reach a threshold alone: their total is
taken off the threshold, and only the rarer words are looked up. Entries stand in blocks, and a word has its largest
weight per block; blocks whose bound misses their lowest threshold are skipped, and only postings of the others are
scored, exactly. Retrieved items are verified on the shingles of the whole document: at least 80 % of those of question and
answer as one text, or of both counted apart; the overlap of each is reported, too.

Items are taken in shards by a hash, of about ``SHARD_BYTES`` of text, whatever their number. The index of a shard is
broadcast for one pass over the documents, and dropped before that of the next one: between passes the documents
are written. With one shard documents stay where they are, and nothing is shuffled.

Defined results: null or empty texts and items without words match nothing; a side of fewer words than a shingle is
compared as one; repeated items are reported under each id; a null item id is left out; no items or no documents leave
everything clean. Item ids are read as long numbers. Other columns of the documents pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.columns import fresh
from callscope.llm.textops import chunks, shingles, words
from callscope.plans.storage import written

WORDS = 5
OVERLAP = 0.8
PART = 44
PASSAGE = 128
SHARD_BYTES = 8_000_000
BLOCK = 16
_K1, _B = 1.2, 0.75


def _words_of(text: str) -> np.ndarray:
    return np.concatenate([words(data, offsets)[0] for _, data, offsets in chunks(pa.array([text]))])


def _distinct_shingles(hashes: np.ndarray) -> np.ndarray:
    return np.unique(shingles(hashes, np.array([0, len(hashes)]), WORDS)[0])


class _Item(NamedTuple):
    """Shingles of an item as one text, of its question and of its answer, and their numbers of words."""

    item_id: int
    whole: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    question_words: int
    answer_words: int

    @property
    def words(self) -> int:
        return self.question_words + self.answer_words


class _Held:
    """The shingles of one document."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.of_length: dict[int, np.ndarray] = {}

    def share(self, wanted: np.ndarray, count: int) -> float:
        """The part of the shingles that the document holds, of a text of ``count`` words; 0 if there are none."""
        n = min(WORDS, count)
        if not len(wanted) or len(self.hashes) < n:
            return 0.0
        if n not in self.of_length:
            self.of_length[n] = np.unique(shingles(self.hashes, np.array([0, len(self.hashes)]), n)[0])
        seen = self.of_length[n]
        at = np.minimum(np.searchsorted(seen, wanted), len(seen) - 1)
        return float((seen[at] == wanted).mean())


class Index:
    """BM25 entries of some items, as arrays."""

    def __init__(self, items: list[tuple[int, str]], overlap: float = OVERLAP):
        self.overlap = overlap
        self.items, entries = [], []
        for item_id, text in sorted(items):
            question, _, answer = (text or "").rpartition("\n")
            if not question.strip():
                question, answer = answer, ""
            q, a = _words_of(question), _words_of(answer)
            if item_id is None or not len(q) + len(a):
                continue
            sides = [(own, _distinct_shingles(own)) for own in (q, a)]
            self.items.append(_Item(item_id, _distinct_shingles(np.concatenate([q, a])), *[s for _, s in sides], len(q), len(a)))
            total = len(sides[0][1]) + len(sides[1][1])
            # a side that is less than half of the other one is not looked for on its own
            asked = [(own, found) for (own, found), other in zip(sides, sides[::-1]) if len(found) and 2 * len(found) > len(other[1])]
            share = max(0.0, 1 - ((1 - overlap) * total + 1) / sum(len(found) for _, found in asked))
            for own, _ in asked:
                for low in range(0, max(1, len(own) - WORDS + 1), PART):
                    entries.append((len(self.items) - 1, own[low : low + PART + WORDS - 1], share))
        self.item_of = np.array([i for i, _, _ in entries], np.int64)
        self.vocabulary, flat = np.unique(np.concatenate([w for _, w, _ in entries]) if entries else np.zeros(0, np.uint64), return_inverse=True)
        length = np.array([len(w) for _, w, _ in entries])
        owner = np.repeat(np.arange(len(entries)), length)
        # (term, entry) postings with their weight
        key, count = np.unique(flat.astype(np.int64) * max(1, len(entries)) + owner, return_counts=True)
        self.term, self.entry = key // max(1, len(entries)), key % max(1, len(entries))
        df = np.bincount(self.term, minlength=len(self.vocabulary))
        idf = np.log(1 + (len(entries) - df + 0.5) / (df + 0.5))
        norm = _K1 * (1 - _B + _B * length / length.mean()) if len(entries) else np.zeros(0)
        self.weight = idf[self.term] * count * (_K1 + 1) / (count + norm[self.entry])
        # threshold: the whole score less the heaviest words that may be missing
        self.threshold = np.zeros(len(entries))
        order = np.lexsort((-self.weight, self.entry))
        edges = np.searchsorted(self.entry[order], np.arange(len(entries) + 1))
        for e in range(len(entries)):
            own = self.weight[order[edges[e] : edges[e + 1]]]
            missing = int((1 - entries[e][2]) * length[e]) + 1
            self.threshold[e] = max(own[missing:].sum() - 1e-9, own[-1] if len(own) else 0.0) if len(own) > missing else min(own) - 1e-9
        # words that more than a tenth of the entries share: looked up only when an entry is scored
        self.common = df > max(2, 0.1 * len(entries))
        shared = np.bincount(self.entry, self.weight * self.common[self.term], minlength=len(entries))
        self.needed = self.threshold - shared
        # entries whose common words alone could reach the threshold keep all their words in the lookup
        rare = ~self.common[self.term] | (self.needed[self.entry] <= 0)
        self.needed = np.where(self.needed > 0, self.needed, self.threshold)
        self.first, self.posted, self.posted_weight = self._lists(self.term[rare], self.entry[rare], self.weight[rare])
        # block-max lists: per term and block of entries the largest weight, per block the lowest need
        block = self.entry[rare] // BLOCK
        blocks = len(entries) // BLOCK + 1
        pair, place = np.unique(self.term[rare] * blocks + block, return_inverse=True)
        largest = np.zeros(len(pair))
        np.maximum.at(largest, place, self.weight[rare])
        self.block_first, self.block_of, self.block_weight = self._lists(pair // blocks, pair % blocks, largest)
        self.block_needed = np.full(blocks, np.inf)
        np.minimum.at(self.block_needed, np.arange(len(entries)) // BLOCK, self.needed)
        self.blocks = blocks
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.has_list = np.diff(self.first) > 0

    def _lists(self, term, target, weight):
        """Lists by term: (first of each term and the total, targets, weights)."""
        order = np.lexsort((target, term))
        return np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1)), target[order], weight[order]

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are in the vocabulary, their terms)."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        term = np.searchsorted(self.vocabulary, hashes[at])
        term[term == len(self.vocabulary)] = 0
        known = self.vocabulary[term] == hashes[at]
        return at[known], term[known]

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, entry) pairs whose score reaches the entry's threshold, for words of passages."""
        vocabulary = len(self.vocabulary)
        pair = np.unique(passage * vocabulary + term)
        passage, term = pair // vocabulary, pair % vocabulary
        looked = self.has_list[term]
        p, t = passage[looked], term[looked]
        cell, weight = self._expand(p, t, self.block_first, self.block_of, self.block_weight, self.blocks)
        cells, place = np.unique(cell, return_inverse=True)
        bound = np.bincount(place, weight, minlength=len(cells))
        alive = cells[bound >= self.block_needed[cells % self.blocks]]
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = len(self.item_of)
        live = np.isin(p, alive // self.blocks)
        cell, weight = self._expand(p[live], t[live], self.first, self.posted, self.posted_weight, size)
        in_block = np.isin(cell // size * self.blocks + cell % size // BLOCK, alive)
        cells, place = np.unique(cell[in_block], return_inverse=True)
        reached = np.bincount(place, weight[in_block], minlength=len(cells)) >= self.needed[cells % size]
        return cells[reached] // size, cells[reached] % size

    @staticmethod
    def _expand(passage, term, first, target, weight, width):
        length = first[term + 1] - first[term]
        at = np.arange(length.sum()) + np.repeat(first[term] - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(term) else first[:0], length)
        return np.repeat(passage, length) * width + target[at], weight[at]

    def leaks(self, texts: pa.Array) -> list[list[tuple[int, float, float, float]]]:
        """For each text the items it holds: (item id, overlap, question's overlap, answer's overlap)."""
        out: list[list] = [[] for _ in range(len(texts))]
        if not self.items:
            return out
        half = PASSAGE // 2
        for base, data, offsets in chunks(texts):
            hashes, first = words(data, offsets)
            at, term = self.terms(hashes)
            doc = np.searchsorted(first, at, side="right") - 1
            halves = np.diff(first) // half + 1
            start = np.concatenate([[0], np.cumsum(halves + 1)])  # a passage ends in each half, and one after the last
            own = start[doc] + (at - first[doc]) // half
            passage, entry = self.retrieve(np.concatenate([own, own + 1]), np.concatenate([term, term]))
            doc = np.searchsorted(start, passage, side="right") - 1
            hits: dict[int, set[int]] = {}
            for d, item in zip(doc.tolist(), self.item_of[entry].tolist()):
                hits.setdefault(d, set()).add(item)
            for d, items in hits.items():
                held = _Held(hashes[first[d] : first[d + 1]])
                for item in sorted(items):
                    own = self.items[item]
                    whole = held.share(own.whole, own.words)
                    question, answer = held.share(own.question, own.question_words), held.share(own.answer, own.answer_words)
                    sizes = len(own.question), len(own.answer)
                    apart = (question * sizes[0] + answer * sizes[1]) / sum(sizes)
                    if max(whole, apart) >= self.overlap - 1e-12:
                        out[base + d].append((own.item_id, max(whole, apart), question if sizes[0] else 1.0, answer if sizes[1] else 1.0))
        return out


def _shards(items: DataFrame, shard_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Lists of items of about ``shard_bytes`` of text each, by a hash of the item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).first()["n"] or 0
    parts = -(-size // shard_bytes)
    slots = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1))))
    for part in range(parts):
        yield [(r["item_id"], r["text"]) for r in slots.where(F.col("part") == part).collect()]


_FOUND = "array<struct<item_id:long,overlap:double,question:double,answer:double>>"


def find_leaks(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES, name: str = "leaks") -> DataFrame:
    """The documents with a column ``leaks``: the items each holds, by id, with their overlaps."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() != name]
    out = docs.select(*[f"`{c}`" for c in kept], F.array().cast(_FOUND).alias(name))
    index = None
    for part in _shards(items, shard_bytes):
        if index is not None:
            out = written(out, "decontaminated")
            index.destroy()
        index = spark.sparkContext.broadcast(Index(part, overlap))

        def read(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(name)
                found = index.value.leaks(batch.column(batch.schema.get_field_index("text")))
                both = [
                    sorted(old + [dict(zip(("item_id", "overlap", "question", "answer"), leak)) for leak in new], key=lambda x: x["item_id"])
                    for old, new in zip(batch.column(at).to_pylist(), found)
                ]
                yield batch.set_column(at, batch.schema.field(at), pa.array(both, batch.schema.field(at).type))

        out = out.mapInArrow(read, out.schema)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    name = fresh(docs, "leaks")
    return find_leaks(docs, items, name=name, **options).where(F.size(name) == 0).select(*[f"`{c}`" for c in docs.columns])


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id", (F.size("leaks") == 0).alias("kept"), F.size("leaks").cast("long").alias("n_items"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("items"),
        F.array_max(F.transform("leaks", lambda x: x["overlap"])).alias("overlap"),
    )
