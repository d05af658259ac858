"""Secrets in whole texts, by a trigram inverted index, with DataFrame functions only.

1. The regular expression of a rule is taken apart on the driver into a Boolean query over the runs of three characters
   that every match must hold: alternatives, each a set of trigrams that all have to be there. Letters are folded to
   small ones, so one index serves rules of both kinds of case.
2. The index is a written table of postings (gram, mark), a mark being a hash of a row's id and text. It holds the grams
   that the rules can ask for, of all documents.
3. The postings of the rules' grams meet on the mark; a document is a candidate of a rule if all grams of one alternative
   are there. Equal marks of different rows only make a candidate more.
4. Candidates are joined to the documents and verified by the rule's expression. Rules without a mandatory trigram (long
   hexadecimal numbers) have no query and scan all documents.

The base kinds are assign, access and hex; the method adds keys and tokens with a fixed form. Spans of one kind are
leftmost and do not overlap; a match that its rule refuses is dropped and not tried again from a later place.

Defined results: a null text is an empty one, without spans; rows that repeat an id and a text are judged alike, and null
ids change nothing; no rows give no rows; spans stand by start, then kind. Extra columns are left out of the result.
"""

from __future__ import annotations

import re._constants as token
import re._parser as parser
from collections.abc import Callable, Iterable
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.columns import located
from callscope.plans.storage import written

#: Strings and alternatives that the analysis of an expression keeps apart; beyond, it asks for less.
STRINGS, CLASS, ALTERNATIVES = 64, 8, 32

Query = frozenset[frozenset[str]]
#: The query that every text meets.
ANY: Query = frozenset([frozenset()])


class Rule(NamedTuple):
    """A kind of secret: its expression, and which matches count."""

    pattern: str
    valid: Callable[[Column], Column] = lambda m: F.lit(True)


def either_case(words: str) -> str:
    """The expression with each ASCII letter in either case."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


_ASSIGNED = either_case("(?:password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?"""

#: The base kinds come first, in their order.
RULES = {
    "assign": Rule(
        _ASSIGNED + r"[A-Za-z0-9+/_.=-]+", lambda m: F.char_length(F.regexp_extract(m, _ASSIGNED + r"([A-Za-z0-9+/_.=-]+)", 1)) >= 6
    ),
    "access": Rule(r"AKIA[A-Z0-9]+", lambda m: F.char_length(m) >= 20),
    "hex": Rule(r"(?<![0-9a-f])[0-9a-f]{24,}"),
    "private": Rule(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    "github": Rule(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": Rule(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": Rule(r"AIza[A-Za-z0-9_-]{35,}"),
    "jwt": Rule(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
}
BASE = ("assign", "access", "hex")


def _least(alternatives: Iterable[frozenset[str]]) -> Query:
    """Without alternatives that ask for more than another one."""
    every = set(alternatives)
    return frozenset(a for a in every if not any(b < a for b in every))


def _both(one: Query, other: Query) -> Query:
    joined = _least(a | b for a, b in product(one, other))
    return joined if len(joined) <= ALTERNATIVES else one


def _grams(strings: Iterable[str]) -> Query:
    """One of the strings is there, with all its grams."""
    found = _least(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)
    return found if len(found) <= ALTERNATIVES else ANY


def _characters(items) -> set[str] | None:
    """The folded characters of a small class, or None."""
    out: set[str] = set()
    for kind, value in items:
        if kind is token.LITERAL:
            out.add(chr(value).lower())
        elif kind is token.RANGE and value[1] - value[0] < 2 * CLASS:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= CLASS else None


def _part(kind, value) -> tuple[set[str] | None, Query]:
    """(the strings that a part of an expression can match, if they are few; what its matches hold)."""
    if kind is token.LITERAL:
        return {chr(value).lower()}, ANY
    if kind in (token.AT, token.ASSERT, token.ASSERT_NOT):
        return {""}, ANY
    if kind is token.IN:
        return _characters(value), ANY
    if kind is token.SUBPATTERN:
        return _sequence(value[3])
    if kind is token.ATOMIC_GROUP:
        return _sequence(value)
    if kind is token.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(strings is not None for strings, _ in parts) and sum(len(s) for s, _ in parts) <= STRINGS:
            return set().union(*[s for s, _ in parts]), ANY
        asked = _least(a for strings, query in parts for a in (query if strings is None else _grams(strings)))
        return None, asked if len(asked) <= ALTERNATIVES else ANY
    if kind in (token.MAX_REPEAT, token.MIN_REPEAT, token.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if low == 0:
            return None, ANY
        return None, query if strings is None else _grams(strings)
    return None, ANY


def _sequence(parts) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, ANY, True
    for kind, value in parts:
        own, asked = _part(kind, value)
        if own is not None and len(strings) * len(own) <= STRINGS:
            strings = {a + b for a, b in product(strings, own)}
        else:
            query = _both(_both(query, _grams(strings)), asked if own is None else _grams(own))
            strings, whole = {""}, False
    return (strings, ANY) if whole else (None, _both(query, _grams(strings)))


def trigram_query(pattern: str) -> Query:
    """What a text must hold to match: one of these sets of trigrams (of the text in small letters); ``ANY`` if nothing."""
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _grams(strings)


def _mark() -> Column:
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def postings(docs: DataFrame, grams: Iterable[str]) -> DataFrame:
    """(gram, mark) of the given trigrams in all texts, in small letters."""
    low = docs.select(_mark().alias("mark"), F.lower("text").alias("low"))
    here = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in sorted(grams)]))
    return low.select("mark", F.explode(here).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(mark, rules): for each mark the rules whose query its postings meet."""
    asked = sorted({g for query in queries.values() for a in query for g in a})
    # at most one element for each gram of the rules
    held = index.where(F.col("gram").isin(asked)).groupBy("mark").agg(F.collect_set("gram").alias("held"))

    def met(query: Query) -> Column:
        any_of = F.lit(False)
        for alternative in sorted(query, key=sorted):
            any_of = any_of | (F.size(F.array_except(F.array(*map(F.lit, sorted(alternative))), "held")) == 0)
        return any_of

    rules = F.array_compact(F.array(*[F.when(met(query), F.lit(name)) for name, query in queries.items()]))
    return held.select("mark", rules.alias("rules")).where(F.size("rules") > 0)


_SPANS = "array<struct<start:int,no:int,end:int,kind:string>>"


def _spans(text: Column, kind: str, no: int, rule: Rule) -> Column:
    confirmed = F.filter(located(text, rule.pattern), lambda s: rule.valid(s["found"]))
    return F.transform(confirmed, lambda s: F.struct(
        s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")
    ))


def find_secrets(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """doc_id and, per rule, an array of (start, no (the rule's number), end, kind) in order of start."""
    rules = RULES if rules is None else rules
    queries = {name: trigram_query(rule.pattern) for name, rule in rules.items()}
    asking = {name: query for name, query in queries.items() if query != ANY}
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _mark().alias("mark"))
    if asking:
        index = written(postings(docs, {g for query in asking.values() for a in query for g in a}), "trigrams")
        # a table of its own: its size is known, so a small one is broadcast and the texts stay where they are
        rows = rows.join(written(candidates(index, asking), "candidates"), "mark", "left")
    none = F.array().cast(_SPANS)

    def found(no: int, name: str, rule: Rule) -> Column:
        spans = _spans(F.col("text"), name, no, rule)
        return spans if name not in asking else F.when(F.array_contains("rules", F.lit(name)), spans).otherwise(none)

    return rows.select("doc_id", *[found(no, name, rule).alias(name) for no, (name, rule) in enumerate(rules.items())])


def _joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def query(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.array_sort(F.concat(*BASE))), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(*RULES))).alias("spans"),
    )


def _oracle() -> str:
    """Each kind by a plain scan of all texts, without lookarounds; places from the lengths of matches and gaps."""
    scans = {name: (rule.pattern.replace("'", "''"), "true") for name, rule in RULES.items()}
    value = _ASSIGNED.replace("'", "''")
    scans["assign"] = (scans["assign"][0], f"length(regexp_extract(m, '{value}([A-Za-z0-9+/_.=-]+)', 1)) >= 6")
    scans["access"] = (scans["access"][0], "length(m) >= 20")
    scans["hex"] = ("[0-9a-f]+", "length(m) >= 24")
    parts = [f"""SELECT r, {no} AS no, '{name}' AS kind, m, length(m) AS size, k,
       sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY k) AS until, {valid} AS valid
  FROM (SELECT r, unnest(found) AS m, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS k
        FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM docs))"""
             for no, (name, (pattern, valid)) in enumerate(scans.items())]
    text = "kind || ':' || CAST(until - size AS BIGINT) || ':' || CAST(until AS BIGINT)"
    joined = f"coalesce(string_agg({text}, ',' ORDER BY until - size, no) {{}}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    base = joined.format(f"FILTER (no < {len(BASE)})")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT * FROM matches WHERE valid)
SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {joined.format('')} AS spans
FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""


ORACLE = _oracle()
