"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for account numbers, ranges for
addresses, digit counts for phones), and words just before a span raise its score. The base kinds are email, ip, card
and phone; the method adds account numbers (iban).

The engine's matches are leftmost and do not overlap. Patterns are possessive and start only where a run of their
characters starts or where the match before ended (``\\G``): that finds the same spans as the plain patterns without
trying every place of a long run, and it never recurses, so very long runs are safe. Positions come from the lengths of
the matches and of the texts between them, counted in code points.

Defined results: a null text is an empty one, without spans; rows are judged one by one, so ties, repeated rows and
null ids change nothing; no rows give no rows. Extra columns are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.columns import located

#: Code points before a span in which context words count.
LEAD = 40


def _ip_valid(m: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]?)"
    return m.rlike(f"^(?:{part}\\.){{3}}{part}$")


def _card_valid(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _phone_valid(m: Column) -> Column:
    return F.char_length(F.translate(m, "+ ().-", "")).between(9, 15)


def _iban_valid(m: Column) -> Column:
    """Country, check digits and the rest, turned round and read as a number: 1 modulo 97."""
    plain = F.translate(m, " ", "")
    turned = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        digit = F.ascii(c) - 48
        return F.when(digit < 10, (rest * 10 + digit) % 97).otherwise((rest * 100 + digit + 48 - 55) % 97)

    return F.char_length(plain).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


#: kind: (cheap test of the whole text, pattern, validator, base score, context words)
KINDS = {
    "email": (
        lambda t: t.contains("@"),
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True), 0.8, r"mail|contact|write|reply",
    ),
    "ip": (
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _ip_valid, 0.6, r"\bip\b|address|host|server|login",
    ),
    "card": (
        lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
        r"[0-9]++(?:[ -][0-9]++)*+",
        _card_valid, 0.7, r"card|visa|credit|payment|cvv",
    ),
    "phone": (
        lambda t: t.contains("+"),
        r"\+[0-9][ ().0-9-]+[0-9]",
        _phone_valid, 0.6, r"phone|call|tel|mobile|fax",
    ),
    "iban": (
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}"),
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        _iban_valid, 0.8, r"iban|account|bank|transfer",
    ),
}
BASE = ("email", "ip", "card", "phone")


def spans(text: Column, kind: str) -> Column:
    """The confirmed spans of a kind with their scores."""
    test, pattern, valid, base, words = KINDS[kind]
    confirmed = F.filter(located(text, pattern, LEAD), lambda s: valid(s["found"]))
    scored = F.transform(confirmed, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.when(F.lower(s["lead"]).rlike(words), base + 0.15).otherwise(base).alias("score"),
    ))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(test(text), scored).otherwise(empty)


def find_personal_data(docs: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """doc_id and, per kind, an array of (kind, start, end, score) in order of start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *[spans(text, kind).alias(kind) for kind in kinds])


def _joined(arrays: list[Column]) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(
        F.concat(*arrays),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    ), ",")


def redact(text: Column, found: Column, mask: str = "*") -> Column:
    """The text with the spans masked, code point by code point; ``found`` in order of start, without overlaps."""
    def step(done: Column, s: Column) -> Column:
        before = F.substr(text, done["at"] + 1, s["start"] - done["at"])
        hidden = F.repeat(F.lit(mask), s["end"] - s["start"])
        return F.struct(s["end"].alias("at"), F.concat(done["out"], before, hidden).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(found, none, step, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1)))


def query(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    base = _joined([F.col(k) for k in BASE])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(base, 256).alias("base_sha256"), _joined([F.col(k) for k in KINDS]).alias("spans"),
        F.array_join(F.transform(F.concat(*[F.col(k) for k in KINDS]), lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
