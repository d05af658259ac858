"""Mixing, exact dedup, line dedup, archive and personal data against SQL and brute force."""

import hashlib
import re
from collections import Counter

import pytest
from compare import difference, sql_result
from llm_data import DOCS, EXTRA, SCHEMA, SF_DIR, documents, empty, sql
from pyspark.sql import functions as F

from callscope.llm import exact, lines, mixing, pii, queries, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR).toPandas()
    if "refers_to" in got:
        got["refers_to"] = got["refers_to"].astype("Int64")
    want = sql_result(queries.ORACLES[name], SF_DIR)
    if "refers_to" in want:
        want["refers_to"] = want["refers_to"].astype("Int64")
    assert len(got) and difference(got, want) is None


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("module", [mixing, exact])
def test_odd_rows_equal_sql(spark, module, extra):
    got = module.query(documents(spark, extra=extra)).toPandas()
    want = sql(module.ORACLE, documents=documents(spark))
    for c in ("doc_id", "keep_id", "size", "source_size", "taken", "group_size"):
        for df in (got, want):
            if c in df:
                df[c] = df[c].astype("Float64")
    assert difference(got, want) is None


def test_hot_group_is_sliced(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i}", "en", "a") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert difference(exact.duplicates(docs, share=10).drop("mark").toPandas(), sql(exact.ORACLE, documents=docs).astype({"doc_id": "int64", "keep_id": "int64"})) is None


def test_deduplicate_keeps_one_row_with_all_columns(spark):
    docs = documents(spark, extra=True)
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in rows) == sorted(
        (i is None, i or 0) for i in (2, 3, None, 6, 7, 8, 9, 10, 11, 12, 1) if i != 3
    ) + [] or len(rows) == len({re.sub(r"[ \t-\r]", "", t or "") for _, t, _, _ in DOCS})


def test_mix_takes_what_targets_say(spark):
    rows = [(i, "one two three", "en", "abc"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs)
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.1 for r in sums)
    out = mixing.emit(mixed)
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.emit(mixing.mix(documents(spark, extra=True))).columns.count("copy") == 1
    assert set(EXTRA) <= set(mixing.mix(documents(spark, extra=True)).columns)


def test_limit_is_shared_again(spark):
    rows = [(1, "w", "en", "a"), (2, "w " * 100, "en", "b"), (3, "w " * 5, "en", "c"), (4, None, "en", None)]
    got = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": 3.0, "b": 88.0, "c": 15.0, None: 0.0}


@pytest.mark.parametrize("extra", [False, True])
def test_lines_of_odd_rows(spark, extra):
    rows = [r for r in DOCS if r[0] is not None]
    rows = [r for i, r in enumerate(rows) if r not in rows[:i]]
    docs = documents(spark, rows)
    got = lines.query(documents(spark, rows, extra)).toPandas()
    assert difference(got, sql(lines.ORACLE, documents=docs).astype({"doc_id": "int64"})) is None


def test_lines_without_an_id_are_one_document(spark):
    rows = [(None, "a line that is long enough", None, None)] * 2
    assert [r["n_dropped"] for r in lines.query(documents(spark, rows)).collect()] == [0, 0]
    rows += [(4, "a line that is long enough\nx", None, None)]
    assert sorted(r["n_dropped"] for r in lines.query(documents(spark, rows)).collect()) == [0, 1, 1]


def test_line_dedup_of_documents_without_an_id(spark):
    """They lose the lines of documents with an id and keep what only they share, each row by its own text."""
    rows = [(7, "a line of seven\nanother of its own")]
    rows += [(None, f"a line of seven\nshared without an id\nown line number {i}") for i in range(50)] + [(None, "a line of seven")] * 3 + [(None, None)]
    docs = spark.createDataFrame([(i, "s", "en", t) for i, t in rows], "doc_id long, source string, lang string, text string").repartition(6)
    got = Counter(map(tuple, lines.drop_repeated_lines(docs).collect()))
    want = Counter([(7, 2, 0, rows[0][1]), (None, 1, 0, "")] + [(None, 1, 1, "")] * 3)
    want.update((None, 3, 1, f"shared without an id\nown line number {i}") for i in range(50))
    assert got == want


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c@d.e a@b.c_x@d.e..f@g.h a@@b.c a@b..c@d.e x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.255.0 1.2.3 9.9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 1111 1111 41111111111111112", "+1 (650) 555-0100 +49.30.1234567- +1 2 +++123456789",
    "mail é\U0001f600 me: me@host.example, card 5500005555555559 iban DE89 3704 0044 0532 0130 00 x GB82WEST12345698765432",
    "a" * 3000 + "@" + "b" * 3000, "1" * 3000, "+" + "1." * 2000 + "x", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "",
]


def test_personal_data_equals_brute_force(spark):
    texts = TRICKY + [t for _, t, _, _ in DOCS]
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()
    texts += [r["text"] for r in given]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in pii.query(docs).collect()}
    for i, text in enumerate(texts):
        want = _base_spans(text or "")
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (text or "")[:100]
        assert got[i]["spans"].startswith(base)
        for kind in PATTERNS:
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in want)
    ibans = re.findall(r"iban:(\d+):(\d+)", got[4]["spans"])
    assert [TRICKY[4][int(a) : int(b)] for a, b in ibans] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]


def test_context_raises_the_score_and_spans_are_masked(spark):
    docs = spark.createDataFrame([(1, "call +1 650 555 0100 or x +1 650 555 0101", None, None)], SCHEMA)
    found = pii.find_personal_data(docs, ("phone",)).first()["phone"]
    assert [round(s["score"], 2) for s in found] == [0.75, 0.6]
    both = docs.join(pii.find_personal_data(docs, ("phone",)), "doc_id")
    masked = both.select(pii.redact(F.col("text"), F.col("phone")).alias("m")).first()["m"]
    assert masked == "call " + "*" * 15 + " or x " + "*" * 15


PAGES = [
    (1, "http://a/1", "x" * 2000), (2, "http://a/2", "x" * 2000), (2, "http://a/2", "x" * 2000), (3, None, None), (4, "u\r\nv", ""),
    (5, "http://é", "é" * 500), (6, "http://b", "é" * 500), (7, "s", "short"), (8, "s", "short"), (None, "n", "x" * 2000),
    (9, "crlf", "a\r\n\r\nContent-Length: 5\r\n\r\n" * 3),
]


def test_archive_gives_back_every_record(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("strong", F.lit("x"))
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path).collect()
    assert len(records) == len(PAGES) and all(r["sound"] for r in records)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    by_id = {r["page_id"]: r for r in records if r["page_id"] is not None}
    assert [(i, by_id[i]["record_type"], by_id[i]["refers_to"]) for i in (1, 2, 5, 6, 7, 8)] == [
        (1, "revisit", 2), (2, "response", None), (5, "revisit", 6), (6, "response", None), (7, "response", None), (8, "response", None),
    ]
    for page_id, _, page in PAGES:
        if page_id is not None:
            payload = (page or "").encode()
            assert by_id[page_id]["payload_digest"] == hashlib.sha1(payload).hexdigest()
            assert by_id[page_id]["payload_bytes"] == len(payload)
            if by_id[page_id]["record_type"] == "response":
                assert bytes(by_id[page_id]["record"]).partition(b"\r\n\r\n")[2] == payload + b"\r\n\r\n"
    # through files of records and back
    warc.export_warc(warc.read_archive(spark, path), str(tmp_path / "warc"))
    back = warc.import_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted(bytes(r["record"]) for r in back) == sorted(bytes(r["record"]) for r in records)
    # files of one or two records each, and what they hold
    warc.export_warc(warc.read_archive(spark, path).coalesce(1), str(tmp_path / "small"), volume_bytes=3000)
    assert len(list((tmp_path / "small").glob("*.gz"))) > 3
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]
    rows = lambda df: sorted(map(tuple, df.select(fields).collect()), key=str)
    assert rows(warc.read_warc(spark, str(tmp_path / "small"))) == rows(warc.read_archive(spark, path))


def test_more_lines_than_a_shard_may_hold(spark):
    rows = [(i, "\n".join(f"line number {(7 * i + k) % 400} of a text" for k in range(9)), None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    few, many = (sorted(map(tuple, lines.drop_repeated_lines(docs, shard_keys=n).collect())) for n in (lines.SHARD_KEYS, 10))
    assert few == many and sum(r[2] for r in few) > 0


def test_a_missing_payload_shows_in_all_its_records(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    lost = hashlib.sha256(b"x" * 2000).hexdigest()
    changed = hashlib.sha256("é".encode() * 500).hexdigest()
    other = stored.where(F.col("strong") == hashlib.sha256(b"short").hexdigest()).select(F.lit(changed).alias("strong"), "packed")
    stored.where(~F.col("strong").isin(lost, changed)).unionAll(other).write.parquet(f"{tmp_path}/broken/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{tmp_path}/broken/records")
    rows = warc.read_archive(spark, f"{tmp_path}/broken").collect()
    unsound = [(r["page_id"], r["record_type"], r["payload_bytes"]) for r in rows if not r["sound"]]
    assert sorted(unsound, key=str) == sorted([
        (1, "revisit", None), (2, "response", None), (2, "response", None), (None, "response", None),
        (5, "revisit", 5), (6, "response", 5),
    ], key=str)
    with pytest.raises(Exception, match="missing or damaged"):
        warc.export_warc(warc.read_archive(spark, f"{tmp_path}/broken"), f"{tmp_path}/broken/warc")
    # files of which some are lost: their responses' payloads show in the revisits that are left
    files = f"{tmp_path}/files"
    warc.export_warc(warc.read_archive(spark, path).where("page_id is null or page_id not in (2, 6)").where("page_id is not null"), files)
    rows = {r["page_id"]: r for r in warc.read_warc(spark, files).collect()}
    assert {i for i, r in rows.items() if not r["sound"]} == {1, 5} and rows[1]["payload_bytes"] is None


def test_empty_tables(spark):
    for module in (mixing, exact, lines, pii):
        assert module.query(empty(spark)).collect() == []
    assert warc.query(empty(spark, "page_id long, url string, html string")).collect() == []
