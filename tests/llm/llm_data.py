"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import duckdb

SF_DIR = "/root/testdata/sf0.001"
LONG = "Lorem ipsum dolor sit amet, consetetur " * 3000 + "end."
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "the  quick brown fox\njumps over the lazy dog near the river bank today ", "en", "a"),
    (2, "the  quick brown fox\njumps over the lazy dog near the river bank today ", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n\x0b\x0c\r ", "en", None),
    (None, "a line that two documents share\nand one more", "en", "b"),
    (None, None, None, None),
    (6, "a line that two documents share\nother words here\nshort\n", "de", "b"),
    (7, "  A LINE that two documents share\nshort\n\n", "de", "c"),
    (8, LONG, "de", "c"),
    (9, LONG + " tail", "de", "c"),
    (10, "éè \U0001f600 x", "fr", "d"),
    (11, "x" * 50_000, "fr", "d"),
    (12, "1" * 50_000 + " +" + "2" * 30_000, "fr", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names the operators use themselves.
EXTRA = ["size", "copies", "copy", "target", "_key", "key", "mark", "leaks", "place", "slices", "kept", "Norm", "block", "u", "doc", "t"]


def documents(spark, rows=None, extra=False):
    docs = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    if extra:
        docs = docs.selectExpr("*", *[f"concat('x', doc_id) AS `{c}`" for c in EXTRA])
    return docs


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def sql(query, **tables):
    """DuckDB's rows over small tables (lists of tuples with their column names)."""
    import pandas as pd

    con = duckdb.connect()
    for name, df in tables.items():
        rows = df.toPandas().astype({"doc_id": "Int64"}) if "doc_id" in df.columns else df.toPandas()
        rows = rows.astype(object).where(rows.notna(), None)
        kinds = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER"}
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[k]}' for c, k in df.dtypes)})")
        for row in rows.itertuples(index=False):
            con.execute(f"INSERT INTO {name} VALUES ({', '.join('?' * len(row))})", [None if v is None or v is pd.NA else v for v in row])
    return con.execute(query).fetch_df()
