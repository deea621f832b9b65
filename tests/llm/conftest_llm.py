"""Rows and helpers for the tests of the text operators."""

import os

import duckdb
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark", "pages", "embeddings")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("row", "kept", "score", "class", "n", "key", "spans", "n_words", "digest", "label", "rule", "place")


def duck(folder=DATA):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def table(spark, rows, schema="doc_id long, text string"):
    """Rows with columns named like those of the operators' own results."""
    return spark.createDataFrame(rows, schema).withColumns({n: F.lit(7) for n in EXTRA})


#: Null ids, null and empty texts, a repeated row, ties, long texts.
ODD = [
    (1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (None, " \t"),
    (None, "one two three four five six seven"), (5, "word " * 60_000), (6, "é" * 50_000), (7, "x"),
]


def as_in_sql(spark, name, folder=DATA):
    """Holds a registered query against its SQL."""
    from fleetcatalog.llm import queries

    rows = queries.QUERIES[name](spark, folder)
    names = sorted(rows.columns)
    want = duck(folder).execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted((tuple(r) for r in rows.select(*names).collect()), key=str) == sorted(want, key=str)
