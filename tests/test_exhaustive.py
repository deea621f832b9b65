"""Every short text over a small alphabet, against the splitting rules written out in Python."""

import re
from itertools import product

from pyspark.sql import functions as F

from fleetcatalog import functions as fn
from fleetcatalog.sources.reports import report_lines, second_word


def texts(alphabet, longest):
    return ["".join(t) for n in range(longest + 1) for t in product(alphabet, repeat=n)]


def split(text, pattern):
    """Parts between matches; empty parts at the end do not count, text without a match is one part."""
    if not re.search(pattern, text):
        return [text]
    parts = re.split(pattern, text)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def each(spark, data, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string")
    return [r[1] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_pairs(spark):
    data = texts("ab=\n", 6)
    found = each(spark, data, F.struct(fn.is_pair(F.col("t")), fn.pair_key(F.col("t")), fn.pair_value(F.col("t"))))
    for text, got in zip(data, found, strict=True):
        parts = split(text, "=")
        expected = (True, *parts) if len(parts) == 2 else (False, None, None)
        assert tuple(got) == expected, repr(text)


def test_path_prefixes(spark):
    data = ["^/" + t for t in texts("/a.?\n", 5)]
    found = each(spark, data, fn.typed_path(F.col("t"), F.lit(True)))
    for text, got in zip(data, found, strict=True):
        path = text[1:]
        plain = "//" not in path and all(
            s == "" or re.fullmatch(r"[a-zA-Z0-9._-]+", s) for s in split(path, "/")
        )
        assert (got["kind"], got["value"]) == (("path-beg", path) if plain else (None, None)), repr(text)


def test_second_words(spark):
    data = texts("ab \t\x0b", 6)
    for text, got in zip(data, each(spark, data, second_word(F.col("t"))), strict=True):
        parts = split(text, r"[ \t\n\x0b\f\r]+")
        assert got == (parts[1] if len(parts) > 1 else None), repr(text)


def test_report_lines(spark):
    data = texts("ab\r\n", 7)
    for text, got in zip(data, each(spark, data, report_lines(F.col("t"), 2)), strict=True):
        lines = re.split("\r\n|\r|\n", text)[1:3]
        assert [line for line in got if line] == [line for line in lines if line], repr(text)
