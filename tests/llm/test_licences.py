from conftest_llm import DATA, ODD, duck, table

from fleetcatalog.llm import licences, queries

MIT = licences.KNOWN[0][1]


def scanned(spark, texts, known=None):
    rows = licences.scan(table(spark, list(enumerate(texts))), known).orderBy("doc_id").collect()
    return [(r.licence, r.n_lines, r.line_licences) for r in rows]


def test_copies_that_differ_in_form(spark):
    other = MIT.replace("License", "LICENCE").replace("sublicense", "sublicence").replace('"', "''").replace(",", " ,").replace("HOLDERS", "owners")
    texts = [MIT, MIT.upper(), f"Copyright (c) 1999 A. Name\n  {other}\n", f"© 2001 B\n(C) 2002 C\n{MIT}", MIT.replace("Software", "Hardware"), MIT + " more", "copyright only"]
    assert [r[0] for r in scanned(spark, texts)] == ["MIT"] * 4 + [None] * 3


def test_whole_licences_in_other_dress(spark):
    """Comment marks, line numbers' punctuation, wrapping and owners differ; a changed word is another text."""
    whole = [(n, t) for n, t in licences.KNOWN if len(t) > 500]
    wrapped = [(n, "/*\n * Copyright (c) 2020, The Owner\n" + "\n".join(f" * {' '.join(w[i : i + 9])}" for w in [t.split()] for i in range(0, len(w), 9)) + "\n */") for n, t in whole]
    changed = [(None, t.replace("software", "hardware").replace("SOFTWARE", "HARDWARE").replace("License", "Licenses")) for _, t in whole]
    assert {n for n, _ in whole} >= {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "Apache-2.0"}
    for some in (whole, wrapped, changed):
        assert [r[0] for r in scanned(spark, [t for _, t in some])] == [n for n, _ in some]


def test_lines(spark):
    texts = ["a\nReleased under the MIT licence\nb\nAll rights reserved!\nall RIGHTS reserved", "x Released under the MIT License.", "Licensed under CC-BY-NC 4.0"]
    assert scanned(spark, texts) == [(None, 3, "MIT,proprietary"), (None, 0, ""), ("CC-BY-NC-4.0", 1, "CC-BY-NC-4.0")]


def test_odd_rows(spark):
    rows = licences.scan(table(spark, ODD)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ODD), key=str)
    assert all((r.licence, r.n_lines, r.line_licences) == (None, 0, "") for r in rows)
    assert licences.scan(table(spark, [])).count() == 0


def test_a_list_with_null_empty_and_equal_texts(spark):
    known = spark.createDataFrame([("b", "One, two"), ("a", "one two"), ("c", None), ("d", " ")], "licence string, text string")
    assert scanned(spark, ["ONE\ntwo", "", "one two three"], known) == [("a", 0, ""), (None, 0, ""), (None, 0, "")]
    assert scanned(spark, ["one"], known.limit(0)) == [(None, 0, "")]


def test_given_documents_as_in_sql(spark):
    rows = queries.op6_licences(spark, DATA)
    names = sorted(rows.columns)
    want = duck().execute(f"SELECT {', '.join(names)} FROM ({queries.LICENCES})").fetchall()
    assert sorted((tuple(r) for r in rows.select(*names).collect()), key=str) == sorted(want, key=str)
