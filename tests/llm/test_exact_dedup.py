import hashlib
import re

from conftest_llm import DOCS, ODD, table

from fleetcatalog.llm import exact_dedup


def plain(rows):
    groups = {}
    for i, (key, text) in enumerate(rows):
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((key is None, key if key is not None else 0, i))
    out = []
    for digest, members in groups.items():
        winner = min(members)
        out += [(None if m[0] else m[1], None if winner[0] else winner[1], len(members), m == winner, digest) for m in members]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_odd_rows(spark):
    assert got(exact_dedup.duplicate_groups(table(spark, ODD))) == plain(ODD)


def test_white_space_is_one_space_and_nothing_else_is(spark):
    rows = [(1, "a  b"), (2, "a\tb"), (3, "a\x0b\x0cb"), (4, "a b"), (5, " a b"), (6, "a b"), (7, "a\x1cb")]
    out = got(exact_dedup.duplicate_groups(table(spark, rows)))
    assert out == plain(rows)
    assert {r[0] for r in out if r[1] == 1} == {1, 2, 3, 6}


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    assert got(exact_dedup.duplicate_groups(table(spark, rows), support=0.01)) == plain(rows)


def test_without_frequent_digests(spark):
    rows = [(i, f"text {i // 2}") for i in range(200)]
    assert got(exact_dedup.duplicate_groups(table(spark, rows), support=0.5)) == plain(rows)


def test_rows_that_stay_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in ODD], DOCS)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 3, 5, 6, 7, None]


def test_empty_table(spark):
    assert exact_dedup.duplicate_groups(table(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(table(spark, [])).count() == 0
