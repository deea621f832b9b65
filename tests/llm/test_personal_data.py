import hashlib
import re

import pytest
from conftest_llm import DATA, DOCS, ODD, table

from fleetcatalog.llm import personal_data, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, rx in BASE.items() for m in re.finditer(rx, text or "") if right(k, m[0])]


def exact(row):
    return [(s.kind, s.start, s.end) for s in row.spans if s.kind != "private"]


TEXTS = [
    "a@b.c.d@e.f a@b@c.d x@y. é@é.fr joe@x.org.", "a@b.c+d@e.f", "1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3.256 1.2.3 é 9.9.9.9", "4111 1111 1111 1111 4111-1111-1111-1111 4111  111111111111",
    "4111111111111111 4111111111111111", "+1 (437) 555-0689, +49 30 1234567. +1234 ++12345678901 +1 2", "+ 1 23", "5410008907924160", "\U0001f600 é 4662139775541078 a@b.co", "%@-.- +_@a.b",
    "7" * 3000 + "." + "1" * 3000, "a@" * 2000, "1 " * 4000 + "1.1.1.1", "x@y.z " * 500, "0000000000000 000000000000000000000", "a\n1.2.3.4\x001.2.3.4",
]


def test_exact_spans(spark):
    rows = personal_data.find(table(spark, list(enumerate(TEXTS)))).orderBy("doc_id").collect()
    for row, text in zip(rows, TEXTS, strict=True):
        assert exact(row) == plain(text), text[:80]


def test_private_spans_touch_no_exact_one(spark):
    texts = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and a@b.c' for i in range(40)] + [f"page {i} of 2024-01-02 and 12/24" for i in range(100000, 100040)]
    rows = personal_data.find(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        added = [s for s in row.spans if s.kind == "private"]
        assert [(s.start, s.end) for s in added] == ([(9, 49)] if text.startswith("token") else [])
        assert exact(row) == plain(text)


def test_odd_rows(spark):
    rows = personal_data.find(table(spark, ODD)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ODD), key=str)
    assert all(r.spans == [] for r in rows)
    assert personal_data.find(table(spark, [])).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4!", "en", None, 1), (2, None, "en", None, 1), (3, "x", "en", None, 1)], DOCS)
    out = personal_data.redact(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["é [email], [ip]!", None, "x"]


@pytest.mark.parametrize("folder", [DATA])
def test_given_documents(spark, folder):
    texts = {r.doc_id: r.text for r in queries.read(spark, folder, "documents").collect()}
    for row in queries.op5_personal_data(spark, folder).collect():
        want = plain(texts[row.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w[0] == k for w in want) for k in BASE]
        assert [x for x in row.spans.split(",") if x and not x.startswith("private")] == [x for x in joined.split(",") if x]


def test_labelers_that_agree_are_trusted():
    patterns = [((1, 1, -1), 50), ((0, 0, -1), 50), ((1, 1, 1), 10), ((0, 0, 1), 10), ((1, -1, 0), 5), ((-1, 0, 0), 5)]
    belief = personal_data.reliabilities(patterns)
    assert belief[1, 1, -1] > 0.9 > 0.1 > belief[0, 0, -1] and belief[1, 1, 1] > 0.9 > 0.1 > belief[0, 0, 1]
    weights = personal_data.fit_classifier([((1, 0), 45.0, 50), ((0, 1), 2.0, 50)])
    assert weights[0] > 0 > weights[1]
    assert personal_data.reliabilities([]) == {} and personal_data.fit_classifier([]) == [0.0]
