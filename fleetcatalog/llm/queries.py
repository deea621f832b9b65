"""The operators on the given tables, each whole; and the same in SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, importance, language_model, licences, near_dedup, packing, personal_data, quality, toxicity, url_filter, vector_codes
from .store import held_out

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    trees = quality.train(docs, read(spark, folder, "labels"), lambda i: ~held_out(i, 4, 2))
    return quality.score(docs, trees).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= quality.KEEP_SCORE).cast("int").alias("predicted")
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read(spark, folder, "documents")).drop("row")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_counts(read(spark, folder, "documents")))


def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(read(spark, folder, "documents"), held_out("doc_id", 7, 2))


def _only(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find(read(spark, folder, "documents"))
    count = [F.size(F.filter("spans", _only(k))).cast("long").alias(f"n_{k}") for k in personal_data.KINDS[:4]]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.sha2(text(F.filter("spans", lambda s: s["kind"] != "private")).cast("binary"), 256)
    return found.select("doc_id", *count, base.alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(read(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    names = F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), "contaminated")


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents")).drop("row")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    index = toxicity.train(docs, read(spark, folder, "labels"), lambda i: ~held_out(i, 5, 0))
    return toxicity.score(docs, index).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.importance(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, folder, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality, op2_exact_dedup, op3_packing, op4_language_model, op5_personal_data, op6_licences, op7_decontamination, op8_near_dedup,
        op9_toxicity, op10_url_filter, op11_importance_resampling, op12_vector_codes, op13_html_text,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM digests WINDOW same AS (PARTITION BY text_sha256)
"""

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
lengths AS (SELECT item, w, least(len(w), 13) AS size FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS words
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM lengths)),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM docs),
suffixes AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS words
  FROM places, (SELECT DISTINCT size FROM windows) WHERE s + size - 1 <= len(w)),
hits AS (SELECT doc_id, s, size, item FROM suffixes JOIN windows USING (size, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""



def _canonical(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    out = f"replace(replace({out}, '(c)', ' copyright '), '©', ' copyright ')"
    out = f"concat(' ', replace(regexp_replace({out}, '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), chr(10), concat(' ', chr(10), ' ')), ' ')"
    for other, usual in licences.SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {usual} ')"
    return f"string_split({out}, chr(10))"


def _tight(text: str) -> str:
    return f"trim(regexp_replace({text}, ' {{2,}}', ' ', 'g'), ' ')"


def _whole(lines: str) -> str:
    named = f"starts_with(ltrim(x, ' '), 'copyright') AND NOT regexp_matches({_tight('x')}, '{licences.SPOKEN_OF}')"
    return _tight(f"array_to_string(list_filter({lines}, lambda x: NOT ({named})), ' ')")


def _known() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licences.KNOWN)


LICENCES = f"""
WITH known(licence, text) AS (VALUES {_known()}),
digests AS (
  SELECT sha256(t) AS digest, min(licence) AS licence FROM (SELECT licence, {_whole(_canonical("text"))} AS t FROM known) WHERE t <> '' GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_canonical("text")} AS lines FROM documents),
whole AS (SELECT row, doc_id, sha256({_whole("lines")}) AS text_sha256 FROM docs),
lines AS (SELECT row, sha256({_tight("line")}) AS digest FROM (SELECT row, unnest(lines) AS line FROM docs)),
found AS (SELECT row, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM lines JOIN digests USING (digest) GROUP BY row)
SELECT doc_id, text_sha256, d.licence, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, coalesce(names, '') AS line_licences
FROM whole LEFT JOIN found USING (row) LEFT JOIN digests d ON d.digest = text_sha256
"""


def _url_sql() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.RULES)
    steps, last = [], "p"
    for n in range(url_filter.ORDER + 1):
        key, at = f"substr(gram, {url_filter.ORDER + 1 - n}, {n + 1})", url_filter.ORDER + 1 - n
        smooth = ", ".join(
            f"CASE WHEN total_{k} = 0 THEN p_{k} ELSE (n_{k} + kinds_{k} * p_{k}) / (total_{k} + kinds_{k}) END AS p_{k}" for k in ("allow", "block")
        )
        steps.append(f"""
sums{n} AS (SELECT {key} AS key, CAST(sum(allow) AS BIGINT) AS n_allow, CAST(sum(block) AS BIGINT) AS n_block FROM counts GROUP BY ALL),
seen{n} AS (
  SELECT substr(key, 1, {n}) AS context, CAST(sum(n_allow) AS BIGINT) AS total_allow, CAST(sum(n_block) AS BIGINT) AS total_block,
         count(*) FILTER (n_allow > 0) AS kinds_allow, count(*) FILTER (n_block > 0) AS kinds_block FROM sums{n} GROUP BY ALL),
p{n} AS (
  SELECT gram, {smooth} FROM {last} JOIN sums{n} ON sums{n}.key = {key} JOIN seen{n} ON seen{n}.context = substr(gram, {at}, {n}))""")
        last = f"p{n}"
    return f"""
WITH rules(verdict, host, path) AS (VALUES {rules}),
parts AS (
  SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fitting AS (
  SELECT row, r.host || r.path AS rule, r.verdict AS ruled,
         row_number() OVER (PARTITION BY row ORDER BY length(r.host || r.path) DESC, r.host, r.path, r.verdict) AS rank
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
urls AS (
  SELECT p.*, rule, ruled, substr(md5(url), 1, 1) > '2' AS learned,
         '^^^' || regexp_replace(translate(translate(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END, '{UPPER}', '{LOWER}'), '0123456789', '0000000000'), '[^a-z0._/-]', '~', 'g') AS t
  FROM parts p LEFT JOIN fitting f ON f.row = p.row AND rank = 1),
grams AS (SELECT row, ruled, learned, substr(t, i, 4) AS gram FROM (SELECT row, ruled, learned, t, unnest(range(1, length(t) - 2)) AS i FROM urls)),
counts AS (
  SELECT gram, count(*) FILTER (ruled = 'allow' AND learned) AS allow, count(*) FILTER (ruled = 'block' AND learned) AS block FROM grams GROUP BY gram),
p AS (SELECT gram, CAST(1 AS DOUBLE) / {url_filter.ALPHABET} AS p_allow, CAST(1 AS DOUBLE) / {url_filter.ALPHABET} AS p_block FROM counts),
{",".join(steps)},
ratios AS (SELECT gram, CAST(round((ln(p_allow) - ln(p_block)) * 1000000) AS BIGINT) AS millionths FROM {last}),
able AS (SELECT coalesce(sum(allow), 0) > 0 AND coalesce(sum(block), 0) > 0 AS ok FROM counts),
scores AS (
  SELECT row, any_value(ruled) AS ruled, any_value(learned) AS learned, CAST(floor(CAST(sum(millionths) AS DOUBLE) / count(*) / 1000000 * {url_filter.BINS}) AS BIGINT) AS bin
  FROM grams JOIN ratios USING (gram) GROUP BY row),
bins AS (
  SELECT bin, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
  FROM scores WHERE ruled IS NOT NULL AND NOT learned GROUP BY bin),
totals AS (SELECT coalesce(sum(a), 0) AS accepted, coalesce(sum(b), 0) AS rejected FROM bins),
rights AS (
  SELECT bin, lag(bin) OVER (ORDER BY bin) AS before, coalesce(sum(b * accepted - a * rejected) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gain
  FROM bins, totals WHERE accepted > 0 AND rejected > 0),
least AS (SELECT coalesce((SELECT CAST(coalesce(floor((before + bin + 1) / 2.0), bin) AS BIGINT) FROM rights ORDER BY gain DESC, bin LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule,
       coalesce(u.ruled, CASE WHEN ok AND coalesce(bin, 0) < least THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN scores s ON s.row = u.row CROSS JOIN least CROSS JOIN able
"""


#: The CRC-32 table by its rule, and the checksum of a text byte by byte.
CRC_TABLE = f"list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, {importance.POLYNOMIAL} * (c & 1))))"
CRC_STEP = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"


def _bytes(text: str) -> str:
    digits = f"hex(encode({text}))"
    return f"list_transform(range(strlen({text})), lambda i: CAST(('0x' || substr({digits}, 2 * i + 1, 2)) AS BIGINT))"


def _runs(table: str) -> str:
    return f"SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS run FROM {table}"


def _importance_sql() -> str:
    n, draw = importance.BUCKETS, f"n_words >= {importance.LEAST_WORDS}"
    return f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {WORDS} AS w FROM documents),
items AS (SELECT row_number() OVER () AS id, {WORDS} AS w FROM benchmark),
doc_runs AS MATERIALIZED (SELECT id, run, count(*) AS n FROM ({_runs("docs")}) GROUP BY ALL),
item_runs AS (SELECT run, count(*) AS n FROM ({_runs("items")}) GROUP BY ALL),
buckets AS MATERIALIZED (
  SELECT run, xor(list_reduce(list_prepend(4294967295, {_bytes("run")}), {CRC_STEP}), 4294967295) % {n} AS bucket
  FROM (SELECT run FROM doc_runs UNION SELECT run FROM item_runs), crc),
corpus AS (SELECT bucket, sum(n) AS s FROM doc_runs JOIN buckets USING (run) GROUP BY ALL),
target AS (SELECT bucket, sum(n) AS t FROM item_runs JOIN buckets USING (run) GROUP BY ALL),
sizes AS (SELECT coalesce((SELECT sum(s) FROM corpus), 0) AS s_all, coalesce((SELECT sum(t) FROM target), 0) AS t_all),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + {n}) AS DOUBLE) / CAST((s + 1) * (t_all + {n}) AS DOUBLE))) AS BIGINT) AS gain
  FROM corpus LEFT JOIN target USING (bucket), sizes),
weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
  FROM doc_runs JOIN buckets USING (run) JOIN gains USING (bucket) GROUP BY id),
scored AS (
  SELECT id, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (id)),
ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank, {importance.PERCENT} * count(*) OVER () // 100 AS drawn
  FROM scored WHERE {draw})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ranked USING (id)
"""


def _codes_sql() -> str:
    parts, entries, square = vector_codes.PARTS, vector_codes.ENTRIES, "list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assigned = f"""
  SELECT id, part, v, arg_min(entry, CAST({square} AS BIGINT) * {entries} + entry) AS entry, min(CAST({square} AS BIGINT)) AS squared
  FROM parts JOIN (SELECT part, entry, list(x ORDER BY position) AS e FROM {{book}} GROUP BY part, entry) USING (part) GROUP BY id, part, v"""
    rounds = "".join(
        f"""
near{k} AS MATERIALIZED ({assigned.format(book=f"book{k}")}),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, position, coalesce(mean, x) AS x FROM book{k} LEFT JOIN (
    SELECT part, entry, position, CAST(floor(CAST(sum(v[position]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
    FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS position FROM near{k}) GROUP BY ALL) USING (part, entry, position)),"""
        for k in range(vector_codes.ROUNDS)
    )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS whole
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT id, part, whole[part * len(whole) // {parts} + 1:(part + 1) * len(whole) // {parts}] AS v FROM kept, range({parts}) AS p(part)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, position, v[position] AS x FROM (SELECT id, part, v, unnest(range(1, len(v) + 1)) AS position FROM parts WHERE id <= {entries})),{rounds}
last AS MATERIALIZED ({assigned.format(book=f"book{vector_codes.ROUNDS}")}),
codes AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(squared) AS BIGINT) AS error FROM last GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, position)) FROM book{vector_codes.ROUNDS}) AS codebooks_sha256
FROM kept JOIN codes USING (id)
"""


ORACLE: dict[str, str] = {"op2_exact_dedup": EXACT, "op6_licences": LICENCES, "op7_decontamination": CONTAMINATION, "op10_url_filter": _url_sql(),
                          "op11_importance_resampling": _importance_sql(), "op12_vector_codes": _codes_sql()}
