"""Operator 5, personal data: exact patterns, and a span classifier taught by labelers that vote.

Four kinds follow fixed patterns and always count. Beside them, any longer token with digits or an at
sign is a candidate. Labelers (patterns, word lists, context) vote for, against, or not at all;
expectation-maximisation finds how reliable each is without any labelled span; and a logistic
classifier of the span's shape is fitted to the probabilities it gives. Candidates it accepts, and that
touch no exact span, are added as kind ``private``.

DataFrame functions only. What comes to the driver are counts of vote and shape patterns, whose number
is bounded by the values a pattern can have, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

KINDS = ("email", "ip", "card", "phone", "private")
#: The patterns in a form that never goes back over a run it has read, and finds the same: a run is entered at its
#: start, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9@._%+:/()-])(?=[A-Za-z._%+:/()-]*+[0-9@])[A-Za-z0-9@._%+:/()-]{7,}+"
#: Words that come before personal data or secrets, and before numbers that are neither.
PRIVATE_WORDS = ("tel", "phone", "call", "mobile", "fax", "email", "mail", "contact", "token", "key", "secret", "password", "passwd", "pwd", "ssn", "iban", "account", "card", "passport")
PLAIN_WORDS = ("page", "pages", "year", "years", "figure", "fig", "version", "chapter", "section", "volume", "no", "line", "table", "isbn")
MAIL_ENDS = ("com", "net", "org", "edu", "gov", "info", "de", "fr", "es", "io")
EM_ROUNDS, FIT_ROUNDS = 60, 400
AROUND = 24


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) > 52, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        plain = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(text, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(text)
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _matches(kind: int, pattern: str, needs: Column) -> Column:
    """All matches as structs: kind, place, characters since the last match, the match, and what is around it."""
    gaps = F.split("text", pattern, -1)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(found.alias("hit"), F.slice(gaps, 1, F.size(found)).alias("gap"), F.slice(gaps, 2, F.size(found)).alias("next")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(x["gap"]).cast("long").alias("gap"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(AROUND)).alias("before"), F.left(x["next"], F.lit(2)).alias("after")),
    )
    return F.when(needs, rows)


def votes(hit: Column, before: Column, after: Column) -> list[Column]:
    """Each labeler's vote on a candidate: 1 for, 0 against, -1 none."""
    number = F.length(_digits(hit))
    word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    hexes = hit.rlike(r"^[0-9A-Fa-f]+$") & hit.rlike("[A-Fa-f]")
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    return [
        vote(hit.rlike(f"{EMAIL}|{IP}") | hit.rlike(r"^\+[0-9().-]{8,}$"), hit.rlike(r"^[0-9]{1,4}([./-][0-9]{1,4}){1,2}$")),
        vote(hexes & (F.length(hit) >= 16), number < 3),
        vote(word.isin(*PRIVATE_WORDS), word.isin(*PLAIN_WORDS)),
        vote(F.lower(F.regexp_extract(hit, r"@[^@]*\.([A-Za-z]+)$", 1)).isin(*MAIL_ENDS), hit.rlike(r"://|^www\.")),
        vote(before.rlike(r"[=:]\s*[\"']?$") & after.rlike(r"^[\"']"), F.lit(False)),
        vote(F.lit(False), (F.length(hit) < 9) & ~hit.contains("@")),
        vote(hit.rlike("[A-Za-z]") & (number >= 4) & (F.length(hit) >= 16), ~hit.rlike("[A-Za-z@]") & (number < 9)),
    ]


def shapes(hit: Column, before: Column, after: Column) -> list[Column]:
    """What the classifier sees of a candidate, each 0 or 1; the labelers' word lists are not among it."""
    number, size = F.length(_digits(hit)), F.length(hit)
    return [
        x.cast("int")
        for x in (
            hit.contains("@"), size >= 12, size >= 16, size >= 24, number >= 3, number >= 7, number * 2 >= size, number == size,
            hit.rlike("^[0-9A-Fa-f]+$"), hit.rlike("[A-Z]") & hit.rlike("[a-z]"), hit.contains("."), hit.contains("/"), hit.startswith("+"),
            hit.contains("("), before.rlike(r"[\"'=:]\s*$"), after.rlike(r"^[\"']"),
        )
    ]


def reliabilities(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = EM_ROUNDS) -> dict[tuple, float]:
    """P(private) of each vote pattern (votes, count), by EM over independent labelers with three answers each; it starts from the majority of votes."""
    total = sum(n for _, n in patterns)
    if not total:
        return {}
    belief = {tuple(v): 0.9 if v.count(1) > v.count(0) else 0.1 if v.count(0) > v.count(1) else 0.3 for v in (list(v) for v, _ in patterns)}
    for _ in range(rounds):
        prior = (sum(n * belief[tuple(v)] for v, n in patterns) + 1) / (total + 2)
        chance = []
        for k in range(len(patterns[0][0])):
            both = []
            for side in (0, 1):
                seen = {a: 1.0 for a in (-1, 0, 1)}
                for v, n in patterns:
                    seen[v[k]] += n * (belief[tuple(v)] if side else 1 - belief[tuple(v)])
                whole = sum(seen.values())
                both.append({a: x / whole for a, x in seen.items()})
            chance.append(both)
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k][1][a] / chance[k][0][a]) for k, a in enumerate(v) if a >= 0)
            belief[tuple(v)] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def fit_classifier(rows: Sequence[tuple[Sequence[int], float, float]], rounds: int = FIT_ROUNDS) -> list[float]:
    """Weights and, last, the constant of a logistic model of (shape, sum of beliefs, count)."""
    total = sum(n for _, _, n in rows)
    width = len(rows[0][0]) if rows else 0
    weights = [0.0] * (width + 1)
    for _ in range(rounds if total else 0):
        slope = [0.0] * (width + 1)
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, weights[-1] + sum(w for w, a in zip(weights, x, strict=False) if a)))))
            for k, a in enumerate((*x, 1)):
                if a:
                    slope[k] += y - n * p
        weights = [w + 2.0 * (s / total - 1e-4 * w) for w, s in zip(weights, slope, strict=True)]
    return weights


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id) of ``docs``, and their spans: row, kind (number in KINDS), start, end in characters, probability (1 for exact ones)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return _spans(rows)


def _spans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of row, doc_id, text; they are read once, and written down with their matches."""
    at_sign, digit = F.contains("text", F.lit("@")), F.col("text").rlike("[0-9]")
    matches = [
        _matches(0, EMAIL, at_sign), _matches(1, IP, digit & F.col("text").rlike(r"[0-9]\.[0-9]")), _matches(2, CARD, digit),
        _matches(3, PHONE, F.contains("text", F.lit("+"))), _matches(4, TOKEN, digit | at_sign),
    ]
    rows = keep(rows.select("row", "doc_id", F.when(digit | at_sign, F.array_compact(F.array(*matches))).alias("matches")))
    found = rows.select("row", F.explode("matches").alias("some")).select("row", F.inline("some"))
    before_it = Window.partitionBy("row", "kind").orderBy("place")
    placed = found.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(before_it)).withColumn("start", F.col("end") - F.length("hit"))
    right = F.when(F.col("kind") == 1, _valid("ip", F.col("hit"))).when(F.col("kind") == 2, _valid("card", F.col("hit"))).when(F.col("kind") == 3, _valid("phone", F.col("hit")))
    candidate = F.contains("hit", F.lit("@")) | (F.length(_digits(F.col("hit"))) >= 3)
    around = (F.col("hit"), F.col("before"), F.col("after"))
    judged = placed.where(right.when(F.col("kind") == 4, candidate).otherwise(F.lit(True))).select(
        "row", "kind", "start", "end",
        F.when(F.col("kind") == 4, F.array(*votes(*around))).alias("votes"), F.when(F.col("kind") == 4, F.array(*shapes(*around))).alias("shape"),
    )
    judged = keep(judged)
    counted = [(r["votes"], r["shape"], r["n"]) for r in judged.where("kind = 4").groupBy("votes", "shape").agg(F.count("*").alias("n")).orderBy("votes", "shape").collect()]
    by_vote: dict[tuple, int] = {}
    for v, _, n in counted:
        by_vote[tuple(v)] = by_vote.get(tuple(v), 0) + n
    belief = reliabilities([(list(v), n) for v, n in by_vote.items()])
    by_shape: dict[tuple, list[float]] = {}
    for v, s, n in counted:
        sums = by_shape.setdefault(tuple(s), [0.0, 0.0])
        sums[0] += n * belief[tuple(v)]
        sums[1] += n
    weights = fit_classifier([(s, y, n) for s, (y, n) in by_shape.items()])
    odds = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        odds = odds + F.get("shape", F.lit(k)) * F.lit(w)
    judged = judged.select("row", "kind", "start", "end", F.when(F.col("kind") == 4, 1 / (1 + F.exp(-odds))).otherwise(F.lit(1.0)).alias("probability"))
    exact = F.col("kind") < 4
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    earlier = F.max(F.when(exact, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(exact, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    judged = judged.withColumns({"earlier": earlier, "later": later})
    free = (F.coalesce("earlier", F.lit(0)) <= F.col("start")) & (F.coalesce("later", F.col("end")) >= F.col("end"))
    return rows.select("row", "doc_id"), judged.where(exact | ((F.col("probability") >= 0.5) & free)).drop("earlier", "later")


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: doc_id, spans (array of kind, start, end, probability; by kind, then start).

    Characters count as code points, ends are exclusive. Matches of one pattern don't overlap, those of
    several may; an exact match that fails its check is dropped and nothing is tried again inside it. Null
    and empty texts have no spans, repeated rows each get a row, other columns are not read.
    """
    rows, found = spans(docs, id_column, text_column)
    one = F.struct(F.col("kind").alias("rank"), "start", "end", "probability")
    listed = found.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform("spans", lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["probability"].alias("probability")))
    none = F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint,probability:double>>)")
    return rows.join(listed, "row", "left").select("doc_id", F.coalesce(named, none).alias("spans"))


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with the text's spans replaced by their kind in brackets; of spans that overlap the first is taken, and the next from where it ended."""
    row = "row number of redaction"
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    _, found = _spans(numbered.select(F.col(row).alias("row"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    listed = found.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans found"))
    names = F.array(*map(F.lit, KINDS))
    text = F.coalesce(F.col(text_column), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    walked = F.aggregate(
        "spans found", start,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.get(names, s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return numbered.join(listed, row, "left").withColumn(text_column, F.when(F.col("spans found").isNotNull(), walked).otherwise(F.col(text_column))).drop(row, "spans found")
