"""Operator 10, URL filter: rules first, then the ratio of two character language models.

A URL that no rule decides is judged by variable-order Markov models of accepted and of rejected URLs
(those that rules decide). Contexts of up to three characters back off by Witten-Bell smoothing. The log
ratio of all characters, divided by their number, is held against a threshold that is calibrated on
URLs that the models have not seen. Ratios are summed as whole millionths, so that no order of
summing matters.

DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

ORDER = 3
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Letters the models tell: a-z, any digit as 0, . - _ / and one for all else; ^ stands before the start.
ALPHABET = 32
BINS = 100


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    return ((F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)


def decided(rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits; null if none does. Equal lengths go to the first in order of host, path, verdict."""
    ranked = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path, r.verdict))
    return F.coalesce(*(F.when(fits(r), F.lit(value(r))) for r in ranked), F.lit(None).cast("string"))


def model_text(url: str = "url") -> Column:
    """All after the first ``://``, or the whole URL if it has none, in the models' letters, after three marks of the start."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.contains(text, F.lit("://")), F.substr(text, F.locate("://", text) + 3)).otherwise(text)
    plain = F.translate(F.translate(rest, UPPER, LOWER), DIGITS, "0" * 10)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(plain, r"[^a-z0._/-]", "~"))


def grams(urls: DataFrame) -> DataFrame:
    """A row for each character with the three before it."""
    places = F.sequence(F.lit(1), F.length("model_text") - ORDER)
    some = urls.where(F.length("model_text") > ORDER)
    return some.withColumn("place", F.explode(places)).withColumn("gram", F.substring(F.col("model_text"), F.col("place"), F.lit(ORDER + 1)))


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram and millionths: the log ratio of accepted and rejected, for each of ``counts``' grams (gram, allow, block).

    Order by order: (count + kinds * lower order) / (total + kinds), where total and kinds are those of
    the context; a context never seen leaves the lower order as it is. The lowest order is uniform.
    """
    out = counts.withColumns({f"p_{k}": F.lit(1.0 / ALPHABET) for k in ("allow", "block")})
    for n in range(ORDER + 1):
        key = F.substring("gram", ORDER + 1 - n, n + 1)
        sums = counts.groupBy(key.alias("key")).agg(*(F.sum(k).alias(f"n_{k}") for k in ("allow", "block")))
        context = F.substring("key", 1, n)
        seen = sums.groupBy(context.alias("context")).agg(
            *(F.sum(f"n_{k}").alias(f"total_{k}") for k in ("allow", "block")), *(F.count_if(F.col(f"n_{k}") > 0).alias(f"kinds_{k}") for k in ("allow", "block"))
        )
        out = out.withColumn("key", key).join(sums, "key").withColumn("context", context).join(seen, "context")
        smoothed = {
            f"p_{k}": F.when(F.col(f"total_{k}") == 0, F.col(f"p_{k}")).otherwise(
                (F.col(f"n_{k}") + F.col(f"kinds_{k}") * F.col(f"p_{k}")) / (F.col(f"total_{k}") + F.col(f"kinds_{k}"))
            )
            for k in ("allow", "block")
        }
        out = out.withColumns(smoothed).select(*counts.columns, "p_allow", "p_block")
    return out.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * 1_000_000).cast("long").alias("millionths"))


def _learned(url: str) -> Column:
    """Whether the models learn from the URL; else the threshold is calibrated on it."""
    return F.left(F.md5(F.coalesce(F.col(url), F.lit(""))), F.lit(1)) > "2"


def threshold(scored: DataFrame) -> int:
    """The bin from which URLs are accepted: the one that is right most often, each label weighed the same; 0 without URLs of either label.

    All bins after one with URLs, up to the next with any, are as right; the middle of them is taken, and of several such gaps the lowest.

    ``scored``: bin and ruled ('allow' or 'block'). Counts of bins come to the driver, and there are few: a mean log ratio has 2 * BINS * 14 bins at most, as no smoothed probability is below 1e-6.
    """
    rows = scored.groupBy("bin").agg(*(F.count_if(F.col("ruled") == k).alias(k) for k in ("allow", "block"))).orderBy("bin").collect()
    accepted, rejected = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not accepted or not rejected:
        return 0
    right, best, before = accepted * rejected, None, None
    for r in rows:
        if best is None or right > best[0]:
            best = (right, r["bin"] if before is None else (before + r["bin"] + 1) // 2)
        right += r["block"] * accepted - r["allow"] * rejected
        before = r["bin"]
    return best[1]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, score.

    ``rule`` is that of the longest rule that fits, else null; ``score`` is the mean log ratio per
    character (null if a rule decides). Without a rule a URL is blocked if its score is below the
    threshold; a URL with nothing after ``://`` scores 0, and so do all if rules accept or reject no URL. Rules
    read host and path, the models all of the URL, with query and fragment. Null URLs are empty, repeated rows are
    judged each for itself, other columns are not read.
    """
    numbered = keep(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("page_id"), F.col(url_column).alias("url")))
    urls = numbered.withColumns({"host": host_of(), "path": path_of()})
    urls = urls.withColumns({"rule": decided(rules, lambda r: r.host + r.path), "ruled": decided(rules, lambda r: r.verdict), "model_text": model_text(), "learned": _learned("url")})
    count = lambda k: F.count_if((F.col("ruled") == k) & F.col("learned")).alias(k)
    counts = keep(grams(urls.select("model_text", "ruled", "learned")).groupBy("gram").agg(count("allow"), count("block")))
    #: There are never more than (ALPHABET + 1) ** 4 grams, 1.2 million rows.
    ratios = F.broadcast(keep(gram_scores(counts)))
    asked = urls.where("ruled IS NULL OR NOT learned").select("row", "ruled", "model_text")
    summed = grams(asked).join(ratios, "gram").groupBy("row").agg(F.first("ruled").alias("ruled"), (F.sum("millionths") / F.count("*") / 1_000_000).alias("score"))
    summed = keep(summed.withColumn("bin", F.floor(F.col("score") * BINS)))
    least = threshold(summed.where("ruled IS NOT NULL"))
    both = counts.agg(F.sum("allow"), F.sum("block")).first()
    if not both[0] or not both[1]:
        summed, least = summed.withColumns({"score": F.lit(0.0), "bin": F.lit(0).cast("long")}), 0
    scores = summed.where("ruled IS NULL").select("row", "score", "bin")
    judged = urls.join(scores, "row", "left").withColumns({"score": F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0))), "bin": F.coalesce("bin", F.lit(0))})
    by_model = F.when(F.col("bin") < least, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")


def allowed(pages: DataFrame, **options) -> DataFrame:
    """The judged rows that are not blocked."""
    return judge(pages, **options).where("verdict = 'allow'")
