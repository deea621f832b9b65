"""Requests matched to route rules, and short names to known names.

A prefix test as a join condition has no key to shuffle by. Instead the longer text is turned
into its own prefixes, of the lengths that occur on the other side, and joined by equality.

A regex without a plain beginning has no such prefix. It is looked up by a text of three or six characters
that any match must contain: of all that it has, the one that is in the fewest paths.

Short names are counted by rank, in one order of names and prefixes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import durable, prefixed, running_total, same


def _prefixes(text: Column, lengths: Column) -> Column:
    fitting = F.filter(lengths, lambda n: n <= F.length(text))
    return F.transform(fitting, lambda n: F.left(text, n))


def _lengths(df: DataFrame, text: str) -> Column:
    """Distinct lengths that occur, as one array. It has no more items than the longest text has characters."""
    return df.select(F.collect_set(F.length(text))).scalar()


def _anchored(pattern: Column) -> Column:
    return F.concat(F.lit("^(?:"), pattern, F.lit(")"))


# Groups nested deeper than this are not looked into.
GROUP_DEPTH = 4

# Keys so short that very many paths begin with them are dealt over buckets of paths, so many for each
# partition that their hashes fill all alike.
SHORT, BUCKETS_EACH = 1, 16

# Characters of a text that a regex is looked up by; the longer ones, where it has any, are in far fewer paths.
GRAM, LONG_GRAM = 3, 6

# What stands in a regex for more or less than itself, in the order in which it is taken out.
ESCAPES = r"(?s)\\(?:x\{[^}]*\}|x..|u....|[pPN]\{[^}]*\}|[pP].|k<[^>]*>|c.|0[0-7]{1,3}|[1-9][0-9]*|.)"
CLASSES = r"\[[^\[\]]*\]"
GROUPS = r"\([^()]*\)"
OPTIONAL = r"(?s).(?:[*?]|\{[^}]*\})[+?]?"
REPEATED = r"(?s)(.)\+[+?]?"
ANY = r"[\^$.]"


def _grams(text: Column, size: int = GRAM) -> Column:
    """All runs of ``size`` characters of a text, each once."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def _all_grams(text: Column) -> Column:
    return F.concat(_grams(text), _grams(text, LONG_GRAM))


def required_grams(pattern: Column, of: Callable[[Column], Column] = _grams) -> Column:
    """For each alternative of a regex the grams that all its matches contain; null if one has none, or it can't be told.

    All that is no plain text is taken out and cuts what is around it: escapes, classes, groups,
    what a quantifier makes optional, anchors and dots. A character that is there once or more is
    kept and ends its run. Groups with flags, quotes, and groups nested deeper than ``GROUP_DEPTH``
    can't be told.
    """
    left = F.regexp_replace(F.regexp_replace(pattern, ESCAPES, "\n"), CLASSES, "\n")
    for _ in range(GROUP_DEPTH):
        left = F.regexp_replace(left, GROUPS, "\n")
    unclear = left.rlike(r"[()\[\]]") | pattern.rlike(r"\(\?[a-zA-Z-]") | F.contains(pattern, F.lit(r"\Q"))
    left = F.regexp_replace(F.regexp_replace(left, OPTIONAL, "\n"), REPEATED, "$1\n")
    runs = F.transform(F.split(F.regexp_replace(left, ANY, "\n"), r"\|"), lambda alternative: F.split(alternative, "\n"))
    grams = F.transform(runs, lambda run: F.array_distinct(F.flatten(F.transform(run, lambda text: of(text)))))
    return F.when(~unclear & F.forall(grams, lambda g: F.size(g) > 0), grams)


def _buckets(df: DataFrame) -> int:
    return BUCKETS_EACH * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bucket(key: Column, path: Column, buckets: int) -> Column:
    return F.when(F.length(key) <= SHORT, F.pmod(F.xxhash64(path), F.lit(buckets))).otherwise(F.lit(0).cast("long"))


def _match_key(kind: Column, value: Column) -> Column:
    """Text a path must begin with to match at all.

    For a regex, its leading plain characters, less one that a quantifier makes optional. There
    are none if it may have alternatives outside of all groups: classes and groups are taken out,
    and what is left must have no bar and no bracket.
    """
    literal = F.regexp_extract(value, r"^\^?((?:[A-Za-z0-9/_-](?![*?{]))*)", 1)
    left = F.regexp_replace(F.regexp_replace(value, r"\\.", ""), r"\[[^\]]*\]", "")
    for _ in range(GROUP_DEPTH):
        left = F.regexp_replace(left, r"\([^()]*\)", "")
    unclear = left.rlike(r"[|()\[\]]") | F.contains(value, F.lit(r"\Q"))
    plain = F.when(unclear, F.lit("")).otherwise(literal)
    return F.when(kind == "path-regex", plain).otherwise(value)


PAIR = ("path", "method", "rule_id", "position", "kind", "value", "rewrite")


def regex_candidates(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``(path, method)`` with the rules one of whose chosen grams is in the path, once for each rule.

    ``rules`` has ``value`` and ``grams`` (see ``required_grams``). For each alternative the gram is
    chosen that is in the fewest paths, so a frequent one costs tests only where a rule has no other.
    Paths are read twice, to count their grams and to look the chosen ones up; a path
    that has the grams of several alternatives is taken at the first.

    Sides that are made of exploded grams are far larger than the files they are read from, by which the
    planner would broadcast them through the driver, so they are merged instead.
    """
    longer = required_grams(F.col("value"), _all_grams)
    numbered = durable(rules.withColumns({"_rule": F.monotonically_increasing_id(), "grams": F.coalesce(longer, "grams")}))
    asked = numbered.select("_rule", F.posexplode("grams").alias("_alternative", "_grams")).select("_rule", "_alternative", F.explode("_grams").alias("_gram"))
    held = paths.select("path", "method", F.explode(_all_grams(F.col("path"))).alias("_gram"))
    # Grams are counted before they are shuffled.
    counts = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = asked.join(counts.hint("merge"), "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
    rarest = counted.groupBy("_rule", "_alternative").agg(F.min(F.struct("_n", "_gram")).alias("_least"))
    # A gram that no path has rules its alternative out.
    listed = rarest.filter("_least._n > 0").groupBy("_rule").agg(F.array_sort(F.collect_list(F.struct("_alternative", "_least._gram"))).alias("_chosen"))
    each = listed.select("_rule", F.transform("_chosen", lambda c: c["_gram"]).alias("_all")).select("_rule", "_all", F.posexplode("_all").alias("_at", "_gram"))
    keyed = numbered.drop("grams").join(each.select("_rule", "_gram", F.slice("_all", F.lit(1), F.col("_at")).alias("_earlier")).hint("merge"), "_rule")
    found = held.join(durable(keyed).hint("merge"), "_gram")
    first = ~F.exists("_earlier", lambda g: F.contains(F.col("path"), g))
    return found.filter(first).drop("_gram", "_earlier", "_rule")


def _pairs(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``(path, method)`` joined with the rules that match it."""
    key = _match_key(F.col("kind"), F.col("value"))
    rules = rules.filter(F.col("kind").isin("path", "path-beg", "path-regex")).select(
        "rule_id",
        "position",
        "kind",
        "value",
        F.col("method").alias("rule_method"),
        "rewrite",
        (F.col("kind") == "path").alias("whole"),
        key.alias("key"),
        F.when((F.col("kind") == "path-regex") & (F.length(key) <= SHORT), required_grams(F.col("value"))).alias("grams"),
    )
    rules = durable(rules)
    keyed, by_gram = rules.filter(F.col("grams").isNull()).drop("grams"), rules.filter(F.col("grams").isNotNull()).drop("key", "whole")
    # The few rules with short keys stand in every bucket, each path in the one of its hash.
    buckets = _buckets(paths)
    spread = F.when(~F.col("whole") & (F.length("key") <= SHORT), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))
    # Plain paths are looked up as a whole, so their many lengths add no prefixes.
    lengths = _lengths(keyed.filter(~F.col("whole")), "key")

    def lookup(whole: bool, key: Column) -> Column:
        return F.struct(F.lit(whole).alias("whole"), key.alias("key"))

    heads = paths.withColumn("_lengths", lengths).select(
        "path",
        "method",
        F.inline(
            F.concat(
                F.array(lookup(True, F.col("path"))),
                F.transform(_prefixes(F.col("path"), F.col("_lengths")), lambda key: lookup(False, key)),
            )
        ),
    )
    # Equal keys and grams are a match but for a regex, of which only a part has been compared. One
    # that has neither is tested against every distinct path; nothing else would be exact.
    fits = (F.col("kind") != "path-regex") | F.rlike("path", _anchored(F.col("value")))
    allowed = F.col("rule_method").isNull() | (F.col("rule_method") == F.col("method"))
    heads = heads.withColumn("bucket", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(_bucket(F.col("key"), F.col("path"), buckets)))
    keyed = keyed.withColumn("bucket", F.explode(spread.cast("array<bigint>")))
    # Both sides are exploded, so neither is broadcast (see ``regex_candidates``).
    found = heads.join(keyed.hint("merge"), ["whole", "key", "bucket"]).filter(fits & allowed).select(*PAIR)
    if by_gram.isEmpty():
        return found
    return found.unionByName(regex_candidates(paths, by_gram).filter(fits & allowed).select(*PAIR))


def _matched(kind: Column, value: Column, path: Column) -> Column:
    """The part of the path that the rule matched, always at its start."""
    return F.when(kind == "path-regex", F.regexp_substr(path, _anchored(value))).otherwise(value)


def _rewritten(path: Column, matched: Column, rewrite: Column) -> Column:
    rest = F.substr(path, F.length(matched) + 1)
    return F.when(rewrite.isNull(), path).otherwise(F.concat(rewrite, rest))


def route_matches(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule that matches each distinct request: ``(path, method, rule_id)``.

    ``requests`` has ``path`` and ``method``, ``rules`` is ``(rule_id, position, kind, value,
    method, rewrite)``. Plain paths match as a whole, prefixes by character, regexes from the
    start of the path. Equal requests are matched, and listed, once.
    """
    return _pairs(requests.select("path", "method").distinct(), rules).select("path", "method", "rule_id")


def route_match(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule for each request, the number of rules that match it, and the path as rewritten.

    The rule is that with the lowest position, then the longest value, then the lowest id. A
    request that no rule matches has null and 0. Matches are reduced to one row per path in the
    stage that finds them, so a rule that fits every path costs one row of state each.
    """
    distinct = requests.select("path", "method").distinct()
    rank = F.struct("position", (-F.length("value")).alias("len"), "rule_id")
    best = (
        _pairs(distinct, rules)
        .groupBy("path", "method")
        .agg(
            F.min_by(F.struct("rule_id", "kind", "value", "rewrite"), rank).alias("b"),
            F.count(F.lit(1)).alias("matches"),
        )
        .select("path", "method", "matches", "b.*")
    )
    best = prefixed(best, ["path", "method"], "_b_")
    on = same([(F.col("path"), F.col("_b_path")), (F.col("method"), F.col("_b_method"))])
    joined = requests.join(best, on, "left")
    matched = _matched(F.col("kind"), F.col("value"), F.col("path"))
    return joined.select(
        "request_id",
        "path",
        "method",
        "rule_id",
        F.coalesce("matches", F.lit(0).cast("long")).alias("matches"),
        F.when(F.col("rule_id").isNotNull(), _rewritten(F.col("path"), matched, F.col("rewrite"))).alias("target"),
    )


def port_match(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule for the port of each TCP or UDP request ``(request_id, family, port)``, and how many there are.

    The rule is that with the lowest id. Rules are reduced to one row per port before the join,
    so a port that very many of them name is one row.
    """
    by_port = (
        rules.filter(F.col("kind") == "port")
        .groupBy("family", "port")
        .agg(F.min("rule_id").alias("rule_id"), F.count(F.lit(1)).alias("matches"))
    )
    return requests.join(by_port, ["family", "port"], "left").select(
        "request_id", "family", "port", "rule_id", F.coalesce("matches", F.lit(0).cast("long")).alias("matches")
    )


def name_resolve(queries: DataFrame, names: DataFrame) -> DataFrame:
    """What each short name stands for: ``(query, status, name, candidates)``.

    ``queries`` is ``(query)``: a prefix of a name, ``prefix:tag`` to narrow to names with that
    tag. ``names`` is ``(name, tags)``. One name beginning so resolves it; an exact name wins
    over being a prefix of others; several are ambiguous, none is missing.

    Names and asked prefixes are put into one order, by bytes. All names that begin with a prefix stand
    between it and it with a byte that no text has, so their count is the difference of two ranks, and the
    first of them, the exact one if there is one, is at the rank after the prefix. What is shuffled is
    a row per name and tag and two per prefix, whatever their lengths, and no prefix meets its names.
    """
    asked = queries.select("query").distinct().select(
        "query",
        F.substring_index("query", ":", 1).alias("prefix"),
        F.when(F.contains(F.col("query"), F.lit(":")), F.regexp_extract("query", r"(?s)^[^:]*:(.*)\z", 1)).alias("tag"),
    )
    untagged = names.select("name", F.lit(None).cast("string").alias("tag"))
    tagged = names.select("name", F.explode("tags").alias("tag"))
    known = untagged.unionByName(tagged).filter(F.col("name").isNotNull()).distinct()
    ends = F.array(
        F.struct(F.col("prefix").cast("binary").alias("place"), F.lit(0).alias("kind")),
        F.struct(F.concat(F.col("prefix").cast("binary"), F.lit(bytearray(b"\xff"))).alias("place"), F.lit(2).alias("kind")),
    )
    markers = asked.select("prefix", "tag").distinct().filter(F.col("prefix").isNotNull())
    rows = known.select(F.col("name").alias("text"), "tag", F.col("name").cast("binary").alias("place"), F.lit(1).alias("kind")).unionByName(
        markers.select(F.col("prefix").alias("text"), "tag", F.inline(ends))
    )
    ranked = running_total(rows.withColumn("one", (F.col("kind") == 1).cast("long")), ["tag"], ["place", "kind", "text"], "rank", "one")
    ranked = durable(ranked.select("text", "tag", "kind", "rank"))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rank")))
    counted = ranked.filter("kind <> 1").groupBy(F.col("text").alias("_c_prefix"), F.col("tag").alias("_c_tag")).agg(at(0).alias("start"), at(2).alias("end"))
    counted = counted.select("_c_prefix", "_c_tag", (F.col("end") - F.col("start")).alias("candidates"), (F.col("start") + 1).alias("next")).filter("candidates > 0")
    firsts = ranked.filter("kind = 1").select(F.col("text").alias("first"), F.col("tag").alias("_f_tag"), F.col("rank").alias("_f_rank"))
    found = counted.join(firsts, (F.col("next") == F.col("_f_rank")) & F.col("_c_tag").eqNullSafe(F.col("_f_tag")))
    joined = asked.join(found, (F.col("prefix") == F.col("_c_prefix")) & F.col("tag").eqNullSafe(F.col("_c_tag")), "left")
    resolved = (F.col("first") == F.col("prefix")) | (F.col("candidates") == 1)
    status = F.when(F.col("candidates").isNull(), "missing").when(resolved, "resolved").otherwise("ambiguous")
    return joined.select(
        "query",
        status.alias("status"),
        F.when(resolved, F.col("first")).alias("name"),
        F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"),
    )
