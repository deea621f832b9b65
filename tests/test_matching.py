import random
import re

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from fleetcatalog.operators.matching import _match_key, _pairs, name_resolve, port_match, regex_candidates, required_grams, route_match, route_matches

RULES = [
    ("exact", 2, "path", "/a/b", None, "/z"),
    ("get-only", 1, "path", "/a/b", "GET", None),
    ("beg", 3, "path-beg", "/a", None, "/y"),
    ("longer", 3, "path-beg", "/a/b", None, None),
    ("root", 9, "path-beg", "/", "POST", None),
    ("digits", 4, "path-regex", "^/n/[0-9]+", None, "/num"),
    ("either", 5, "path-regex", "/(x|y)/1$", None, None),
    ("optional", 6, "path-regex", "/qq?/r", None, None),
    ("class", 7, "path-regex", "/regex1/[a|b|c]", None, None),
    ("bars", 7, "path-regex", "^/n/1|/a/((x|y)|z)", None, None),
    ("nested", 7, "path-regex", "/b/((a|b)?/(1|22))+$", None, None),
    ("quoted", 7, "path-regex", r"/a\Q[\E|/b\Q]\E", None, None),
    ("star", 6, "path-regex", "^/ab*c$", None, None),
    ("any", 8, "path-regex", ".*end$", None, None),
    ("port", 0, "port", None, None, None),
]
RULE = "rule_id string, position int, kind string, value string, method string, rewrite string"
REQUEST = "request_id int, path string, method string"


def fits(rule, path, method):
    _, _, kind, value, wanted, _ = rule
    if kind == "port" or path is None or (wanted is not None and wanted != method):
        return False
    if kind == "path":
        return path == value
    if kind == "path-beg":
        return path.startswith(value)
    return re.match(python(value), path) is not None


def python(pattern):
    return pattern.replace(r"\Q[\E", r"\[").replace(r"\Q]\E", r"\]")


def test_against_all_pairs(spark):
    rng = random.Random(3)
    pieces = ["a", "b", "n", "x", "y", "q", "qq", "r", "1", "22", "ac", "abbc", "end", "b]", "a[", "regex1", "a|x", ""]
    paths = ["/" + "/".join(rng.choices(pieces, k=rng.randrange(1, 4))) for _ in range(300)] + ["", "/a/b", "/ab", None]
    requests = [(i, p, rng.choice(["GET", "POST", None])) for i, p in enumerate(paths)]
    paths = ["/a/b", "/regex1/a", "/regex1/|", "/b/a/22", "/b]", "/a[", "/x/1"]
    requests += [(len(requests) + i, p, "GET") for i, p in enumerate(paths)]
    rules = spark.createDataFrame(RULES, RULE)
    df = spark.createDataFrame(requests, REQUEST)
    expected = {(p, m, r[0]) for _, p, m in requests for r in RULES if fits(r, p, m)}
    assert {r[2] for r in expected} == {r[0] for r in RULES if r[0] != "port"}
    assert rows(route_matches(df, rules)) == sorted(expected, key=lambda r: [str(v) for v in r])

    got = {r.request_id: (r.rule_id, r.matches, r.target) for r in route_match(df, rules).collect()}
    for i, path, method in requests:
        found = sorted((r[1], -len(r[3]), r[0], r) for r in RULES if fits(r, path, method))
        if not found:
            assert got[i] == (None, 0, None)
            continue
        rule = found[0][3]
        matched = re.match(python(rule[3]), path).group() if rule[2] == "path-regex" else rule[3]
        target = path if rule[5] is None else rule[5] + path[len(matched):]
        assert got[i] == (rule[0], len(found), target)
    assert len(got) == len(requests)


def test_plain_beginnings(spark):
    patterns = {
        "^/n/[0-9]+": "/n/", "/(x|y)/1$": "/", "/regex1/[a|b|c]": "/regex1/", "/a|/b": "", "/qq?/r": "/q", "ab*c": "a",
        "/a{0,2}": "/", "/((((a|b))))c": "/", "/(((((a|b)))))c": "", r"/a\Q|\E": "", "[]|]": "", r"/a\|b": "/a", ".*": "",
    }
    df = spark.createDataFrame(list(patterns.items()), "p string, k string")
    wrong = df.withColumn("got", _match_key(F.lit("path-regex"), F.col("p"))).filter("got <> k")
    assert rows(wrong) == []


def test_no_rules(spark):
    rules = spark.createDataFrame([], RULE)
    df = spark.createDataFrame([(1, "/a", "GET")], REQUEST)
    assert rows(route_match(df, rules)) == [(1, "/a", "GET", None, 0, None)]


def test_port_match(spark):
    rules = spark.createDataFrame(
        [("b", "port", "tcp", 80), ("a", "port", "tcp", 80), ("c", "port", "udp", 80), ("d", "path", "http", None)],
        "rule_id string, kind string, family string, port int",
    )
    df = spark.createDataFrame([(1, "tcp", 80), (2, "udp", 80), (3, "tcp", 81)], "request_id int, family string, port int")
    assert rows(port_match(df, rules)) == [(1, "tcp", 80, "a", 2), (2, "udp", 80, "c", 1), (3, "tcp", 81, None, 0)]


def test_name_resolve(spark):
    names = spark.createDataFrame(
        [("this-is-long", ["1.0", "x"]), ("this-too", ["2.0"]), ("web", ["1.0"]), ("web", ["2.0"]), ("web-admin", None)],
        "name string, tags array<string>",
    )
    asked = ["t", "this-i", "web", "web-", "w", "nope", "t:2.0", "web:1.0", "web:3.0", "t:", "", "t"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    got = {r.query: tuple(r)[1:] for r in name_resolve(queries, names).collect()}
    assert got == {
        "t": ("ambiguous", None, 2),
        "this-i": ("resolved", "this-is-long", 1),
        "web": ("resolved", "web", 2),
        "web-": ("resolved", "web-admin", 1),
        "w": ("ambiguous", None, 2),
        "nope": ("missing", None, 0),
        "t:2.0": ("resolved", "this-too", 1),
        "web:1.0": ("resolved", "web", 1),
        "web:3.0": ("missing", None, 0),
        "t:": ("missing", None, 0),
        "": ("ambiguous", None, 4),
    }


GRAMS = {
    ".*end$": [["end"]], "x.*/users/[0-9]+": [["/us", "use", "ser", "ers", "rs/"]], ".*abc|.*xyz?z": [["abc"], None], ".*abc|.*wxyz": [["abc"], ["wxy", "xyz"]],
    "(a|b)cd(e|f)": None, ".*ab+cde": [["cde"]], ".*abc+d": [["abc"]], ".*abc*de": None, ".*ab(cd)?efg": [["efg"]], r".*\x41bcd": [["bcd"]], r".*\.html": [["htm", "tml"]], ".*ab{2}cde": [["cde"]],
    "(?i).*abc": None, r".*\Qabc\E": None, ".*((((a))))bcd": [["bcd"]], ".*(((((a)))))bcd": None, "": None, "a|": None, ".*": None, ".*ab": None, ".*[a]bc]": None, ".*a??bcd": [["bcd"]],
    ".*(?:ab)++cdé": [["cdé"]], ".*abc+?d": [["abc"]], r".*\p{L}abc\1def": [["abc", "def"]],
}


def test_grams_that_a_match_must_contain(spark):
    df = spark.createDataFrame([(p,) for p in GRAMS], "p string").withColumn("got", required_grams(F.col("p")))
    wanted = {p: None if g is None or None in g else g for p, g in GRAMS.items()}
    assert {r.p: r.got for r in df.collect()} == wanted


@pytest.mark.parametrize("seed", range(4))
def test_random_regexes_against_all_pairs(spark, seed):
    """Rules of all sorts, with a gram and without, against every path."""
    rng = random.Random(seed)
    plain = lambda: "".join(rng.choices("abc/", k=rng.randrange(1, 5)))

    def piece():
        return rng.choice([plain, plain, lambda: ".*", lambda: "[ab]", lambda: rng.choice("abc") + rng.choice(["?", "*", "+", "{0,2}", "+?", "{2}"]),
                           lambda: f"({plain()}|{plain()})" + rng.choice(["", "?", "+"]), lambda: r"\w", lambda: "."])()

    regexes = ["".join(piece() for _ in range(rng.randrange(1, 5))) for _ in range(150)]
    regexes = [r if rng.random() < 0.3 else rng.choice([".*", "(a|/)", ""]) + r + rng.choice(["", "|.*" + plain(), "$"]) for r in regexes]
    rules = [(str(i), 1, "path-regex", r, None, None) for i, r in enumerate(regexes)]
    paths = ["/" + "".join(rng.choices("abc/", k=rng.randrange(9))) for _ in range(150)]
    df = spark.createDataFrame([(i, p, "GET") for i, p in enumerate(paths)], REQUEST)
    expected = {(p, "GET", r[0]) for p in paths for r in rules if re.match(r[3], p)}
    assert rows(route_matches(df, spark.createDataFrame(rules, RULE))) == sorted(expected, key=lambda r: [str(v) for v in r])


def test_few_pairs_are_tested(spark):
    """A thousand regexes that begin with anything, and as many paths: under a hundredth of all pairs is looked at."""
    rules = spark.range(1000).select(F.concat(F.lit(".*/item-"), "id", F.lit("/(x|y)[0-9]*$")).alias("value")).withColumn("grams", required_grams(F.col("value")))
    paths = spark.range(1000).select(F.concat(F.lit("/shop/item-"), "id", F.lit("/x"), "id").alias("path"), F.lit("GET").alias("method"))
    pairs = regex_candidates(paths, rules)
    assert 1000 <= pairs.filter(F.rlike("path", F.col("value"))).count() <= pairs.count() < 10_000


def test_a_gram_of_every_path_is_left_alone(spark):
    """The rarest gram is chosen, also where a third of all paths is one text."""
    rules = spark.createDataFrame([(".*hot/.*cold", )], "value string").withColumn("grams", required_grams(F.col("value")))
    paths = spark.range(900).select(F.concat(F.lit("/hot/"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string"))).alias("path"), F.col("id").cast("string").alias("method"))
    paths = paths.union(spark.createDataFrame([("/hot/cold", "GET"), ("/hot/cold", "PUT")], "path string, method string"))
    assert regex_candidates(paths, rules).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_random_names_and_prefixes(spark, seed):
    """Against every name, with texts that sort by bytes and not by UTF-16, one name for a third, and equal names."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("ab\u00e9\uffee\U0001f600", k=rng.randrange(n)))
    names = [(text(6) if i % 3 else "aab", rng.choice([None, [], ["x"], ["x", "y"], [""]])) for i in range(200)] + [(None, ["x"])]
    asked = sorted({rng.choice(["", "a", text(4), "aab", names[i][0]]) + rng.choice(["", "", ":x", ":y", ":z", ":"]) for i in range(150)})
    got = {r.query: tuple(r)[1:] for r in name_resolve(spark.createDataFrame([(q,) for q in [*asked, None, "a"]], "query string"), spark.createDataFrame(names, "name string, tags array<string>")).collect()}
    assert got.pop(None) == ("missing", None, 0) and set(got) == {*asked, "a"}
    for query, found in got.items():
        prefix, colon, tag = query.partition(":")
        fit = sorted({n for n, tags in names if n is not None and n.startswith(prefix) and (not colon or tag in (tags or []))})
        one = prefix if prefix in fit else fit[0] if len(fit) == 1 else None
        assert found == ("resolved" if one is not None else "ambiguous" if fit else "missing", one, len(fit))


def test_names_are_not_joined_by_their_prefixes(spark):
    """What a plan explodes is the tags and two ends of each prefix, also where prefixes have many lengths."""
    names = spark.range(500).select(F.concat(F.lit("name-"), "id").alias("name"), F.array(F.lit("t")).alias("tags"))
    queries = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.left("name", n))).alias("query"))
    got = name_resolve(queries, names)
    assert got.filter("status = 'resolved'").count() == 500 and got.filter("query = 'name-1'").first().candidates == 111


def test_exploded_grams_are_not_broadcast(spark):
    """However small the files of rules and paths look, their grams are not sent through the driver."""
    rules = spark.range(50).select(F.concat(F.lit(".*/item-"), "id", F.lit("$")).alias("value")).withColumn("grams", required_grams(F.col("value")))
    paths = spark.range(50).select(F.concat(F.lit("/shop/item-"), "id").alias("path"), F.lit("GET").alias("method"))
    whole = spark.createDataFrame([r for r in RULES if r[2] != "port"], RULE)
    assert "Broadcast" not in _pairs(paths, whole)._jdf.queryExecution().executedPlan().toString()
    pairs = regex_candidates(paths, rules)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.filter(F.rlike("path", F.col("value"))).count() == 50


def test_long_grams_leave_hardly_any_pairs(spark):
    """Numbers of which all three digits in a row are frequent."""
    digits = F.lpad((F.col("id") * 7919 % 100_000).cast("string"), 5, "0")
    rules = spark.range(2000).select(F.concat(F.lit(".*#"), digits, F.lit("/x$")).alias("value")).withColumn("grams", required_grams(F.col("value")))
    paths = spark.range(2000).select(F.concat(F.lit("/shop#"), digits, F.lit("/x")).alias("path"), F.lit("GET").alias("method"))
    pairs = regex_candidates(paths, rules)
    assert pairs.filter(F.rlike("path", F.col("value"))).count() == 2000 and pairs.count() < 4000
