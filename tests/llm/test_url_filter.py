import hashlib
import math

from conftest_llm import DATA, EXTRA, duck
from pyspark.sql import functions as F

from fleetcatalog.llm import queries, url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, rest = (rest[: ends[0]], rest[ends[0] :]) if ends else (rest, "")
    ends = [i for i, c in enumerate(rest) if c in "?#"]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: ends[0]] if ends else rest


def ruled(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path)) if fit else None


def plain(urls):
    """Verdicts by counting in dictionaries."""
    judged = []
    for u in urls:
        host, path = split(u)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in ((u or "").split("://", 1)[-1]))
        letters = "".join("0" if c in "0123456789" else c if c in "abcdefghijklmnopqrstuvwxyz._/-" else "~" for c in low)
        judged.append((u, host, path, ruled(host, path), "^^^" + letters if letters else "", hashlib.md5((u or "").encode()).hexdigest()[0] > "2"))
    grams = lambda t: [t[i : i + 4] for i in range(len(t) - 3)]
    count = {"allow": {}, "block": {}}
    for _, _, _, r, t, learned in judged:
        if r and learned:
            for g in grams(t):
                for n in range(4):
                    count[r.verdict][g[3 - n :]] = count[r.verdict].get(g[3 - n :], 0) + 1
    if not count["allow"] or not count["block"]:
        return [(h, p, r and r.host + r.path, r.verdict if r else "allow") for _, h, p, r, _, _ in judged]

    def chance(c, g):
        p = 1 / 32
        for n in range(4):
            next_ = {k: v for k, v in c.items() if len(k) == n + 1 and k[:n] == g[3 - n : 3]}
            total = sum(next_.values())
            if total:
                p = (next_.get(g[3 - n :], 0) + len(next_) * p) / (total + len(next_))
        return p

    known = {}

    def score(t):
        for g in grams(t):
            if g not in known:
                known[g] = round((math.log(chance(count["allow"], g)) - math.log(chance(count["block"], g))) * 1e6)
        return sum(known[g] for g in grams(t)) / len(grams(t)) / 1e6 if t else 0.0

    seen = [(math.floor(score(t) * 100), r.verdict) for _, _, _, r, t, learned in judged if r and not learned]
    accepted, rejected = sum(v == "allow" for _, v in seen), sum(v == "block" for _, v in seen)
    least = 0
    if accepted and rejected:
        right = lambda b: sum(x >= b for x, v in seen if v == "allow") * rejected + sum(x < b for x, v in seen if v == "block") * accepted
        bins = sorted({b for b, _ in seen})
        best = min(bins, key=lambda b: (-right(b), b))
        least = min((b for b in range(bins[0], best + 1) if right(b) == right(best) and (b > max([x for x in bins if x < best], default=best - 1))), default=best)
        least = (least + best) // 2 if best > bins[0] else best
    return [(h, p, r and r.host + r.path, r.verdict if r else ("block" if t and math.floor(score(t) * 100) < least else "allow" if t else ("block" if least > 0 else "allow"))) for _, h, p, r, t, _ in judged]


def got(df):
    return [(r.host, r.path, r.rule, r.verdict) for r in df.orderBy("page_id").collect()]


def table(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({n: F.lit(7) for n in EXTRA})


URLS = [
    None, "", "no scheme", "http://", "http://Net", "http://a.NET", "http://a.net/", "http://anet/", "http://x.example.net/en/1", "http://x.example.net/EN/1", "http://example.com/de/", "http://example.com/de",
    "http://w.example.org/fr/?q#f", "x://y://z/", "http://example.net?/en/", "http://example.net#/en/", "http://é.org/fr/ü", "a://b.example.com/fr/" + "9" * 20_000, "http://example.com/fr/x\ny",
]


def test_odd_urls(spark):
    assert got(url_filter.judge(table(spark, URLS))) == plain(URLS)
    assert url_filter.judge(table(spark, [])).count() == 0


def test_against_a_plain_version(spark):
    urls = [r.url for r in queries.read(spark, DATA, "pages").orderBy("page_id").collect()] + URLS + URLS[-3:]
    assert got(url_filter.judge(table(spark, urls))) == plain(urls)


def test_model_tells_unseen_hosts_apart(spark):
    urls = [f"http://good-{i}.example.org/fr/{i}" for i in range(200)] + [f"http://win-casino-{i}.example.com/de/{i}" for i in range(200)]
    new = [f"http://good-{i}.example.info/es/{i}" for i in range(20)] + [f"http://win-casino-{i}.example.info/es/{i}" for i in range(20)]
    assert [r[3] for r in got(url_filter.judge(table(spark, urls + new)))[400:]] == ["allow"] * 20 + ["block"] * 20


def test_query_and_fragment_are_judged(spark):
    """The same host and path with another query, and URLs without a scheme."""
    urls = [f"http://a.example.org/fr/{i}?ref=friend" for i in range(200)] + [f"http://a.example.com/de/{i}?win=casino" for i in range(200)]
    new = ["http://b.info/x?ref=friend", "http://b.info/x?win=casino", "http://b.info/x#win=casino", "x?ref=friend", "x?win=casino"]
    assert [r[3] for r in got(url_filter.judge(table(spark, urls + new)))[400:]] == ["allow", "block", "block", "allow", "block"]


def test_given_pages_as_in_sql(spark):
    rows = queries.op10_url_filter(spark, DATA)
    names = sorted(rows.columns)
    want = duck().execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE['op10_url_filter']})").fetchall()
    assert sorted((tuple(r) for r in rows.select(*names).collect()), key=str) == sorted(want, key=str)
