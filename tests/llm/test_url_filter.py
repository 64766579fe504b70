import hashlib
import math
import random
import re
from collections import Counter

from recspark.llm.url_filter import RULES, judge, likelihoods, positions


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = []
    for verdict, rule in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def plain(pages, rules=RULES, order=4, smoothing=2.0):
    rows = []
    for key, url in pages:
        host, path = parts(url)
        rows.append((key, url or "", host, path, *rule_of(host, path, rules), url is not None and hashlib.md5(url.encode()).hexdigest()[0] in "012"))
    seen = {"allow": Counter(), "block": Counter()}

    def grams(url):
        padded = "\x02" * order + url + "\x03"
        return [padded[i : i + order + 1] for i in range(len(url) + 1)]

    for _, url, _, _, _, given, held in rows:
        if given and not held:
            for gram in grams(url):
                for i in range(order + 1):
                    seen[given][gram[i:]] += 1  # the last character after a context of each length
                    seen[given]["context", gram[i:-1]] += 1

    def probability(kind, gram):
        p = 1 / 256
        for i in range(order, -1, -1):
            p = (seen[kind][gram[i:]] + smoothing * p) / (seen[kind]["context", gram[i:-1]] + smoothing)
        return p

    scored = []
    for row in rows:
        ws = [math.floor(1000 * math.log(probability("allow", g) / probability("block", g))) for g in grams(row[1])]
        scored.append((*row, math.floor(sum(ws) / len(ws))))
    held = [(max(min(r[7], 10000), -10000), r[5]) for r in scored if r[6] and r[5]]
    a, b = sum(g == "allow" for _, g in held), sum(g == "block" for _, g in held)
    least = 0
    if a and b:
        met = sorted({s for s, _ in held})
        # Every score is a threshold: those from one that occurs (not included) to the next judge alike.
        near = [min(range(below + 1, v + 1), key=lambda x: (abs(x), -x)) for below, v in zip([min(met[0], 0) - 1, *met], met)]
        share = {v: sum(s >= v and g == "allow" for s, g in held) / a + sum(s < v and g == "block" for s, g in held) / b for v in near}
        least = max(share, key=lambda v: (share[v], -abs(v), v))
    return sorted(((r[0], r[2], r[3], r[4], r[5] or ("allow" if r[7] >= least else "block"), r[7]) for r in scored), key=str)


def sample():
    rng = random.Random(4)
    hosts = ["a.example.com", "www.example.com", "example.com", "x.net", "news.net", "net", "wide.org", "spam.org", "com", "WWW.Example.COM", "notcom", "x.com:80", "é.org"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/es/a', '/fr/', '/en', '/de/é😀'])}{rng.choice(['', '?q=/en/', '#x', '1/2'])}" for _ in range(400)]
    urls += [None, "", "no scheme/en/", "://", "x://", "a://b://c.com/", "http:///en/", "http://a.com/\n/x", "http://y.org/" + "long/" * 4000, "😀"]
    return [(None if i % 97 == 0 else i, u) for i, u in enumerate(urls)] + [(1, urls[1])] * 3


def test_verdicts_equal_plain(spark):
    pages = sample()
    df = spark.createDataFrame([(k, u, "h", 1, "r") for k, u in pages], "page_id long, url string, html string, row int, rule string").repartition(4)
    got = judge(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(pages)


def test_other_rules_and_orders(spark):
    pages = sample()[:150]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rules = (("block", "org/"), ("allow", "wide.org/"), ("allow", "net/it's/"))
    assert sorted((tuple(r) for r in judge(df, rules, order=2, smoothing=0.5).collect()), key=str) == plain(pages, rules, 2, 0.5)
    assert {r.verdict for r in judge(df, ()).collect()} == {"allow"}
    assert judge(df.limit(0)).collect() == []


def test_seldom_grams_meet_by_shuffle_with_the_same_sums(spark):
    urls = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}") for i in range(60)], "row long, url string")
    weights = positions(urls).groupBy("gram").count().selectExpr("gram", "count as n", "length(gram) + ascii(right(gram, 1)) as weight")
    want = sorted(likelihoods(urls, weights, hot=10**9).collect())
    assert sorted(likelihoods(urls, weights, hot=30).collect()) == want == sorted(likelihoods(urls, weights, hot=1).collect())


def test_models_catch_rejected_kinds(spark):
    rng = random.Random(2)
    words = ["news", "wiki", "blog", "home"], ["pills", "casino", "winbig", "xxl"]
    pages = []
    for i in range(600):
        bad = i % 2
        zone = ("good.com" if not bad else "bad.net") if i < 400 else "other.org"
        pages.append((i, f"http://{rng.choice(words[bad])}{rng.randrange(99)}.{zone}/{rng.choice(words[bad])}/{i}"))
    got = judge(spark.createDataFrame(pages, "page_id long, url string"), (("allow", "good.com/"), ("block", "bad.net/"))).where("rule is null").collect()
    assert len(got) == 200 and sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 190


def test_main_path_has_no_python(spark):
    plan = positions(spark.createDataFrame([(1, "u")], "row long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
