import random

from pyspark.sql import functions as F

from sealwright.llm import queries, urls
from tests import oracle


def plain(host, path, rules):
    """The winning rule's name and verdict, by trying all rules."""
    fit = [r for r in rules if r.host and host and (host == r.host.lower() or host.endswith("." + r.host.lower())) and path.startswith(r.path)]
    if not fit:
        return None, None
    r = max(fit, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"))
    return r.host.lower() + r.path, r.verdict


def some_rules(r, n):
    label = lambda: r.choice("abcA")
    return [urls.Rule(r.choice(("allow", "block")), ".".join(label() for _ in range(r.randrange(1, 4))), "/" * r.randrange(2) + "".join(r.choice("xy/") for _ in range(r.randrange(3)))) for _ in range(n)]


def some_urls(r, n):
    hosts = [".".join(r.choice("abc") for _ in range(r.randrange(1, 5))) if r.random() < 0.9 else "" for _ in range(n)]
    return hosts, ["/" * r.randrange(2) + "".join(r.choice("xy/") for _ in range(r.randrange(4))) for _ in hosts]


def test_sweep_against_brute_force():
    r = random.Random(2)
    for _ in range(80):
        rules = some_rules(r, r.randrange(14))
        hosts, paths = some_urls(r, 80)
        got = urls.Swept(urls.tidy(rules)).match(hosts, paths)
        assert got == [plain(h, p, rules) for h, p in zip(hosts, paths)]


def test_ranges_of_rules(spark, monkeypatch):
    """The result is the same for whatever number of rules a range holds, a range's urls in one task or many."""
    r = random.Random(3)
    hosts, paths = some_urls(r, 400)
    full = [(f"http://{h.upper() if i % 2 else h}{p if p.startswith('/') else '/' + p}?q" if h else None) for i, (h, p) in enumerate(zip(hosts, paths))]
    df = spark.createDataFrame(list(enumerate(full)), "page_id int, url string").withColumn("range", F.lit("clash")).withColumn("key", F.lit(0))
    rules = [urls.Rule("allow", "X.com", "/"), urls.Rule("block", "x.com", "/"), *some_rules(r, 60), urls.Rule("block", None, "/"), urls.Rule("block", "a", None)]
    want = sorted(map(str, urls.judge(df, rules).select("page_id", "__url").collect()))
    by = {i: urls.judge(df, rules).where(F.col("page_id") == i).first()["__url"] for i in (0, 1, 2)}
    used = [x for x in rules if x.host and x.path is not None]
    assert all((v.rule, v.verdict if v.rule else None) == plain(v.host, v.path, used) for v in by.values())
    for chunk, pairs in ((1, 500_000), (2, 7), (17, 40)):
        monkeypatch.setattr(urls, "PAIRS", pairs)
        assert sorted(map(str, urls.judge(df, rules, chunk=chunk).select("page_id", "__url").collect())) == want
    assert urls.judge(df.limit(0), rules, chunk=2).count() == 0


def test_a_million_rules():
    """Sorting and sweeping a million rules, and merging urls with them, takes seconds, not a walk over all rules a batch."""
    rules = [urls.Rule("block", f"h{i}.site{i % 9973}.com", "/a/") for i in range(1_000_000)]
    swept = urls.Swept(urls.tidy(rules)[: urls.CHUNK])
    hosts = [f"www.h{i}.site{i % 9973}.com" for i in range(0, 1_000_000, 100)]
    got = swept.match(hosts, ["/a/b"] * len(hosts))
    keys = set(swept.keys)
    assert [g[0] is not None for g in got] == [urls.canonical(h[4:]) in keys for h in hosts]


def test_odd_rows(spark):
    rows = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com", "x://y://z/p", "http://exämple.com/É", "http://a.example.com/en/" + "q" * 100_000, "http://notexample.com/en/", "http://x.net/es/1#a", "http://x.net/es/1#a", "http://Ä.net/fr/\n2"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = [r["__url"] for r in urls.judge(df, queries.URL_RULES).orderBy("page_id").collect()]
    assert [(g.host, g.path) for g in got[:4]] == [("", "")] * 4
    assert tuple(got[4]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert tuple(got[5]) == ("example.com", "", None, "allow")
    assert (got[6].host, got[6].path) == ("y:", "//z/p")
    assert (got[7].host, got[7].path, got[7].rule) == ("exämple.com", "/É", "com/")
    assert got[8].rule == "example.com/en/" and got[8].verdict == "block"
    assert got[9].rule == "com/" and got[10] == got[11] and got[10].verdict == "block"
    assert (got[12].host, got[12].path, got[12].rule) == ("Ä.net", "/fr/\n2", "net/fr/")
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0
    assert {r["__url"].verdict for r in urls.judge(df, []).collect()} == {"allow"}


def test_query(spark):
    oracle.check(queries.op7_url_filter(spark, oracle.SMALL), queries.OP7_SQL)
