from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from loomline.llm import urls
from loomline.llm.common import Shared
from loomline.llm.queries import URL_RULES


def test_rules(spark):
    cases = {
        "http://a.example.org/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "HTTPS://EXAMPLE.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://b.com/fr/9": ("b.com", "/fr/9", "com/fr/", "allow"),
        "http://b.com/de/9": ("b.com", "/de/9", "com/de/", "block"),
        "http://xcom/de/9": ("xcom", "/de/9", None, None),
        "http://b.com": ("b.com", "", None, None),
        "b.com/de/": ("", "", None, None),
        "http://É.COM/a\nb?c": ("É.com", "/a\nb", None, None),
        "x://y://z/": ("y:", "//z/", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(cases)] + [(None, "http://b.com", "k")], "page_id long, url string, tokens string")
    rows = urls.judge(df, URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    for i, want in enumerate(cases.values()):
        assert got[i][:3] == want[:3] and got[i][3] == (want[3] or got[i][3]) and got[i][3] in ("allow", "block")
    assert len(rows) == len(cases) + 1
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_mined_rules_against_counting(spark):
    rows = [(["a", f"n{i % 7}", "x"], "block") for i in range(40)] + [(["b", f"n{i % 7}"], "allow") for i in range(40)] + [(["a", "b"], "allow")] * 5
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), r.key) for r in urls.mine(df, Shared(spark), 0.05, 0.8).collect()}
    alone, with_v = Counter(), Counter()
    for t, v in rows:
        for k in range(1, len(t) + 1):
            for s in combinations(sorted(t), k):
                alone[s] += 1
                with_v[s, v] += 1
    conf = {(s, v): n / alone[s] for (s, v), n in with_v.items() if n >= 0.05 * len(rows) and n / alone[s] >= 0.8}
    want = {(s, v): round(c, 9) for (s, v), c in conf.items() if not any(conf.get((p, v), 0) >= c for p in combinations(s, len(s) - 1) if p)}
    assert {k: c for k, (c, _) in got.items()} == want
    for (s, _), (_, key) in got.items():
        assert alone[key,] == min(alone[x,] for x in s)


def test_mined_verdict(spark):
    known = [(i, f"http://h{i}.example.org/es/{i}") for i in range(30)] + [(i, f"http://h{i}.example.org/en/{i}2") for i in range(20, 50)]
    df = spark.createDataFrame([*known, (900, "http://q.net/es/5"), (901, "ftp://zz.net/xx/")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in urls.judge(df, URL_RULES).where(F.col("page_id") >= 900).collect()}
    assert got[900][0] == "block" and "p0:es" in got[900][1]
    assert got[901] == ("allow", None)


def test_every_token_is_mined_and_met(spark):
    deep = "/".join("abcdefgh")
    block = [(i, f"http://h{i}.example.org/es/{deep}/tell{i % 2}?" + "&".join(f"k{j}=1" for j in range(12))) for i in range(20)]
    allow = [(100 + i, f"http://h{i}.example.org/en/2{i}/{deep}?z=1") for i in range(20)]
    hosts = [(200 + i, f"http://far.a.b.c.d.e.f{i % 2}.org/q{i}") for i in range(20)] + [(300 + i, f"http://b{i}.example.org/es/w{i}") for i in range(20)]
    asked = [(900, "x://n.net/1/2/3/4/5/6/7/8/9/tell0"), (901, "x://n.net/?" + "&".join(f"o{j}" for j in range(9)) + "&k11"), (902, "x://n.net/")]
    df = spark.createDataFrame([*block, *allow, *hosts, *asked], "page_id long, url string")
    tokens = {r.page_id: set(r.t) for r in df.select("page_id", urls.tokens_of(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("t")).collect()}
    assert {"p9:tell0", "q:k11"} <= tokens[0] and {"p9:tell0", "q:o8", "q:k11"} <= tokens[900] | tokens[901]
    assert {"h:far.a.b.c.d.e.f0.org", "d0:org", "d1:f0", "d7:far"} <= tokens[200]
    got = {r.page_id: (r.verdict, r.mined) for r in urls.judge(df, URL_RULES).where("page_id >= 900").collect()}
    assert got[900] == ("block", "p9:tell0") and got[901] == ("block", "q:k11") and got[902][0] == "allow"


def test_judge_against_every_rule(spark):
    """All mined rules against all tokens, one by one: most confidence, then support, then fewest tokens, then the verdict and its tokens."""
    known = [(i, f"http://h{i % 5}.example.org/{'es' if i % 3 else 'en'}/{i % 4}/s{i % 7}.html?a={i}") for i in range(90)] + [(200 + i, f"http://w{i % 3}.com/{'de' if i % 2 else 'fr'}/{i % 4}/s{i % 5}") for i in range(60)]
    asked = [(900 + i, f"http://h{i % 5}.w{i % 3}.net/{'es' if i % 2 else 'x'}/{i % 4}/s{i % 7}{'.html' if i % 3 else ''}") for i in range(40)]
    df = spark.createDataFrame([*known, *asked, (999, "http://" + "a." * 20_000 + "net/" + "b/" * 20_000)], "page_id long, url string")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    src = df.withColumn("t", urls.tokens_of(F.col("url"), host, path)).withColumn("at", urls.fitting(URL_RULES, host, path))
    of = F.when(F.col("at").isin(0, 3), "allow").otherwise("block")
    rules = urls.mine(src.where("at is not null").select(F.col("t").alias("tokens"), of.alias("verdict")), Shared(spark)).collect()
    assert len(rules) > 5
    got = {r.page_id: (r.verdict, r.mined) for r in urls.judge(df, URL_RULES).collect()}
    for r in src.where("at is null").collect():
        fits = [(x.confidence, x.support, -x.size, x.verdict, " ".join(x.tokens)) for x in rules if set(x.tokens) <= set(r.t)]
        assert got[r.page_id] == (max(fits)[3:] if fits else (urls.DEFAULT, None))


def test_tokens_of_the_same_urls(spark):
    rows = [([*(f"k{j}" for j in range(30)), f"n{i % 3}", "x"], "block" if i % 3 else "allow") for i in range(30)] + [(["x", f"n{i % 3}"], "allow") for i in range(30)]
    got = {(tuple(r.tokens), r.verdict, round(r.confidence, 9)) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), Shared(spark), 0.05, 0.8).collect()}
    assert got == {(("n0",), "allow", 1.0), *((tuple(sorted((f"k{j}", f"n{i}"))), "block", 1.0) for j in range(30) for i in (1, 2))}
