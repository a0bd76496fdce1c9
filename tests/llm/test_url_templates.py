import re

from attesta.llm import url_templates as ut

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "HTTP://B.Example.NET", "http://example.net", "https://example.net/", "x://notexample.net/en/",
    "http://example.com/de/5?x=/", "http://example.com/dex", "http://example.com/en/5#a/b", "https://www.x.org/fr/", "no scheme", "", None, "://", "a://b://c.net/x",
    "http://user@host.net:80/q", "http://h.net?x", "http://h.net#x", "http://é.NET/É?", "http://a\nb.net/x\ny", "http://net/", "http://.net/",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for r, v in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return host, path, best


def test_rules_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").withColumn("host", ut.F.lit("clash"))
    rows = ut.judge(docs, RULES).collect()
    assert len(rows) == len(URLS) + 1
    steps = lambda r: tuple(r.template.split("/")) if r.template else ()
    found = {r.page_id: expected(URLS[r.page_id])[2] for r in rows}
    want = brute_purity([(r.host, steps(r), found[r.page_id] and int(found[r.page_id][1] == "block")) for r in rows])
    for r in rows:
        host, path, best = expected(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "block" if want[r.host, steps(r)] >= 0.8 else "allow")
    assert ut.judge(docs.limit(0), RULES).count() == 0


def test_pure_templates_are_rejected(spark):
    rows = [(i, f"http://shop.com/offer/{i}", i % 3 != 0) for i in range(300)]
    rows += [(1000 + i, f"http://shop.com/news/{i}.html", False) for i in range(300)]
    rows += [(2000 + i, f"http://wide.com/{chr(97 + i % 26)}{chr(97 + i // 26)}x/page", True) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 1000 or i >= 2000)) for i, _, labelled in rows if labelled or i % 1000 < 200], "page_id long, bad int")
    got = {r.page_id: r for r in ut.judge(docs, [], labels=labels).collect()}
    assert {got[i].verdict for i in range(300)} == {"block"} and got[0].template == "offer/<n>"
    assert {got[1000 + i].verdict for i in range(300)} == {"allow"}
    assert {got[2000 + i].template for i in range(200)} == {"*/page"} and got[2000].verdict == "block"


def test_many_rules_are_joined_with_the_same_result(spark):
    """5,000 rules beside the few: the joined ones find what trying them one by one finds; of one length the last text wins."""
    more = [(f"h{i}.example.net/p{i % 7}/", "allow" if i % 2 else "block") for i in range(5000)] + [("b.c/xy", "block"), ("a.b.c/x", "allow"), ("c/", "allow")]
    urls = [*URLS, "x://h17.example.net/p3/q", "x://sub.h18.example.net/p4/", "x://h19.example.net/p0", "x://a.b.c/xyz", "x://z.c/xyz", "x://a.b.c/" + "s/" * 3000]
    docs = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", ut.host_of(ut.F.col("url")).alias("_host"), ut.path_of(ut.F.col("url")).alias("_path"))
    got = {r.page_id: r._rule for r in ut.with_rules(docs, RULES + more).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host = docs.where(f"page_id = {k}").first() if k >= len(URLS) else None
        h, p = (host._host, host._path) if host else expected(url)[:2]
        fits = [(len(r), r, v) for r, v in RULES + more if (h == r.partition("/")[0] or h.endswith("." + r.partition("/")[0])) and p.startswith("/" + r.partition("/")[2])]
        assert (tuple(got[k]) if got[k] else None) == max(fits, default=None)


def brute_purity(rows, depth=4, weight=10.0):
    """rows: (host, template, label or None) to the purity of each (host, template)."""
    labelled = [(h, t, x) for h, t, x in rows if x is not None]
    share = sum(x for *_, x in labelled) / len(labelled)
    out = {}
    for h, t, _ in rows:
        p = share
        for up in [t[:k] for k in range(min(len(t), depth) + 1)] + ([t] if len(t) > depth else []):
            own = [x for g, u, x in labelled if g == h and (u == up if len(up) > depth else u[: len(up)] == up)]
            p = (sum(own) + weight * p) / (len(own) + weight)
        out[h, t] = p
    return out


def test_purity_is_smoothed_from_the_host_down(spark):
    deep = "http://deep.com/" + "/".join("abcdefghijk")
    rows = [(i, f"http://bad.com/x/{'lm'[i % 2]}/{i}", 1 if i % 2 else None) for i in range(120)]
    rows += [(200 + i, f"{deep}/{'yz'[i % 2]}", i % 2) for i in range(80)] + [(400 + i, f"http://new.com/{i}", None) for i in range(5)]
    docs = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if x is not None], "page_id long, bad int")
    got = {r.page_id: r for r in ut.judge(docs, [], labels=labels).collect()}
    want = brute_purity([(got[i].host, tuple(got[i].template.split("/")), x) for i, _, x in rows])
    for r in got.values():
        assert abs(r.purity - want[r.host, tuple(r.template.split("/"))]) < 1e-12 and r.verdict == ("block" if r.purity >= 0.8 else "allow")
    assert got[0].verdict == "block" and got[1].verdict == "block"  # what has no labels follows the branch above it
    assert got[200].template != got[201].template and (got[200].verdict, got[201].verdict) == ("allow", "block")  # 12 segments
    assert got[400].verdict == "allow"


def test_branches_merge_where_chance_tells_them_not_apart(spark):
    bad = {"a": 0.9, "b": 0.92, "c": 0.5, "d": 0.48, "e": 0.05}
    rows = [(1000 * k + i, f"http://h.com/{name}/page", int(i < 200 * share)) for k, (name, share) in enumerate(bad.items()) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = {r.url[13]: r.template for r in ut.judge(docs, [], labels=spark.createDataFrame([(i, x) for i, _, x in rows], "page_id long, bad int")).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"] != got["e"] == "e/page"


def test_the_method_decides_on_a_whole_table(spark):
    from attesta.llm.queries import op4_url_templates

    rows = op4_url_templates(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in rows} == {"allow", "block"}
