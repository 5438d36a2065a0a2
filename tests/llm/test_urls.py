from pyspark.sql import functions as F

from palisade.llm import url_rules

URLS = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("http://NET/", "net", "/", "net/", "block"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://planet/x", "planet", "/x", None, "allow"),
    ("https://b.example.net/en/1?x#y", "b.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/en", "example.net", "/en", "net/", "block"),
    ("https://Example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("https://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    ("https://x.org?fr/", "x.org", "", None, "allow"),
    ("ftp://h#/net/", "h", "", None, "allow"),
    ("ÄÖ://Üñ.NET/p", "Üñ.net", "/p", "net/", "block"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://a.net/x\n/y?z", "a.net", "/x\n/y", "net/", "block"),
]


def test_explicit_rules(spark):
    urls = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(URLS)] + [(None, "http://q.net/", "h", "v")], "page_id long, url string, host string, _u string")
    none = url_rules.mine(urls, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(urls, none).select("page_id", "_u.*").collect()}
    assert [got[i] for i in range(len(URLS))] == [u[1:] for u in URLS] and got[None][3] == "block"


def test_mined_rules(spark):
    rows = []
    for i in range(400):
        spam = i % 4 == 0
        rows.append((i, f"http://{'win-big' if spam else 'fine'}{'' if spam or i % 3 else i}.example.com/{'shop' if spam or i % 3 == 0 else 'news'}/{i}?ref={i}"))
    rows += [(1000, "http://win-big.example.com/shop/9"), (1001, "http://win-big.example.com/9"), (1002, "http://fine.example.com/shop/1"), (1002, "http://win-big.example.com/shop/1"), (1003, None)]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, None, None)], "doc_id long, quality int, toxic int")
    mined = url_rules.mine(urls, labels).collect()
    assert [r["items"] for r in mined] == [["h:win-big"]] and mined[0]["support"] == 100 and mined[0]["confidence"] == 1.0
    got = sorted((r["page_id"], r["url"] or "", r["verdict"]) for r in url_rules.judge(urls, url_rules.mine(urls, labels)).select("page_id", "url", "_u.verdict").collect() if r["page_id"] >= 1000)
    assert [v for _, _, v in got] == ["block", "block", "allow", "block", "allow"]


def test_empty(spark):
    urls = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert url_rules.judge(urls, url_rules.mine(urls, labels)).count() == 0


def test_many_tokens(spark):
    """A telling token counts even where 12 more frequent ones stand beside it."""
    common = "&".join(f"k{i}=1" for i in range(10))
    rows = [(i, f"http://host.zz/{'bad/' if i < 25 else ''}{i}?{common}") for i in range(100)]
    urls = spark.createDataFrame(rows + [(1000, "http://other.yy/bad/1"), (1001, "http://other.yy/1")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 30)) for i in range(100)], "doc_id long, quality int, toxic int")
    mined = url_rules.mine(urls, labels)
    assert [(r["items"], r["support"], r["confidence"]) for r in mined.collect()] == [(["p:bad"], 25, 1.0)]
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(urls, mined).select("page_id", "_u.verdict").collect()}
    assert got == {i: "block" if i < 25 or i == 1000 else "allow" for i, _ in [*rows, (1000, ""), (1001, "")]}


def test_rules_need_a_surplus(spark):
    """Tokens that hold no more bad urls than all others give no rule, however many are bad."""
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.zz/{'x' if i % 3 else 'y'}/{i}") for i in range(600)]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i * 7919 % 10 >= 6), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    assert url_rules.mine(urls, labels).count() == 0


def test_columns_of_any_name(spark):
    names = ["_u", "row", "key", "given", "hit", "k", "l", "host", "items", "_items", "_rule", "anchor", "_pl_x", "_bad"]
    urls = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.b/bad/1")], "page_id long, url string")
    wide = urls.withColumns({n: F.lit(n) for n in names})
    mined = spark.createDataFrame([(1, ["p:bad"], "p:bad", 30, 1.0)], "rule_id long, items array<string>, anchor string, support long, confidence double")
    out = url_rules.judge(wide, mined, name="verdict")
    assert out.columns == [*wide.columns, "verdict"]
    assert [(r["page_id"], *(r[n] for n in names), r["verdict"]["verdict"]) for r in out.orderBy("page_id").collect()] == [(i, *names, "block") for i in (1, 2)]
    assert url_rules.judge(wide, mined).columns == [*(c for c in wide.columns if c != "_u"), "_u"]
