"""URL rules and the two walks over host links."""

import numpy as np

from maskwright.llm import link_trust as T


def judged(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in T.judge_urls(df, **options).collect()}


def test_parts_and_rules(spark):
    urls = ["https://WWW.Example.com/en/x?q", "http://m.example.com/en/", "http://example.com", "http://example.com/", "ftp://a.net/es/1",
            "http://net/fr/", "http://xnet/fr/", "//a.com/x", None, "", "http://a.com:80/x", "x://", "http://a.org/p#f?x", "http://É.com/",
            "http://a.com/x://b.net/es/"]
    got = judged(spark, [(k, u, None) for k, u in enumerate(urls)])
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(urls))] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("m.example.com", "/en/", "example.com/en/", "block"),
        ("example.com", "", None, "allow"), ("example.com", "/", "com/", "allow"), ("a.net", "/es/1", "net/es/", "block"),
        ("net", "/fr/", "net/fr/", "block"), ("xnet", "/fr/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("a.com:80", "/x", None, "allow"), ("", "", None, "allow"), ("a.org", "/p", None, "allow"),
        ("É.com", "/", "com/", "allow"), ("a.com", "/x://b.net/es/", "com/", "allow")]


def test_a_host_that_links_to_blocked_hosts_is_blocked(spark):
    link = "<p><a class=x href='http://bad.net/es/'>x</a> <A HREF=//good.com/>y</A></p>"
    rows = [(1, "http://bad.net/es/1", None), (2, "http://farm.org/a", link.split("</a>")[0]), (3, "http://mixed.org/a", "<a href=http://good.com/>" * 9 + link),
            (4, "http://good.com/", "<a href='http://friend.org/'>"), (5, "http://friend.org/", "<a href='/in'>"), (6, "http://farm.org/b?x", None)]
    got = judged(spark, rows)
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block"}
    assert judged(spark, rows, block_score=0.1)[3].verdict == "allow"


def test_scores_equal_plain_power_iteration(spark):
    rng = np.random.default_rng(2)
    n = 12
    edges = {(int(a), int(b)): int(w) for a, b, w in zip(rng.integers(0, n, 40), rng.integers(0, n, 40), rng.integers(1, 5, 40)) if a != b}
    e = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, n long")
    s = spark.createDataFrame([("trust", "h0", 1.0), ("trust", "h3", 1.0), ("distrust", "h5", 1.0)], "kind string, host string, mass double")
    got = {(r.kind, r.host): r.score for r in T.propagate(e, s, rounds=6).collect()}
    w = np.zeros((n, n))
    for (a, b), k in edges.items():
        w[a, b] = k
    for kind, m, seeds in (("trust", w, (0, 3)), ("distrust", w.T, (5,))):
        out = m.sum(axis=1, keepdims=True)
        m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        start = np.zeros(n)
        start[list(seeds)] = 0.15
        x = start.copy()
        for _ in range(6):
            x = start + 0.85 * x @ m
        assert np.allclose([got.get((kind, f"h{k}"), 0.0) for k in range(n)], x)


def test_no_python_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "<a href=http://b.org/>")] * 2, "page_id long, url string, html string")
    for name in ("host", "path", "rule", "ruled", "bad_host", "trust"):
        df = df.withColumn(name, df.url)
    out = T.judge_urls(df)
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert T.judge_urls(df.limit(0)).count() == 0


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    rows = [(0, "http://bad.net/es/", None), (1, "http://h1.org/", "<a href=http://bad.net/>")]
    rows += [(k, f"http://h{k}.org/", f"<a href=http://h{k - 1}.org/>") for k in range(2, 19)]
    got = judged(spark, rows)
    assert [k for k in range(19) if got[k].verdict == "block"] == list(range(17))  # 0.15 * 0.85 ** 16 is above 0.01
