from strainshift.llm.url_trust import RULES, host_edges, judge_urls, spread


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fit = [(r, v) for r, v in RULES for name, _, p in [r.partition("/")]
           if (host == name or host.endswith("." + name)) and path.startswith("/" + p)]
    return max(fit, key=lambda x: len(x[0]), default=None)


URLS = [None, "", "no scheme", "http://ORG/", "http://a.org", "http://x.Example.org/es/1", "https://example.org/en/12?x=/y",
        "http://example.org/en/2#a/b", "http://notexample.org/es/", "ftp://a.com/fr/x", "http://com/de/", "http://a.b.com/de/q?r",
        "http://É.com/fr/", "x://y://z/w", "http://a.net/p", "http://host?q", "http://host#f", "http:///path", "a\nb://h/p"]


def test_host_path_rule(spark):
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(URLS)], "page_id int, url string, html string, host string")
    rows = {r.page_id: r for r in judge_urls(df).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        assert (rows[i].host, rows[i].path) == split(u)
        want = rule(*split(u))
        assert rows[i]["rule"] == (want and want[0])
        if want:
            assert rows[i].verdict == want[1]
    assert rows[0].verdict == "allow"
    assert judge_urls(df.limit(0)).count() == 0


def test_distrust_flows_backwards_and_trust_forwards(spark):
    pages = [(1, "http://good.org/", '<a href="http://friend.net/">f</a><a href=/self>x</a>'),
             (2, "http://friend.net/x", None),
             (3, "http://spam.net/", "<A class=x HREF='//bad.com/de/1'>b</A>"),
             (4, "http://bad.com/de/1", ""), (5, "http://bad.com/other", ""), (6, "http://alone.net/", "")]
    df = spark.createDataFrame(pages * 2, "page_id int, url string, html string")
    assert {tuple(r) for r in host_edges(df).collect()} == {("good.org", "friend.net"), ("spam.net", "bad.com")}
    got = {r.page_id: r.verdict for r in judge_urls(df).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}
    assert judge_urls(df).count() == 12


def test_spread_equals_dense_iteration(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "c")]
    seeds = [("a", 3.0, 0.0), ("c", 0.0, 2.0), ("e", 1.0, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in spread(
        spark.createDataFrame(seeds, "host string, good double, bad double"),
        spark.createDataFrame(edges, "src string, dst string"), tolerance=1e-9, rounds=200).collect()}
    nodes = "abcde"
    good, bad = ({h: next((s[k] for s in seeds if s[0] == h), 0.0) for h in nodes} for k in (1, 2))
    t, d = dict.fromkeys(nodes, 0.0), dict.fromkeys(nodes, 0.0)
    for _ in range(300):
        t, d = ({h: .15 * good[h] + .85 * sum(t[s] / sum(x == s for x, _ in edges) for s, e in edges if e == h) for h in nodes},
                {h: .15 * bad[h] + .85 * sum(d[e] / sum(y == e for _, y in edges) for s, e in edges if s == h) for h in nodes})
    for h in nodes:
        assert abs(got[h][0] - t[h]) < 1e-6 and abs(got[h][1] - d[h]) < 1e-6


def test_defaults_reach_the_end_of_a_chain_beside_much_mass(spark):
    n = 33  # more hops than 30; the mass of a host without links changes nothing
    chain = [f"h{i}" for i in range(n + 1)]
    edges = spark.createDataFrame(list(zip(chain, chain[1:])), "src string, dst string").coalesce(1)
    for heavy in (0.0, 1e9):
        seeds = spark.createDataFrame([("h0", 50.0, 0.0), (f"h{n}", 0.0, 50.0), ("alone.net", heavy, heavy)], "host string, good double, bad double")
        got = {r.host: (r.trust, r.distrust) for r in spread(seeds, edges).collect()}
        for i, h in enumerate(chain):
            assert abs(got[h][0] / (7.5 * .85 ** i) - 1) < 1e-9 and abs(got[h][1] / (7.5 * .85 ** (n - i)) - 1) < 1e-9
        assert abs(got["alone.net"][0] - .15 * heavy) <= 1e-6 * heavy


def test_verdicts_do_not_depend_on_other_pages(spark):
    pages = [("http://far.net/", "http://near.net/"), ("http://near.net/", "http://linker.net/"), ("http://linker.net/", "http://bad.com/")]
    rows = [(u, f"<a href={to}>x</a>") for u, to in pages] + [("http://bad.com/de/1", None)] * 50
    df = spark.createDataFrame(rows, "url string, html string").unionByName(
        spark.range(10000000, numPartitions=2).selectExpr("'http://alone.org/' AS url", "CAST(NULL AS string) AS html"))
    got = judge_urls(df.selectExpr("1 AS page_id", "url", "html")).where("host <> 'alone.org'").select("host", "verdict").distinct().collect()
    assert {tuple(r) for r in got} == {(h, "block") for h in ("far.net", "near.net", "linker.net", "bad.com")}


def test_links_are_href_attributes_outside_comments_and_scripts(spark):
    pages = ["<a data-href='http://no.org/'>x</a><a id=b href=http://a.org/>", "<!-- <a href='http://no.org/'> --><a title=''href='http://b.org/x'>",
             "<script>'<a href=\"http://no.org/\">'</script ><A\nHREF = 'http://c.org'>", "<a x <b href='http://no.org/'>", "<a href='http://d.org'><!-- <a href=http://no.org/>",
             "<a href='//e.org/'><script><a href='http://no.org/'>", "<a>href=http://no.org/</a>", "<!--" * 20000, "<a " * 50000]
    df = spark.createDataFrame([("http://src.net/", p) for p in pages], "url string, html string")
    assert {r.dst for r in host_edges(df).collect()} == {"a.org", "b.org", "c.org", "d.org", "e.org"}


def test_registered_query_on_hosts_with_edges(spark, tmp_path):
    from strainshift.llm.q_url_trust import op2_url_trust
    pages = [(1, "http://good.com/fr/1", "<a href='http://friend.net/'>f</a>"), (2, "http://friend.net/x", "<a href='http://far.net/'>f</a>"), (3, "http://far.net/", None),
             (4, "http://spam.net/", "<a href='http://bad.com/de/1'>b</a><a href='http://friend.net/'>f</a>"), (5, "http://farm.net/", "<a href='http://spam.net/'>s</a>"),
             (6, "http://bad.com/de/1", None), (7, "http://bad.com/x", None), (8, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in op2_url_trust(spark, str(tmp_path)).collect()}
    edges = [("good.com", "friend.net"), ("friend.net", "far.net"), ("spam.net", "bad.com"), ("spam.net", "friend.net"), ("farm.net", "spam.net")]
    hosts = {h for e in edges for h in e}
    good, bad = {"good.com": 1.0}, {"bad.com": 1.0}
    t, d = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 0.0)
    for _ in range(50):
        t, d = ({h: .15 * good.get(h, 0) + .85 * sum(t[s] / sum(x == s for x, _ in edges) for s, e in edges if e == h) for h in hosts},
                {h: .15 * bad.get(h, 0) + .85 * sum(d[e] / sum(y == e for _, y in edges) for s, e in edges if s == h) for h in hosts})
    for i, u, _ in pages:
        host, path = split(u)
        fit = rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i]["rule"]) == (host, path, fit and fit[0])
        assert rows[i].verdict == (fit[1] if fit else "block" if d.get(host, 0) > t.get(host, 0) else "allow")
    assert {i for i, r in rows.items() if r.verdict == "block"} == {4, 5, 6, 7}
