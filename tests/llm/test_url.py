import re
from collections import defaultdict

from helpers import rows_of
from pyspark.sql import functions as F

from leafmill.llm import queries, sql
from leafmill.llm.url_reputation import SUFFIXES, WEIGHTS, domain_of, reputations, site_of, suffix_of, url_filter

_LOWER = {c: c + 32 for c in range(65, 91)}
URLS = ["http://a.co.uk/x", "https://u@b.co.uk:8080/", "http://1.2.3.4/", "http://A.Example.NET/en/x?y", "https://b.example.net", "http://example.com/de/1", "http://x.org/fr/a#b", "http://org/fr/", "http://notexample.com/de/", "no scheme", None, "", "http://u:p@h.example.com:80/de/", "x://y://z/p", "http://É.example.org/FR/", "http://net.org/", "http://a.net?x", "http://\n.net/\n"]


def brute_rule(host, path):
    best = None
    for rule in queries.URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_site(host):
    return re.sub(r"\.\Z", "", re.sub(r":[0-9]*\Z", "", host.rpartition("@")[2]))


def brute_suffix(site):
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}|\[.*\]", site):
        return site
    two = ".".join(site.split(".")[-2:])
    return two if two in SUFFIXES else site.split(".")[-1]


def brute_domain(site):
    suffix = brute_suffix(site)
    return site if site == suffix else site[: -len(suffix) - 1].split(".")[-1] + "." + suffix if suffix else site[:-1].split(".")[-1] + "."


def brute_rates(hosts):
    """site -> (n, k) -> bad rate and sd by the same shrinkage, step by step."""
    levels = [lambda h: h, brute_domain, brute_suffix]
    groups = []
    for f in levels:
        g = defaultdict(lambda: [0, 0])
        for h, (n, k) in hosts.items():
            g[f(h)][0] += n
            g[f(h)][1] += k
        groups.append(g)

    def weight(g):
        rows = [(n, k) for n, k in g.values() if n]
        n, k = sum(a for a, _ in rows), sum(b for _, b in rows)
        if not n or not 0 < k < n or len(rows) < 2:
            return WEIGHTS[1]
        p = k / n
        spread = sum(a * (b / a - p) ** 2 for a, b in rows) - (len(rows) - 1) * p * (1 - p)
        room = n - sum(a * a for a, _ in rows) / n
        v = spread / room if room > 0 else 0
        return WEIGHTS[1] if v <= 0 else min(max(p * (1 - p) / v - 1, WEIGHTS[0]), WEIGHTS[1])

    w = [weight(g) for g in groups]
    n, k = (sum(x[i] for x in hosts.values()) for i in (0, 1))
    out = {}
    for h in hosts:
        m = k / n if n else 0.0
        for level in (2, 1, 0):
            a, b = groups[level][levels[level](h)]
            m = (b + w[level] * m) / (a + w[level])
        out[h] = (m, (m * (1 - m) / (hosts[h][0] + w[0] + 1)) ** 0.5)
    return out


def fixture(spark):
    pages = [(i, u) for i, u in enumerate(URLS)]
    labels = []
    for i in range(400):
        bad = (i % 40) < 35 if i % 2 else (i % 40) < 2
        pages.append((1000 + i, f"http://{'bad' if i % 2 else 'good'}{i % 6}.site{i % 3}.org/p{i}"))
        labels.append((1000 + i, bad))
    labels += [(1001, False), (None, True), (1003, None), (999_999, True)]
    pages += [(None, "http://bad1.site1.org/"), (1000, "http://good0.site0.org/again")]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS n", "'y' AS verdict")
    return df, pages, spark.createDataFrame(labels, "page_id long, bad boolean"), labels


def test_equals_brute_force(spark):
    df, pages, ldf, labels = fixture(spark)
    judged = {}
    for p, b in labels:
        if p is not None and b is not None:
            judged[p] = max(judged.get(p, 0), int(b))
    hosts = defaultdict(lambda: [0, 0])
    for p, u in pages:
        h = hosts[brute_site(brute_parts(u)[0])]
        if p in judged:
            h[0] += 1
            h[1] += judged[p]
    rates, want = brute_rates(hosts), []
    rate = sum(k for _, k in hosts.values()) / sum(n for n, _ in hosts.values())
    for p, u in pages:
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        m, sd = rates[brute_site(host)]
        want.append((p, host, path, rule, queries.URL_RULES.get(rule) or ("block" if m - 0.6745 * sd > rate else "allow"), *hosts[brute_site(host)]))
    got = rows_of(url_filter(df, ldf, queries.URL_RULES), "page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")
    assert got == sorted(want, key=repr)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    found, base = reputations(df.selectExpr("page_id", "'h' AS site"), ldf)
    assert base == rate and found.first()["n"] == sum(n for n, _ in hosts.values())


def test_sites_and_domains(spark):
    cases = [
        ("a.co.uk", "a.co.uk", "co.uk", "a.co.uk"), ("u:p@b.a.co.uk:8080", "b.a.co.uk", "co.uk", "a.co.uk"), ("co.uk", "co.uk", "co.uk", "co.uk"), ("1.2.3.4:80", "1.2.3.4", "1.2.3.4", "1.2.3.4"),
        ("[::1]:443", "[::1]", "[::1]", "[::1]"), ("x.example.net.", "x.example.net", "net", "example.net"), ("localhost", "localhost", "localhost", "localhost"), ("", "", "", ""), (".net", ".net", "net", ".net"),
    ]
    site = site_of(F.col("host"))
    df = spark.createDataFrame([(c[0],) for c in cases], "host string").withColumn("site", site).withColumn("suffix", suffix_of(F.col("site"))).withColumn("domain", domain_of(F.col("site"), F.col("suffix")))
    assert [tuple(r) for r in df.collect()] == cases
    for host, s, suffix, domain in cases:
        assert (brute_site(host), brute_suffix(s), brute_domain(s)) == (s, suffix, domain)


def test_very_long_url(spark):
    long = "http://h.example.org/" + "p" * 300_000 + "?q"
    got = url_filter(spark.createDataFrame([(1, long), (1, long), (2, "x" * 300_000)], "page_id long, url string"), spark.createDataFrame([(1, True)], "page_id long, bad boolean"), queries.URL_RULES).collect()
    assert sorted((r["page_id"], r["host"], len(r["path"]), r["n_labelled"]) for r in got) == [(1, "h.example.org", 300_001, 2), (1, "h.example.org", 300_001, 2), (2, "", 0, 0)]


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    df, _, ldf, _ = fixture(spark)
    df.selectExpr("page_id", "url", "'<p>' AS html").write.parquet(str(tmp_path / "pages.parquet"))
    ldf.selectExpr("page_id AS doc_id", "CAST(NOT bad AS INT) AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = rows_of(queries.op4(spark, str(tmp_path)), "page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")
    assert got == sorted(con.execute(sql.URL_FILTER).fetchall(), key=repr)


def test_empty(spark):
    df, _, ldf, _ = fixture(spark)
    assert url_filter(df.limit(0), ldf, queries.URL_RULES).count() == 0
    assert url_filter(df, ldf.limit(0), queries.URL_RULES).where("rule is null and verdict = 'block'").count() == 0
