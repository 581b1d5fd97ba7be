import random

import duckdb
import pytest
from metaveil.llm import common, reputation
from metaveil.llm.queries import ORACLE, RULES, op12_url_reputation

PAGES = "page_id bigint, url string, html string, n int, host string, bad int, seen string"
LABELS = "doc_id bigint, quality int, toxic int, host string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", 1, "x", 2, "y") for i, u in urls], PAGES).repartition(3)


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "host string, bad boolean, n bigint")


ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.Example.NET/en/x?q#f"), (6, "https://example.net/en"), (7, "https://example.net/en/"),
    (8, "http://a.b.example.com/de/7"), (9, "http://notexample.com/de/7"), (10, "http://x.org/fr/?a"), (11, "http://x.org?/fr/"), (12, "http://u@h.co.uk:80/1"), (13, "a://b://c/d"),
    (14, "http://10.0.0.1/x"), (15, "http://ÄB.net/"), (15, "http://ÄB.net/"), (None, "http://net/fr"), (16, "http://" + "a." * 5000 + "net/" + "p" * 100_000), (17, "x\n://net.net/a\nb#c"),
]


def rule(host, path):
    fits = [r for _, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def brute_parts(url):
    import re

    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_parts_and_rules(spark):
    got = reputation.judge(pages(spark, ODD), outcomes(spark, []), RULES).collect()
    want = []
    for i, url in ODD:
        host, path = brute_parts(url)
        r = rule(host, path)
        want.append((i, host, path, r, "block" if r in ("net/", "example.com/de/") else "allow"))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def hosts():
    good = [(f"h{i}.good.com", i) for i in range(20)]
    return good + [(f"h{i}.bad.com", i) for i in range(20)] + [("new.good.com", 0), ("new.bad.com", 0), ("lone.com", 0), ("odd.good.com", 0), ("once.good.com", 0)]


def history():
    rows = []
    for i in range(20):
        rows += [(f"h{i}.good.com", False, 30), (f"h{i}.good.com", True, 1), (f"h{i}.bad.com", True, 30), (f"h{i}.bad.com", False, 1)]
    return rows + [("odd.good.com", True, 60), ("odd.good.com", False, 2), ("once.good.com", True, 1), ("elsewhere.com", True, 5)]


def test_bad_hosts_are_found_by_their_own_pages_and_their_domain(spark):
    urls = [(i, f"https://{h}/p") for i, (h, _) in enumerate(hosts())]
    got = {r["host"]: r["verdict"] for r in reputation.judge(pages(spark, urls), outcomes(spark, history()), []).collect()}
    assert all(got[f"h{i}.good.com"] == "allow" and got[f"h{i}.bad.com"] == "block" for i in range(20))
    assert got["new.bad.com"] == "block"  # its domain is known
    assert got["new.good.com"] == got["once.good.com"] == got["lone.com"] == "allow"  # one bad page is no proof
    assert got["odd.good.com"] == "block"  # its own pages outweigh its domain


@pytest.mark.parametrize("rows", [50_000, 0])
def test_broadcast_and_spread_verdicts(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "LOOKUP_ROWS", rows)
    monkeypatch.setattr(common, "HOT_PART", 5)
    urls = [(i, f"https://h{i % 20}.bad.com/{i}") for i in range(200)] + [(1000 + i, "http://h1.bad.com/") for i in range(400)] + [(2000 + i, "http://h2.good.com/") for i in range(300)]
    got = reputation.judge(pages(spark, urls), outcomes(spark, history()), []).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": 600, "allow": 300}


def test_against_sql(spark, tmp_path):
    rng = random.Random(4)
    names = ["a.bad.co.uk", "b.bad.co.uk", "c.fine.com", "d.fine.com", "1.2.3.4", "single", "u@e.mixed.org:8080", "f.mixed.org"]
    urls = [(i, f"http://{rng.choice(names)}/{rng.choice(['en', 'fr', 'de'])}/{rng.randrange(400)}.html") for i in range(900)]
    urls += [(i, u) for i, u in ODD if u is None or len(u) < 1000] + [(5000 + i, f"http://z.bad.co.uk/{i % 400}") for i in range(500)]
    bad = {i: rng.random() < 0.4 for i in range(400)}
    labels = [(i, None if rng.random() < 0.1 else int(not bad[i]), None if rng.random() < 0.2 else int(bad[i] and rng.random() < 0.3), "h") for i in range(400)]
    labels += [(3, 0, 1, "h"), (None, 0, 1, "h")]
    pages(spark, urls).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE['op12_url_reputation']})").fetchall()
    got = op12_url_reputation(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_tables(spark):
    assert reputation.judge(pages(spark, []), outcomes(spark, []), RULES).count() == 0
    got = reputation.judge(pages(spark, [(1, "http://a.com/")]), outcomes(spark, [("a.com", None, 5), (None, True, 5)]), RULES).collect()
    assert [r["verdict"] for r in got] == ["allow"]
