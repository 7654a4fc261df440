import hashlib

import pytest

from marlstone.llm import url_filter as u
from marlstone.llm import warc as w

PAGES = [
    (1, "http://WWW.Example.com/en/712?x=1", "a" * 2000),
    (2, "https://example.com/en/812", "a" * 2000),
    (2, "https://example.com/en/812", "a" * 2000),
    (3, None, None),
    (4, "no scheme", ""),
    (5, "http://example.net/de/8#top", "b" * 999),
    (6, "http://example.net/de/8\t new\nline", "b" * 999),
    (7, "http://com/en/", "é" * 500),
    (8, "http://", "é" * 500),
    (9, "http://org", "c" * 5000),
    (None, "http://x.org/es/1", "a" * 2000),
    (10, "a://b.com/en/?://c.org/es/", "a" * 2000),
    (11, "http://notexample.com:80/en/7", "long " * 50000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "k", 0) for p in PAGES], "page_id long, url string, html string, key string, verdict int")


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_query_matches_brute_force(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = u.op7_url_filter(spark, sf_dir).collect()
    assert len(rows) == len(urls) and {r.verdict for r in rows} == {"allow", "block"}
    assert all((r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id]) for r in rows)


def test_url_odd_rows(spark, pages):
    rules = u.rule_table(spark, u.RULES)
    assert sorted(map(str, map(tuple, u.judge(pages, rules).collect()))) == sorted(str((p[0], *brute_verdict(p[1]))) for p in PAGES)
    assert u.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in u.judge(pages, rules.limit(0), "block").collect()} == {"block"}
    both = u.rule_table(spark, [u.Rule("com", "", "block"), u.Rule("com", "", "allow"), u.Rule("org", "", "block")])
    assert {(r.page_id, r.verdict) for r in u.judge(pages, both).collect()} >= {(1, "allow"), (9, "block"), (3, "allow")}


def brute_records(pages):
    pages = [(p, (h or "").encode()) for p, _, h in pages]
    out = []
    for page_id, payload in pages:
        top = max((p for p, x in pages if x == payload and p is not None), default=None) if len(payload) >= 1000 else page_id
        same = sum(x == payload for _, x in pages) > 1
        kind = "revisit" if len(payload) >= 1000 and same and top is not None and page_id != top else "response"
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), kind, top if kind == "revisit" else None))
    return sorted(out, key=str)


def back(spark, pages):
    archives = w.work_dir(spark, "archives")
    return sorted(map(tuple, w.read_back(pages, w.write_index(w.write_archives(pages, archives), archives)).collect()), key=str)


def test_warc_query_matches_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, w.op6_warc(spark, sf_dir).collect()), key=str) == brute_records(rows)


def test_warc_odd_rows(spark, pages, monkeypatch):
    assert back(spark, pages) == brute_records(PAGES)
    assert back(spark, pages.limit(0)) == []
    monkeypatch.setattr(w, "BLOCK", 2)
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 300)
    assert back(spark, pages.coalesce(1)) == brute_records(PAGES)
    hot = spark.range(500).selectExpr("id page_id", "'http://a.b/c' url", "repeat('x', 1000 + id % 2) html")
    assert back(spark, hot) == brute_records([(i, "", "x" * (1000 + i % 2)) for i in range(500)])


def test_surt():
    assert w.surt("http://WWW.Example.com/a?b=C") == "com,example,www)/a?b=C"
    assert w.surt(None) == ")" and w.surt("x y") == ")x%20y" and w.surt("http://") == ")"
