"""Phrases against brute force; the guarantee of the summaries."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from marlstone.llm import collocations as co


def brute(rows, threshold, longest=5, keep=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = []
    some = {k: v for k, v in f.items() if v >= threshold and len(k[1]) > 1}
    for (lang, p), a in some.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if not any(g == lang and len(q) > len(p) and v >= a and inside(q) for (g, q), v in some.items()):
            out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:keep]
        ranked += [(lang, i, x[3], x[2], x[4], x[5], x[6], x[1]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def texts(seed, many):
    """Few words and some phrases that come often; stops, tabs, blank pieces, mixed case."""
    r = random.Random(seed)
    words = ["de", "la", "Über", "new", "york", "x\x00y", "naïve", "a b", "Çelik", "z"]
    rows = []
    for i in range(many):
        parts = []
        for _ in range(r.randrange(0, 30)):
            parts.append("New York city hall of" if r.random() < 0.2 else r.choice(words))
            parts.append(r.choice([" ", "  ", "\t", ". ", ", ", "\n", " ", " "]))
        rows.append((r.choice(["en", "fr", None, "und"]), None if i % 17 == 0 else "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,threshold,partitions", [(1, 5, None), (2, 3, 7), (3, 12, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, threshold, partitions):
    monkeypatch.setattr(co, "CHUNK", 150)
    rows = texts(seed, 120)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = co.collocations(*co.frequent_grams(docs, threshold, partitions=partitions))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, threshold)


def test_limit_and_ties(spark):
    rows = [("en", "a b, c d, e f, g h. ") for _ in range(4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = co.collocations(*co.frequent_grams(docs, 4), keep=3).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 4, keep=3)
    assert [r.phrase for r in sorted(found, key=lambda r: r.rank)] == ["a b", "c d", "e f"]


def test_large_products_are_exact(spark):
    grams = spark.createDataFrame([("en", "a", 10**12), ("en", "b", 10**12 + 7), ("en", "a b", 10**11)], co.COUNTS)
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    assert co.collocations(grams, totals).first().score == 1000 * 10**11 * 10**14 // (10**12 * (10**12 + 7))


@pytest.mark.parametrize("seed", range(5))
def test_every_frequent_gram_survives_a_small_summary(seed):
    rng = np.random.default_rng(seed)
    stream = np.concatenate([rng.zipf(1.3, 20_000) % 5000, rng.integers(5000, 60_000, 30_000)]).astype(np.uint64)
    rng.shuffle(stream)
    threshold = 100
    summary = co.Summary(len(stream) // threshold + 1)
    for part in np.array_split(stream, 40):
        summary.merge(*co.added(part, np.ones(len(part), np.int64)))
    kept = set(summary.frequent(threshold).tolist())
    values, counts = np.unique(stream, return_counts=True)
    assert set(values[counts >= threshold].tolist()) <= kept
    assert summary.given > 0  # it was cut
    assert len(kept) <= summary.capacity
    truth = dict(zip(values.tolist(), counts.tolist(), strict=True))
    for h, c in zip(summary.hashes.tolist(), summary.counts.tolist(), strict=True):
        assert truth[h] - summary.given <= c <= truth[h]


def test_equal_hashes_of_unlike_phrases_stay_apart(spark, monkeypatch):
    """Counts go by words, whatever the hashes are."""
    monkeypatch.setattr(co, "xxh64_intdigest", lambda b: len(b))
    own = co.Builder()
    own.add("en", b"aa bb, cc dd, aa bb")
    chunk = co.Chunk(own.blob()[0])
    at, hashes = chunk.grams(2)
    assert len(set(hashes.tolist())) == 1
    first, counts = chunk.counted(2, at)
    assert dict(zip(chunk.said(2, first), counts.tolist(), strict=True)) == {b"aa bb": 2, b"cc dd": 1}
    told = [m.column("payload")[0].as_py() for m in co.tell(0, "", chunk, hashes[:1], range(2, 3), 2)]
    assert co.told_counts(told, 2).to_pylist() == [{"lang": "en", "phrase": "aa bb", "f": 2}]


def test_odd_rows(spark, odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    found = co.collocations(*co.frequent_grams(odd, 2))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 2)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert co.collocations(*co.frequent_grams(nothing)).collect() == []
    assert co.collocations(*co.frequent_grams(odd.where("text is null"))).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = co.op11_collocations(spark, sf_dir)
    want = con.execute(co.SQL["op11_collocations"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
