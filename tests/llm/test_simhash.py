import numpy as np
import xxhash

from marlstone.llm import components, simhash as s


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> sorted (doc_id, component)."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 2:
                root[find(p)] = find(q)
    low = {}
    for d, p in rows:
        if d is not None:
            low[find(p)] = min(low.get(find(p), d), d)
    return sorted(((d, low.get(find(p))) for d, p in rows), key=str)


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = [(d.doc_id, brute_print(d.text)) for d in docs]
    rows = s.op1_simhash(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in rows) == sorted((d, f"{p:016x}") for d, p in want)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == brute_components(want)


def test_odd_rows(odd, nothing):
    rows = s.near_components(s.fingerprints(odd)).collect()
    want = [(r.doc_id, brute_print(r.text)) for r in odd.collect()]
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1) for r in rows), key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == brute_components(want)
    assert s.near_components(s.fingerprints(nothing)).count() == 0


def flipped(rng, n, groups):
    base = rng.integers(0, 1 << 63, groups, dtype=np.uint64)
    values = base[rng.integers(0, groups, n)]
    for _ in range(3):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(values)


def test_near_pairs_are_all_pairs():
    rng = np.random.default_rng(5)
    for n, groups in ((1, 1), (64, 2), (65, 4), (300, 3), (700, 80)):
        values = flipped(rng, n, groups)
        for radius in (0, 1, 2):
            want = {(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= radius}
            assert set(zip(*map(np.ndarray.tolist, s.near_pairs(values, radius)), strict=True)) == want


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 40)
    rng = np.random.default_rng(2)
    values = flipped(rng, 600, 5)
    rows = [(i, int(v)) for i, v in enumerate(values.tolist())]
    prints = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in rows], "doc_id long, fp long")
    assert sorted(((r.doc_id, r.component_id) for r in s.near_components(prints).collect()), key=str) == brute_components(rows)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(5)
    found = {r.a: r.b for r in components.roots(links).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
    assert components.roots(links.limit(0)).count() == 0


def test_components_of_over_a_million_links(spark):
    # hashes of one sign only: their sum is far beyond a long
    links = spark.range(2_200_000).selectExpr("id * 2 AS a", "id * 2 + 1 AS b").where("xxhash64(a, b) > 0")
    n = links.count()
    found = components.roots(links)
    assert n > 1_000_000 and found.where("a = b + 1").count() == n == found.count()


def test_near_deduplicate_keeps_one_of_each_component(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    components = {r.component_id for r in s.op1_simhash(spark, sf_dir).select("component_id").distinct().collect()}
    kept = s.near_deduplicate(docs)
    assert kept.schema.names == docs.schema.names
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(components)
    assert s.near_deduplicate(odd.limit(0)).count() == 0
    rows = s.near_deduplicate(odd.where("text is null or text in ('', '\n') or doc_id is null")).collect()
    assert sorted((str(r.doc_id) for r in rows)) == ["2", "None"]


def test_hot_buckets_are_cut_by_finer_keys(spark, monkeypatch):
    """Many fingerprints that agree on half of their bits: no block takes them all, and no link is lost."""
    monkeypatch.setattr(s, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = np.uint64(0x1234_5678_9ABC_DEF0)
    values = np.unique(base ^ rng.integers(0, 1 << 12, 500, dtype=np.uint64) ^ (rng.integers(0, 1 << 4, 500, dtype=np.uint64) << np.uint64(28)))
    sizes = []
    monkeypatch.setattr(s, "settle", lambda df, name, own=s.settle: sizes.append((name, out := own(df, name))) or out)
    rows = [(i, int(v)) for i, v in enumerate(values.tolist())]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    assert sorted(((r.doc_id, r.component_id) for r in s.near_components(prints).collect()), key=str) == brute_components(rows)
    levels = [df for name, df in sizes if name == "buckets"]
    assert len(levels) == 3 and levels[-1].agg({"n": "max"}).first()[0] <= 256


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (1, 2), (None, 3), (4, None)], "a long, b long").selectExpr("a", "b", "'x' AS key")
    assert [tuple(r) for r in components.roots(links).collect()] == [(2, 1)]
