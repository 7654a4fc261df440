import random

import numpy as np
import pytest

from marlstone.llm import near_copies as n
from marlstone.llm import simhash


def brute_kept(rows):
    """rows: (doc_id, text) -> the doc_ids that stay, from all pairs."""
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()) for d, t in sorted(rows)]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if (len(s & t) / len(s | t) if s | t else 1) >= 0.8:
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted(d for d in root if find(d) == d)


def kept(df):
    return sorted(r.doc_id for r in n.deduplicate(df).select("doc_id").collect())


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert kept(docs) == want
    # radius 2 of op1 leaves near copies
    assert len(want) < simhash.near_deduplicate(docs).count()


@pytest.mark.parametrize("block", [40, 512])
def test_planted_copies_around_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(n, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for size in (1, 2, 5, 150):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(120), rng.randrange(4)):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df) == brute_kept(rows)


@pytest.mark.parametrize("block", [7, 512])
def test_families_around_the_threshold_lose_no_link(spark, monkeypatch, block):
    """Texts whose neighbours are alike by 0.6 to 0.9: many links fall short, and groups are chains."""
    monkeypatch.setattr(n, "BLOCK", block)
    rng = random.Random(8)
    rows = []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(400)]
        for step in range(25):
            start = step * (4 + 2 * family)
            text = words[start : start + 100]
            text[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df) == brute_kept(rows)


def test_near_lanes_are_all_pairs():
    rng = np.random.default_rng(6)
    for size, radius in ((1, 5), (64, 114), (65, 3), (200, 114)):
        base = rng.integers(0, 256, (5, 64), dtype=np.uint8)
        prints = base[rng.integers(0, 5, size)] ^ np.packbits(rng.random((size, 512)) < 0.11, axis=1)
        stops = np.minimum(rng.integers(1, size + 1, size), size)
        query = np.sort(rng.choice(size, -(-size // 2), replace=False))
        want = {(int(i), j, d) for i in query for j in range(i + 1, stops[i]) if (d := int(np.unpackbits(prints[i] ^ prints[j]).sum())) <= radius}
        found = n.near_lanes(prints, query, stops[query], radius)
        assert set(zip(*(x.tolist() for x in found), strict=True)) == want


def test_a_block_checks_what_is_not_joined_yet():
    prints = np.zeros((4, 64), np.uint8)
    bucket, sid = np.array([1, 1, 1, 2]), np.array([5, 6, 7, 8])
    alike, other = np.arange(10, dtype="<u8"), np.arange(5, 15, dtype="<u8")

    def links(root, sets):
        root = np.array(root)
        return n.good_links(bucket, sid, root, *n.pairs_in_buckets(bucket, root, np.ones(4, bool), prints), sets, 0.8)

    assert links([5, 6, 7, 8], [alike] * 4) == [(5, 6), (5, 7)]  # (6, 7) is joined by then
    assert links([5, 6, 7, 8], [alike, other, alike, alike]) == [(5, 7)]
    assert links([5, 5, 7, 8], [alike, other, other, alike]) == [(6, 7)]
    assert links([5, 5, 5, 5], [alike] * 4) == []
    assert n.jaccard(alike, other) == 5 / 15 and n.jaccard(alike[:0], alike[:0]) == 1.0


def test_odd_rows(odd, nothing):
    assert n.deduplicate(nothing).count() == 0
    out = n.deduplicate(odd.where("doc_id is not null"))
    assert out.schema.names == odd.schema.names
    # 2, 3 and 8 have no word, and 10 is 1 in other case and spaces
    assert sorted({r.doc_id for r in out.collect()}) == [1, 2, 4, 5, 6, 7, 9]


def test_other_radii_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_pairs(simhash.np.zeros(2, "u8"), 3)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)
