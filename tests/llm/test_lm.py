import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from marlstone.llm import lm
from marlstone.llm.common import crc_mod


def brute(docs, order=3):
    """docs: (doc_id, text) -> rows by interpolated modified Kneser-Ney, with plain dictionaries."""
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [" end"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    grams = lambda ws, n: zip(*(([" begin"] * (order - 1) + ws)[order - n + i :] for i in range(n)), strict=False)
    unigrams, values = Counter(), {order: Counter()}
    for d, t in docs:
        if not held(d):
            unigrams.update(tokens(t))
            values[order].update(grams(tokens(t), order))
    for n in range(order - 1, 0, -1):
        values[n] = Counter(g[1:] for g in values[n + 1])
    n_train, v = sum(unigrams.values()), len(unigrams)
    discount, followers, size = {}, {}, {}
    for n in range(1, order + 1):
        discount[n] = lm.discounts(np.array([sum(c == k for c in values[n].values()) for k in (1, 2, 3, 4)]))
        followers[n], size[n] = defaultdict(Counter), Counter()
        for g, c in values[n].items():
            followers[n][g[:-1]][min(c, 3)] += 1
            size[n][g[:-1]] += c

    @lru_cache(None)
    def p(g):
        n, context = len(g), g[:-1]
        lower = p(g[1:]) if n > 1 else 1 / (v + 1)
        if not size[n][context]:
            return lower
        c, d, kinds = values[n][g], discount[n], followers[n][context]
        return max(c - d[min(c, 3)], 0) / size[n][context] + sum(d[k] * kinds[k] for k in (1, 2, 3)) / size[n][context] * lower

    out = []
    for d, t in docs:
        ws = tokens(t)
        base = sum(math.log10((unigrams[w] + 0.1) / (n_train + 0.1 * (v + 1))) for w in ws)
        out.append((d, held(d), len(ws), sum(unigrams[w] > 0 for w in ws), n_train, base, sum(math.log10(p(g)) for g in grams(ws, order))))
    return out


def same(rows, want):
    rows, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6), round(r[6], 6))) for x in (rows, want))
    assert len(rows) == len(want)
    for r, w in zip(rows, want, strict=True):
        assert tuple(r[:5]) == w[:5] and r[5:7] == pytest.approx(w[5:7], rel=1e-9)


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = lm.op5_lm(spark, sf_dir).collect()
    same(rows, brute(docs))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, odd, nothing):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for order in (2, 3):
        same(lm.score(odd, crc_mod("doc_id", 10) == 0, shards=3, order=order).collect(), brute(docs, order))
    assert lm.score(nothing, crc_mod("doc_id", 10) == 0).count() == 0
    with pytest.raises(ValueError):
        lm.score(odd, crc_mod("doc_id", 10) == 0, order=1)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_several_chunks_in_a_partition(spark, monkeypatch, order):
    docs = [(i, " ".join(str((i * k) % 7) for k in range(i % 11))) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    folder, most = lm.write_chunks, lm.CHUNK
    seen = []

    def small(docs, held, at, text="text"):
        found = folder(docs, held, at, text)
        seen.append(found)
        return found

    monkeypatch.setattr(lm, "write_chunks", small)
    monkeypatch.setattr(lm, "CHUNK", 100)
    same(lm.score(frame, crc_mod("doc_id", 10) == 0, shards=5, order=order).collect(), brute(docs, order))
    assert seen[0].where("tokens < 200").count() > 10 and most == 2_000_000


def test_model_stays_where_it_is_kept(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    rows = lm.score(docs, crc_mod("doc_id", 10) == 0, shards=2, model=f"file://{tmp_path}/model").collect()
    same(rows, brute([(r.doc_id, r.text) for r in docs.collect()]))
    for level in (1, 2, 3):
        names = {p.name.split(".")[0] for p in (tmp_path / "model" / f"order-{level}").glob("*.npy")}
        shards = [lm.StoredShard(f"file://{tmp_path}/model/order-{level}", n, "") for n in names]
        assert len(shards) == 2 and all((np.diff(s.hashes) > 0).all() for s in shards)
        assert shards[0].facts(shards[1].hashes[:5])[0].tolist() == [0] * 5


def test_large_counts_are_whole():
    values = np.array([0, 1, 254, 255, 256, 5_000_000_000, 2], np.uint64)
    assert lm.counts_from(*lm.counts_bytes(values)).tolist() == values.tolist()
    assert lm.load(lm.dump(b"", b"abc")) == [b"", b"abc"]


def test_held_out_words(spark):
    train = [(i, t) for i, t in enumerate(["a b a c", "b a", "a a b", "c", "d a b a"], start=1)]
    held = next(i for i in range(100) if zlib.crc32(b"%d" % i) % 10 == 0)
    docs = [d for d in train if zlib.crc32(b"%d" % d[0]) % 10] + [(held, w) for w in ("a", "b", "c", "d", "?", "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [r for r in lm.score(frame, crc_mod("doc_id", 10) == 0, shards=2).collect() if r.held_out]
    same(rows, [w for w in brute(docs) if w[1]])
    assert len(rows) == 6 and all(r.score < 0 for r in rows)


def test_arrays_survive_packing():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.unrising(lm.rising(values)) == values).all() and len(lm.unrising(lm.rising(values[:0]))) == 0
    assert (lm.unplane(lm.planes(values % 1000, lm.U32), lm.U32) == values % 1000).all()
    parts = lm.slices(values, 7)
    assert sum(p.stop - p.start for p in parts) == len(values) and len(parts) == 7
