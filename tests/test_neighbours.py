"""Neighbours by an index of pivots: exact, with few compared pairs on rows that cluster."""

import numpy as np
import pytest

from marlstone.operators import outliers


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "id long, x array<double>")


def brute(x, k, ids=None):
    ids = np.arange(len(x)) if ids is None else np.array(ids)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) if len(x) <= 1200 else np.stack([np.sqrt(((x - r) ** 2).sum(axis=1)) for r in x])
    np.fill_diagonal(d, np.inf)
    out = {}
    for i, row in enumerate(d):
        best = np.lexsort((ids, row))[: min(k, len(x) - 1)]
        out[int(ids[i])] = [(int(ids[b]), round(float(row[b]), 9)) for b in best]
    return out


def got(df):
    out = {}
    for r in df.orderBy("id", "distance", "other").collect():
        out.setdefault(r.id, []).append((r.other, round(r.distance, 9)))
    return out


def clustered(n, dims=64, clusters=40, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 10, (clusters, dims))[rng.integers(0, clusters, n)] + rng.normal(0, 0.5, (n, dims))


def test_exact_over_fifty_parts_with_few_pairs(spark):
    x, stats = clustered(3000), {}
    found = got(outliers.neighbours(frame(spark, x), 5, block=60, stats=stats))
    assert found == brute(x, 5)
    assert stats["all"] == 9_000_000 and stats["compared"] < 0.2 * stats["all"]


@pytest.mark.parametrize("k", [1, 7])
def test_exact_without_clusters_and_with_ties(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(0, 1, (250, 12)), rng.integers(0, 2, (200, 12)).astype(float), np.zeros((60, 12))])
    ids = rng.permutation(5000)[: len(x)]
    assert got(outliers.neighbours(frame(spark, x, ids), k, block=40)) == brute(x, k, ids)


def test_a_fixed_number_of_parts_finds_nine_of_ten(spark):
    x, stats = clustered(3000, dims=24, clusters=60), {}
    found = got(outliers.neighbours(frame(spark, x), 10, block=60, probes=4, stats=stats))
    want = brute(x, 10)
    recall = np.mean([len({a for a, _ in want[i]} & {a for a, _ in found[i]}) / 10 for i in want])
    assert recall >= 0.9 and stats["compared"] <= 0.15 * stats["all"]


def test_few_rows(spark):
    assert outliers.neighbours(frame(spark, np.zeros((0, 2)))).collect() == []
    assert got(outliers.neighbours(frame(spark, np.array([[1.0, 2.0]])), 3)) == {}
    x = np.array([[0.0, 0.0], [3.0, 4.0], [0.0, 1.0]])
    assert got(outliers.neighbours(frame(spark, x), 5, block=1)) == brute(x, 5)


def test_part_meets_its_queries_in_slices(spark, monkeypatch):
    monkeypatch.setattr(outliers, "QUERIES", 17)
    x = clustered(400, dims=6, clusters=3)
    assert got(outliers.neighbours(frame(spark, x), 4, block=50)) == brute(x, 4)


def test_a_row_is_sent_once_for_each_group_and_not_for_each_part(spark):
    x, stats = np.random.default_rng(5).normal(0, 1, (1500, 32)), {}
    assert got(outliers.neighbours(frame(spark, x), 5, block=25, stats=stats)) == brute(x, 5)
    assert stats["compared"] > 0.9 * stats["all"]  # nothing to leave out: once for each of 60 parts would be 90,000
    assert stats["sent"] <= 1500 * (outliers.GROUPS + 1)


@pytest.mark.parametrize("k", [3, 40])
def test_groups_of_parts_and_small_products(spark, monkeypatch, k):
    for name, value in {"HELD": 0, "PRODUCTS": 900, "PAIRS": 50}.items():
        monkeypatch.setattr(outliers, name, value)
    x = np.concatenate([np.random.default_rng(k).normal(0, 1, (200, 8)), np.ones((50, 8))])
    assert got(outliers.neighbours(frame(spark, x), k, block=20)) == brute(x, k)


def test_near_rows_far_from_the_origin_and_from_others(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1e6, (6, 8))[rng.integers(0, 6, 400)] + rng.normal(0, 1e-3, (400, 8)) + 1e7
    assert got(outliers.neighbours(frame(spark, x), 4, block=30)) == brute(x, 4)


def test_places_of_few_and_of_many():
    rng = np.random.default_rng(4)
    for rows, columns in ((1, 1), (3, 5), (7, 9), (40, 64), (100, 301)):
        for share in (0, 0.001, 0.01, 0.2, 1):
            may = rng.random((rows, columns)) < share
            assert (outliers.places(may, int(may.sum())) == np.flatnonzero(may)).all()
