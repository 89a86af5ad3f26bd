"""Exact rounds of centroids and hard negatives against plain loops."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import centroids, negatives
from marketlens.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def plain_rounds(rows, k=8, rounds=10, scale=1024, seed=3):
    """(assignment, squared distance) of every row and the final centroids, distance by distance."""
    kept = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v in rows]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    c, x = np.array([v for _, v in start]), np.array([v for _, v in kept])
    for number in range(rounds + 1):
        far = np.stack([((x - c[j]) ** 2).sum(1) for j in range(len(c))], 1)
        own = far.argmin(1)
        if number < rounds:
            c = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    return [(i, int(a), int(d)) for (i, _), a, d in zip(kept, own, far.min(1))], c


def frame(spark, rows, schema="vec_id bigint, embedding array<double>", parts=5):
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.mark.parametrize("kind", ["spread", "clumps", "ties"])
def test_rounds(spark, kind):
    random = np.random.default_rng(1)
    n = 3000
    x = random.normal(size=(n, 6))
    if kind == "clumps":
        x = random.normal(size=(12, 6))[random.integers(0, 12, n)] * 4 + x * 0.2
    if kind == "ties":
        x = random.integers(-1, 2, (n, 6)).astype(float)
    rows = [(i - 50, v.tolist()) for i, v in enumerate(x)]
    rows += rows[:700]
    found, history, scans = centroids.cluster_rounds(frame(spark, rows), dimension=6)
    want, last = plain_rounds(rows)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert (history[-1] == last).all() and len(history) == 11
    assert scans[0] == 8 * len(rows)
    if kind == "clumps":
        assert sum(scans[1:]) < 0.4 * 10 * 8 * len(rows)


def test_bounds_use_the_total_displacement():
    """A centroid that went away and came back has not moved: its old bounds still hold."""
    here, there = np.array([[0, 0], [100, 0]]), np.array([[60, 0], [160, 0]])
    bounds = centroids.Bounds(np.stack([here, there, here]))
    assert bounds.moved[0].max() < 1e-6 and bounds.moved[1].min() >= 60
    x = np.array([[1, 2], [99, 1]])
    state = centroids.Bounds(here[None]).first(x)
    after, scans = bounds.next(x, state)
    assert scans == 0 and (after == state).all()
    _, scans = centroids.Bounds(np.stack([here, there])).next(x, state)
    assert scans > 0


def test_odd_vectors(spark):
    good = [(i, [float(i % 7), -0.5, 0.25 * i]) for i in range(20)]
    odd = [(None, [1.0, 1.0, 1.0]), (100, None), (101, [1.0, None, 2.0]), (102, [NAN, 1.0, 1.0]), (103, [INF, 1.0, 1.0]), (104, [1.0]), (105, []), (106, [1e300, 1.0, 1.0])]
    table = frame(spark, good + odd).withColumns({"x": F.lit(1), "cluster": F.lit("c"), "distance": F.lit(0)})
    out = centroids.clustered(table, dimension=3).collect()
    want, last = plain_rounds(good)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == sorted(want)
    for r in out:
        assert r.inertia == sum(d for *_, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, last[r.cluster])).encode()).hexdigest()
    assert centroids.clustered(frame(spark, odd[1:]), dimension=3).count() == 0
    few = centroids.clustered(frame(spark, good[:3] * 2), dimension=3).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in few) == sorted(plain_rounds(good[:3] * 2)[0])


def plain_negatives(rows, every=50, n_positive=5, n_negative=3, window=(50, 95), scale=256):
    ids, labels = [r[0] for r in rows], [r[1] for r in rows]
    x = [[math.floor(v * scale) for v in r[2]] for r in rows]
    out = []
    for a in range(len(rows)):
        if ids[a] % every:
            continue
        score = [sum(p * q for p, q in zip(x[a], y)) for y in x]
        order = sorted((j for j in range(len(rows)) if j != a), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if labels[j] == labels[a]][:n_positive]:
            fit = [j for j in order if labels[j] != labels[a] and window[0] * score[p] <= 100 * score[j] <= window[1] * score[p]]
            out += [(ids[a], ids[p], rank + 1, ids[j], score[p], score[j]) for rank, j in enumerate(fit[:n_negative])]
    return sorted(out)


SCHEMA = "vec_id bigint, label int, embedding array<double>"


@pytest.mark.parametrize("kind", ["spread", "clumps", "ties", "hot"])
def test_hard_negatives(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "WAVE", 7)
    random = np.random.default_rng(2)
    n, width = 400, 70
    x = random.normal(size=(n, width))
    if kind == "clumps":
        x = random.normal(size=(5, width))[random.integers(0, 5, n)] + 0.3 * x
    if kind == "ties":
        x = random.integers(-1, 2, (n, width)).astype(float)
        x[::9] = 0
    if kind == "hot":
        x[: n // 2] = np.abs(x[0])
    rows = [(i - 100, int(random.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    rows += rows[:30]
    found = negatives.hard_negatives(frame(spark, rows, SCHEMA, 6), anchor_every=10)
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, every=10)


def test_intervals_hold(spark):
    """Every inner product lies in its interval, and the interval does tell rows apart."""
    random = np.random.default_rng(3)
    for width in (1, 5, 64, 130):
        turn = negatives.rotation(width)
        assert np.allclose(turn @ turn.T, np.eye(width))
        x = random.integers(-300, 300, (500, width))
        x[:20] = 0
        x[20:40] *= 1000
        rows = negatives.Rows(np.arange(500), random.integers(0, 3, 500), x, 0, turn)
        anchors = negatives.Anchors(np.arange(40), np.zeros(40, int), x[10:50], None, turn)
        about, half = anchors.intervals(np.arange(40), rows, slice(0, 500))
        exact = anchors.x @ rows.x.T
        assert (np.abs(about - exact) <= half).all()
        if width == 64:
            assert np.median(half[15:, 60:] / (anchors.length[15:, None] * rows.length[None, 60:] + 1)) < 0.8


def test_odd_rows_of_negatives(spark):
    random = np.random.default_rng(4)
    good = [(i, i % 3, random.normal(size=4).round(2).tolist()) for i in range(60)]
    odd = [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (250, 1, None), (300, 1, [1.0, None, 1.0, 1.0]), (350, 2, [NAN] * 4), (400, 2, [INF] * 4), (450, 1, [1.0] * 3), (500, 1, []), (550, 1, [1e200] * 4)]
    table = frame(spark, good + odd, SCHEMA).withColumns({"rank": F.lit(1), "x": F.lit("x"), "block": F.lit(0), "wave": F.lit("w")})
    assert sorted(tuple(r) for r in negatives.hard_negatives(table, anchor_every=10).collect()) == plain_negatives(good, every=10)
    assert negatives.hard_negatives(frame(spark, odd[1:6], SCHEMA)).count() == 0
    assert negatives.hard_negatives(frame(spark, [(0, 1, [1.0, 2.0]), (3, 2, [1.0, 2.0])], SCHEMA)).count() == 0


def test_negative_positive_scores_give_nothing(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.6, 0.0]), (3, 2, [0.0, 0.0])]
    assert negatives.hard_negatives(frame(spark, rows, SCHEMA)).count() == len(plain_negatives(rows)) == 0


@pytest.mark.parametrize("name", ["op11_displacement_bounds", "op13_one_bit_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry
    from marketlens.registry.check import compare, connect

    assert name in QUERIES and name in entry.oracle_sql()
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, name)[0] == "same"
