import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import elkan, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def integers(v, scale=64):
    return [math.floor(float(np.float32(c)) * scale) for c in v]


def usable(v, dims):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


def plain_kmeans(rows, k, rounds, dims, scale):
    """Every distance of every round, in Python integers."""
    kept = [(i, integers(v, scale)) for i, v in rows if usable(v, dims)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centres = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for done in range(rounds + 1):
        placed = [min(range(len(centres)), key=lambda j: (far(x, centres[j]), j)) for _, x in kept]
        if done < rounds:
            for j in range(len(centres)):
                own = [x for (_, x), p in zip(kept, placed) if p == j]
                if own:
                    centres[j] = [sum(c) // len(own) for c in zip(*own)]
    d = [far(x, centres[p]) for (_, x), p in zip(kept, placed)]
    inertia = {j: sum(v for v, p in zip(d, placed) if p == j) for j in set(placed)}
    return sorted((-1 if i is None else i, p, v, inertia[p], sum(d), tuple(centres[p])) for (i, _), p, v in zip(kept, placed, d))


@pytest.mark.parametrize("grid,k", [(4, 5), (50, 16)])
def test_clusters_equal_plain_rounds_with_ties(spark, grid, k):
    random.seed(grid)
    rows = [(i, [random.randint(-grid, grid) / 64 + 0.001 for _ in range(3)]) for i in range(300)]
    rows += [(None, [0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0]), (7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    rows += [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("-inf"), 0.0, 0.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("own")).withColumn("_x", F.lit(0))
    got = elkan.cluster(df.repartition(5), k=k, rounds=3, dims=3).collect()
    want = plain_kmeans(rows, k, 3, 3, 64)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == want


def test_few_equal_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [0.5, -0.5]) for i in range(6)], "vec_id long, embedding array<float>")
    rows = elkan.cluster(same, k=4, rounds=2, dims=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in rows} == {(0, 0, 0)} and len(rows) == 6
    assert len(elkan.cluster(same.limit(2), k=4, rounds=2, dims=2).collect()) == 2
    assert elkan.cluster(same.where("false"), k=4, rounds=2, dims=2).collect() == []
    assert elkan.cluster(same, k=4, rounds=2, dims=3).collect() == []


def test_bounds_save_distances_and_lose_nothing():
    rng = np.random.default_rng(0)
    homes = rng.integers(-1000, 1000, (8, 16))
    x = homes[rng.integers(0, 8, 2000)] + rng.integers(-30, 30, (2000, 16))
    centres, state, done = x[:8].copy(), (None, None, None), []
    before = None
    for _ in range(5):
        step = elkan.Pass(centres, before)
        *state, n = step.assign(x, *state)
        done.append(n)
        far = ((x[:, None] - centres) ** 2).sum(axis=2)
        assert (far.argmin(axis=1) == state[0]).all()
        root = np.sqrt(far.astype(float))
        assert (state[1] >= root[np.arange(len(x)), state[0]]).all() and (state[2] <= root).all()
        before, centres = centres, np.stack([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else centres[j] for j in range(8)])
    assert done[0] < len(x) * 8 and done[-1] < len(x)


def test_distances_are_exact_or_refused():
    big = np.array([[1 << 29, -(1 << 29)]])
    assert elkan.squared(big, np.array([-3, 5]))[0] == ((1 << 29) + 3) ** 2 + ((1 << 29) + 5) ** 2
    with pytest.raises(OverflowError):
        elkan.squared(np.array([[1 << 33]]), np.array([0]))
    v = np.array([0.0, 1.0, 1 / 3, 2.0**20, 123456.789])
    assert (elkan.outward(v, True) > v).all() and (elkan.outward(v, False) < v).all()


def test_symmetric_qr():
    rng = np.random.default_rng(1)
    some = [rng.normal(size=(n, n)) for n in (1, 2, 3, 16, 64)]
    for a in [s @ s.T for s in some] + [np.zeros((4, 4)), np.eye(5), np.diag([3.0, 3.0, 1.0]), np.ones((6, 6)), some[3] + some[3].T]:
        values, axes = whitening.symmetric_qr(a)
        size = max(1.0, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * size * len(a))
        assert np.allclose(axes @ np.diag(values) @ axes.T, a, atol=1e-12 * size * len(a)) and np.allclose(axes.T @ axes, np.eye(len(a)), atol=1e-12)


def test_merged_states_equal_one_stream():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (500, 5)).astype(float)
    whole, parts = whitening.Moments.empty(5), whitening.Moments.empty(5)
    whole.add(x)
    for at, to in ((0, 1), (1, 1), (1, 170), (170, 500)):
        part = whitening.Moments.empty(5)
        part.add(x[at:to])
        parts = parts.merged(part)
    for m in (whole, parts):
        assert m.n == 500 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.m2 / 500, np.cov(x.T, bias=True), rtol=1e-12)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(6, 6))
    vectors = [[float(c) for c in v] for v in (rng.normal(size=(240, 6)) @ mixing).astype(np.float32)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i, vectors[0]) for i in range(300, 340)] + [(None, vectors[1])]
    bad = [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0]), (905, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("whitened", F.lit("own")).withColumn("component", F.lit(0))
    got = whitening.by_component(df.repartition(7), most=4).collect()
    x = [[math.floor(float(np.float32(c)) * 64) + 1000000 for c in v] for _, v in rows]
    fit = [list(v) for v in sorted(set(map(tuple, x)))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = [[Fraction(a) - Fraction(s, n) for a, s in zip(v, sums)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in exact) / n) for j in range(6)] for i in range(6)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(rows)
    signs = {}
    want = {}
    for (i, _), v in zip(rows, x):
        centred = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums)])
        want.setdefault(i, (sum((n * a - s) ** 2 for a, s in zip(v, sums)), centred @ axes / np.sqrt(values)))
    for r in got:
        deviation, white = want[r.vec_id]
        w = white[r.component - 1]
        signs.setdefault(r.component, 1 if r.whitened * w > 0 else -1)
        assert r.deviation == deviation and r.n == n and abs(r.whitened * signs[r.component] - w) < 1e-9
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10 and r.identity_error < 1e-10


def test_whitening_of_flat_single_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    flat = spark.createDataFrame([(i, [i / 64.0, 2 * i / 64.0, 5.0]) for i in range(9)], schema)
    rows = whitening.by_component(flat).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 9 and abs(rows[0].explained - 1) < 1e-12 and rows[0].identity_error < 1e-12
    for none in (flat.limit(1), flat.where("false"), flat.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))):
        df = whitening.by_component(none)
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long():
    model = whitening.Whitening(10**9, 2, [0, 0], np.eye(2), np.ones(2), np.ones(2) / 2)
    gaps = model.centred(np.array([[10**9, -(10**10)]]))
    assert model.deviation(gaps) == [10**36 + 10**38]
