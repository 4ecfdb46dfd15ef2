import random

import pytest

from plinth.operators import calipers


def serial(units, candidates, caliper, least=1):
    """The loop over all candidates."""
    free, got = {c: (b, s) for c, b, s in candidates}, {}
    every = list(free.items())
    for o, u, b, s in sorted((o, u, b, s) for u, b, s, o in units):
        if sum(x == b and s - caliper < v < s + caliper for _, (x, v) in every) < least:
            continue
        near = sorted((abs(s - v), c) for c, (x, v) in free.items() if x == b and abs(s - v) < caliper)
        if near:
            got[u] = near[0][1]
            del free[near[0][1]]
    return got


def made(seed, n_units, n_candidates, spread, blocks="aaab"):
    rng = random.Random(seed)
    units = [(i, rng.choice(blocks), float(rng.randint(0, spread)), rng.randint(0, n_units // 2)) for i in range(n_units)]
    return units, [(10_000 + i, rng.choice(blocks), float(rng.randint(0, spread))) for i in range(n_candidates)]


@pytest.mark.parametrize("seed", range(40))
def test_parts_never_contradict_the_loop(seed):
    """Windows of any cut, with open edges, settle only what the loop over all rows settles so."""
    rng = random.Random(seed)
    units, candidates = made(seed, 60, 50, 200, "a")
    caliper = rng.choice([3.0, 10.0, 40.0])
    want = serial(units, candidates, caliper)
    rows = sorted([(s, 0, c, None) for c, _, s in candidates] + [(s, 1, u, o) for u, _, s, o in units])
    a = rng.randint(0, 60)
    b = rng.randint(a + 5, len(rows))
    part = rows[a:b]
    scores, keys = [r[0] for r in part if r[1] == 0], [r[2] for r in part if r[1] == 0]
    asking = sorted((r[3], r[2], r[0]) for r in part if r[1] == 1)
    found, waiting = calipers.settle(scores, keys, asking, caliper, part[0][0] if a else None, part[-1][0] if b < len(rows) else None)
    assert {u: keys[hit[0]] if hit else None for u, hit in found.items()} == {u: want.get(u) for u in found}
    assert len(found) + len(waiting) == len(asking) and (a or b < len(rows) or not waiting)


@pytest.mark.parametrize("window,least,caliper", [(16, 1, 4.0), (40, 2, 15.0), (10_000, 2, 60.0)])
def test_equals_the_serial_loop(spark, window, least, caliper):
    units, candidates = made(window, 160, 130, 900)
    u = spark.createDataFrame([*units, (900, None, 1.0, 1), (901, "a", None, 1), (902, "z", 5.0, 0)], "u long, b string, s double, o int")
    c = spark.createDataFrame([*candidates, (None, "a", 3.0), (20_000, "a", None)], "c long, b string, v double")
    got = calipers.greedy_caliper_match(u.repartition(3), c.repartition(2), ["b"], "u", "s", "o", "c", "v", caliper, least, window).collect()
    want = serial(units, candidates, caliper, least)
    assert {r.u: r.c for r in got} == want and len(got) == len(want)
    scores = {c: s for c, _, s in candidates} | {u: s for u, _, s, _ in units}
    assert all(r.gap == abs(scores[r.u] - scores[r.c]) for r in got)


def test_nothing_to_match(spark):
    u = spark.createDataFrame([(1, 2.0, 1)], "u long, s double, o int")
    c = spark.createDataFrame([(5, 9.0)], "c long, v double")
    assert calipers.greedy_caliper_match(u, c, [], "u", "s", "o", "c", "v", 3.0).collect() == []
    assert calipers.greedy_caliper_match(u.where("false"), c, [], "u", "s", "o", "c", "v", 30.0).collect() == []
    assert [(r.u, r.c, r.gap) for r in calipers.greedy_caliper_match(u, c, [], "u", "s", "o", "c", "v", 30.0).collect()] == [(1, 5, 7.0)]
