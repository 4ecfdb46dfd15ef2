import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from plinth.llm import neardup
from plinth.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts, percent):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def sample(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n // 4):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 80, 200]))]
        texts.append(" ".join(base))
        for edits in (0, 1, 3):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if edits == 0 else " ".join(copy))
    return texts


def check(df, texts, percent):
    want = brute(texts, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_against_brute_force(docs):
    texts = sample() + [None, "", " \t\n", "one two", "One  TWO", "é É", "x " * 5000]
    check(neardup.near_duplicates(docs(texts), percent=85), texts, 85)


def test_residual_buckets_in_small_blocks(docs):
    # A chain of drifting copies: neighbours are linked, far ones share buckets only.
    rng = random.Random(5)
    base = [f"a{i}" for i in range(120)]
    texts = []
    for k in range(30):
        texts.append(" ".join(base))
        base = list(base)
        base[rng.randrange(120)] = f"b{k}"
    check(neardup.near_duplicates(docs(texts), percent=85, block=4), texts, 85)


def test_hot_bucket_with_a_large_component_and_others(docs):
    # Many copies of one text, two smaller families and single ones that share buckets with them.
    rng = random.Random(8)
    base = [f"a{i}" for i in range(100)]
    far = lambda k, n: [f"{k}{i}" if i % n == 0 else w for i, w in enumerate(base)]
    texts = []
    for words, times in ((base, 40), (far("b", 25), 9), (far("c", 20), 7), (far("d", 17), 1), (far("e", 12), 1)):
        for _ in range(times):
            own = list(words)
            own[rng.randrange(100)] = f"z{rng.randrange(9)}"
            texts.append(" ".join(own))
    for block in (3, 256):
        check(neardup.near_duplicates(docs(texts), percent=85, block=block), texts, 85)


def test_null_and_repeated_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(None, a), (7, a), (5, a), (None, b), (7, b), (9, "x"), (None, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=str)
    assert got == sorted([(None, 5, False), (7, 5, False), (5, 5, True), (None, 7, False), (7, 7, True), (9, 9, True), (None, None, True)], key=str)


def test_empty_table_and_clashing_columns(docs):
    empty = neardup.near_duplicates(docs([]))
    assert empty.count() == 0
    clash = docs(["a b c d e f", "a b c d e f"]).withColumn("component_id", F.lit(7)).withColumn("kept", F.lit("x")).withColumn("u", F.lit(1))
    assert [(r.doc_id, r.component_id) for r in neardup.near_duplicates(clash).orderBy("doc_id").collect()] == [(0, 0), (1, 0)]
    assert neardup.distinct_documents(clash).columns == clash.columns


def test_repeated_rows(docs):
    twice = docs(["a b c d e f g", "q r s"]).unionByName(docs(["a b c d e f g", "q r s"]))
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(twice).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_signatures_lose_less_than_banding():
    n = neardup.BANDS * neardup.ROWS
    for percent in (80, 85):
        t = percent / 100
        row = np.zeros((1, n), np.uint32)
        lost = 0.0
        for equal in range(n + 1):
            other = np.where(np.arange(n) < equal, 0, 1).astype(np.uint32)[None, :]
            if not neardup.alike(row, other, percent)[0]:
                lost += math.comb(n, equal) * t**equal * (1 - t) ** (n - equal)
        banding = (1 - t**neardup.ROWS) ** neardup.BANDS
        assert lost < banding / 10
        if percent == 85:
            assert lost + banding < 1 / 2_000_000
