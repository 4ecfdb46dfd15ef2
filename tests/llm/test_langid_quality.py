import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import langid, quality

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "aa"]


def segmentations(word, table):
    """Sum over all segmentations, by brute force."""

    def walk(i):
        if i == len(word):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(word) + 1):
            piece = word[i:j]
            if piece in table:
                total += table[piece] * walk(j)
            elif j == i + 1:
                total += langid.UNKNOWN * walk(j)
        return total

    return walk(0)


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(PIECES)
    rng = np.random.default_rng(1)
    p = rng.random((len(PIECES) + 1, 2))
    p[-1] = langid.UNKNOWN
    words = ["▁a", "▁abba", "▁bab", "▁xaba", "▁aaaa", "▁ñ"]
    got = langid.log_likelihoods(words, pieces, p)
    for i, w in enumerate(words):
        for lang in range(2):
            want = segmentations(w, {x: p[k, lang] for k, x in enumerate(PIECES)})
            assert got[i, lang] == pytest.approx(np.log(want))


def test_long_words_are_summed_whole():
    pieces = langid.Pieces(PIECES)
    p = np.full((len(PIECES) + 1, 2), 0.01)
    p[:, 1] = np.linspace(0.001, 0.02, len(p))
    p[-1] = langid.UNKNOWN

    def slow(word, lang):
        """The forward algorithm letter by letter in logarithms."""
        table = {x: np.log(p[k, lang]) for k, x in enumerate(PIECES)}
        alpha = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 3), end):
                edge = table.get(word[start:end], np.log(langid.UNKNOWN) if end == start + 1 else None)
                if edge is not None:
                    alpha[end] = np.logaddexp(alpha[end], alpha[start] + edge)
        return alpha[-1]

    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("abñ") for _ in range(n)) for n in (3, 15, 17, 40, 300, 2000)] + ["▁" + "ñ" * 500, "▁a"]
    got = langid.log_likelihoods(words, pieces, p)
    assert got == pytest.approx(np.array([[slow(w, k) for k in range(2)] for w in words]), rel=1e-9)


def test_sample_is_bounded_and_even(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("hot").alias("lang"))
    got = {r._lang: r["count"] for r in langid.sample(docs, 600, "doc_id", "text", "lang").groupBy("_lang").count().collect()}
    assert got["rare"] == 40 and 300 < got["hot"] <= 600


def test_learning_never_lowers_the_likelihood():
    pieces = langid.Pieces(PIECES)
    words, counts = ["▁ab", "▁ba", "▁aab"], np.array([[5.0, 1.0], [1.0, 5.0], [2.0, 2.0]])
    scores = [(langid.log_likelihoods(words, pieces, langid.learn(words, counts, pieces, r, 1e-9)) * counts).sum() for r in range(5)]
    assert all(b >= a - 1e-9 for a, b in zip(scores, scores[1:]))


def test_language_held_out_accuracy_and_edges(spark):
    rng = random.Random(2)
    make = {"en": "the and thing other with house".split(), "de": "der und nicht schule haus mit".split(), "fr": "le et dans maison avec êtes".split()}
    rows = [(i, " ".join(rng.choice(make[lang]) for _ in range(20)), lang) for i, lang in enumerate(rng.choices(list(make), k=150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 100"), rows_each=30)
    got = langid.predict(docs.where("doc_id >= 100"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !! ²"), (4, "a" * 50000 + " the house"), (5, "HOUSE with THE")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    pred = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert [pred[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and pred[5][0] == "en"
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_quality_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu") for b in ("na", "lo", "mi")]
    good = lambda: " ".join(rng.choice(words) for _ in range(60))
    bad = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(5, None), (9999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, rows=200)
    got = quality.score(docs.where("doc_id >= 300"), model).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é"), (4, "q " * 40000), (4, "q " * 40000)], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0
    kept = quality.accepted(docs, labels, rows=200)
    assert kept.columns == docs.columns and kept.count() == pytest.approx(300, abs=8)


def test_batched_features_equal_single_ones():
    texts = ["ab cd ab ab", "", "x", "héllo wörld", "a", "zz zz zz"]
    model = quality.train(pa.array(texts), np.array([1, 0, 1, 0, 1, 0]), epochs=1)
    whole = model.scores(pa.array(texts))
    assert np.allclose(whole, [model.scores(pa.array([t]))[0] for t in texts])


def test_features_and_scores_against_brute_force():
    """Each feature hashed by itself in plain integers, and the logit summed over them."""
    from plinth.llm.shingles import _CODE

    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 29) * 0x94D049BB133111EB & top
        return x ^ x >> 32

    base, pair, shift = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 64 - quality.BITS
    code = [int(c) for c in _CODE]

    def buckets(text):
        data = text.encode()
        words = [mix(sum(code[b] * pow(base, k, 1 << 64) for k, b in enumerate(w)) & top) for w in data.split()]
        out = [w >> shift for w in words]
        out += [mix(0x1234567) >> shift if a == b else mix((a * pair + b) & top) >> shift for a, b in zip(words, words[1:])]
        for n in quality.GRAMS:
            for i in range(len(data) - n + 1):
                h = sum(code[data[i + k]] * pow(base, k, 1 << 64) for k in range(n)) & top
                out.append(((h ^ h >> 32) * (pair + 2 * n) & top) >> shift)
        return out

    texts = ["ab cd ab ab", "", "x", "héllo wörld of ours", "a", "zz zz zz", "one\ttwo\nthree " * 9]
    model = quality.train(pa.array(texts), np.array([1, 0, 1, 0, 1, 0, 1]), epochs=2)
    want = []
    for t in texts:
        found = buckets(t)
        logit = sum(float(model.shares[b]) for b in found) / max(1, len(found)) + model.bias
        want.append(1 / (1 + np.exp(-logit)))
    assert model.scores(pa.array(texts)) == pytest.approx(want, abs=1e-6)


def test_training_follows_the_gradient():
    """One step on one row moves the parameters along the numerical gradient of the loss."""
    texts = ["good words here"] * 3 + ["BAD !! BAD"] * 3
    labels = np.array([1, 1, 1, 0, 0, 0])

    def loss(model):
        p = model.scores(pa.array(texts))
        return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

    losses = [loss(quality.train(pa.array(texts), labels, epochs=k)) for k in (1, 4, 16)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1
