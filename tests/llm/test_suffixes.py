import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import suffixes


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = {}
    for d, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, kept)
    return out


def run(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, **options).collect()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.choice([20, 60, 110]))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                at = rng.randrange(len(p))
                p = p[:at] + "#" + p[at + 1 :]
            parts += [" ".join(word() for _ in range(rng.randint(0, 30))), p[rng.randint(0, 30) :]]
        texts.append(" ".join(parts))
    return texts + [texts[0], None, "", "x", "ab" * 700, "ab" * 300 + "c" + "ab" * 300, "a" * 900]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    texts = corpus(seed)
    assert run(docs(texts), length=120) == brute(texts, 120)


def test_hot_seeds_take_the_exact_way(docs):
    texts = corpus(3)
    assert run(docs(texts), length=120, most_contexts=1, broadcast_bytes=0) == brute(texts, 120)


def test_length_400_and_empty(docs):
    p = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    texts = ["u" + p[:399] + "v", "w" + p[:399] + "x", "y" + p[:400] + "z", p[:400], p[50:450]]
    assert run(docs(texts)) == brute(texts, 400)
    assert run(docs([])) == {}
    clash = docs(texts).withColumn("seed", F.lit(1)).withColumn("kept", F.lit("k"))
    assert run(clash) == brute(texts, 400)


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    texts = corpus(4)
    ids = [None if i % 7 == 0 else i // 3 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, length=120).collect()), key=str)
    assert got == sorted(((i, *brute(texts, 120)[k]) for k, i in enumerate(ids)), key=str)


def test_texts_longer_than_a_window(docs):
    rng = random.Random(6)
    long_text = "".join(rng.choice("abcdefgh ") for _ in range(3 * suffixes.WINDOW + 1234))
    passage = long_text[suffixes.WINDOW - 300 : suffixes.WINDOW + 400]  # across the edge of two windows
    got = run(docs([long_text, "u" + passage + "v", long_text[-450:]]))
    assert [(x[1], x[2]) for x in (got[0], got[1], got[2])] == [(700 + 450, 2), (700, 1), (450, 1)]
    assert got[0][3].decode() == long_text[: suffixes.WINDOW - 300] + long_text[suffixes.WINDOW + 400 : -450]
    sizes = np.array([0, 300, 5300, 5301])
    seen = [(i, b - [0, 300, 5300][i] - shift, x + shift) for i, b, own, shift in suffixes.parts_of(sizes, 50, 600) for x in range(int(own[-1]) - 50 + 1) if len(own) == 2]
    assert sorted(x for i, _, x in seen if i == 1) == list(range(5000 - 50 + 1))


def brute_words(texts, words):
    lists = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split() for t in texts]
    seen = {}
    for w in lists:
        for i in range(len(w) - words + 1):
            seen[tuple(w[i : i + words])] = seen.get(tuple(w[i : i + words]), 0) + 1
    out = {}
    for d, w in enumerate(lists):
        gone = set()
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone.update(range(i, i + words))
        out[d] = len(gone)
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_repeated_words_against_brute_force(docs, seed):
    texts = corpus(seed) + [corpus(seed)[1].upper().replace(" ", "\n\t"), "Short"]
    got = {r.doc_id: r.n_repeat_words for r in suffixes.repeated_words(docs(texts), words=20).collect()}
    assert got == brute_words(texts, 20) and any(got.values())
    both = {r.doc_id: (r.n_removed, r.n_repeat_words) for r in suffixes.remove_repeats(docs(texts), length=120, words=20).collect()}
    assert both == {k: (brute(texts, 120)[k][1], got[k]) for k in got}


def test_no_structure_makes_digests_collide(docs):
    # Thue-Morse words collide under any polynomial hash modulo 2**64.
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = ["x" * 60 + a + "y" * 60, "x" * 60 + b + "y" * 60]
    assert run(docs(texts), length=900) == brute(texts, 900)


def test_mergesort_orders_suffixes_within_groups():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000, dtype=np.uint8)
    start = rng.integers(0, 2900, 200)
    end = np.minimum(start + rng.integers(1, 90, 200), 3000)
    groups = np.sort(rng.integers(0, 7, 200))
    order = suffixes.Suffixes(data, start, end).sort(groups)
    for g in range(7):
        mine = [i for i in order if groups[i] == g]
        assert mine == sorted(np.flatnonzero(groups == g), key=lambda i: (bytes(data[start[i] : end[i]]), i))
