import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from plinth.llm import fingerprint as fp
from plinth.llm.shingles import shingle_sets
import pyarrow as pa


def sets(*texts):
    return list(shingle_sets(pa.array(texts, pa.string())))


def test_estimates_and_merging():
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(6000)]
    a, b, both = sets(" ".join(words[:4000]), " ".join(words[2000:]), " ".join(words))
    x, y, z = fp.sketch(a), fp.sketch(b), fp.sketch(both)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(fp.resemblance(x, y) - true) < 0.12
    assert abs(fp.distinct(x) / len(a) - 1) < 0.2
    assert abs(fp.containment(x, y) - len(np.intersect1d(a, b)) / len(a)) < 0.2
    assert (fp.merge(x, fp.sketch(np.setdiff1d(both, a))) == z).all()
    assert (fp.unpack(fp.pack(x)) == x).all()


def test_small_texts_are_exact_and_equal_texts_equal():
    a, b, none, again = sets("a b c d e f g", "a b c d e f x", "", "A b c D e f g")
    assert fp.resemblance(fp.sketch(a), fp.sketch(b)) == len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert fp.pack(fp.sketch(a)) == fp.pack(fp.sketch(again)) and fp.pack(fp.sketch(none)) == ""
    assert fp.resemblance(fp.sketch(none), fp.sketch(none)) == 1.0


def test_edited_pairs_against_brute_force(docs):
    texts = ["abc " * i + "é" * (i % 5) for i in range(40)] + [None, "", "x", "long " * 20000]
    for rows_each in (1000, 3):
        out = {r.doc_id: r for r in fp.edited_pairs(docs(texts), rows_each=rows_each).collect()}
        assert len(out) == len(texts)
        plain = [t or "" for t in texts]
        for i, t in enumerate(plain):
            nxt = plain[(i + 1) % len(plain)]
            n = len(t)
            edited = t[: n - n // 2] + nxt[: n // 2]
            assert out[i].n_chars == n and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            sa, sb, sc = sets(t, edited, nxt)
            assert out[i].fingerprint == fp.pack(fp.sketch(sa)) and out[i].edited_fingerprint == fp.pack(fp.sketch(sb))
            assert out[i].near_next == fp.resemblance(fp.sketch(sa), fp.sketch(sc))


def test_empty_single_repeated_and_null_ids(spark, docs):
    assert fp.edited_pairs(docs([])).count() == 0
    one = fp.edited_pairs(docs(["a b c d e f"])).first()
    assert one.doc_id == 0 and one.near_next == 1.0
    assert fp.edited_pairs(docs(["a", "b"]).unionByName(docs(["a", "b"])), rows_each=1).count() == 4
    odd = spark.createDataFrame([(None, "q"), (3, "r")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in fp.edited_pairs(odd).collect()) == ["3", "None"]


def test_fingerprints_and_merge_in_spark(docs):
    d = docs(["a b c d e f g", "g f e d c b a", None]).withColumn("fingerprint", F.lit("clash"))
    made = fp.fingerprints(d)
    merged = fp.merge_fingerprints(made.withColumn("g", F.lit(1)), ["g"]).first().fingerprint
    a, b = sets("a b c d e f g", "g f e d c b a")
    assert merged == fp.pack(fp.sketch(np.union1d(a, b)))
