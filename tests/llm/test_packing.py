import math
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from plinth.llm import packing
from plinth.llm.queries import public_tokenizer

PATH = public_tokenizer("word_bpe_49k.json")


def test_stretches_encode_like_the_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 7)
    whole, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    odd = ["", " ", "don't STOP\tnow\r\nit's", "e \u0301á ẞΣΣ σ", "a\u2003b\xa0c\x0bd\x85e f\x1cg\x1f", "x<|endoftext|>y <|startoftext|> <| endoftext|> a,<|endoftext|>.b", "12345 6.78e9 ...!!!'s", "日本語 text \U0001f600\U0001f600", "w" * 50 + " v" * 50]
    odd += ["İstanbul, e\u0301, a,\u0301b c1\u0327 Straße. ÀÉŸ-ſharp?! I'LL (we've) x'", "k\u212a µm ŉa. 3\u0660,4 \u00b2x _y__ #!a\u0300", "ÀB" * 30 + "…", "\u0301a ,\u0301 a.\u0301"]
    assert packing.folds(whole)
    rng = np.random.default_rng(0)
    signs = list("aZ9éİſß'.,<|>- \n\u0301\u2003Σς&#²") + ["<|endoftext|>", "'s", "'LL"]
    odd += ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(3000)]
    texts = [*odd, " ".join(odd), "\n".join(odd * 3)]
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    words = packing.encoder(public_tokenizer("byte_bpe_50k.json"))
    assert not packing.folds(words.words.tokenizer) and words([""])[0].tolist() == []


def test_scores_are_bm25():
    rng = np.random.default_rng(0)
    tails = [np.append(rng.integers(3, 40, n), 2).astype("<u4") for n in rng.integers(0, 60, 50)]
    counts = [Counter(t.tolist()) for t in tails]
    df = Counter(x for c in counts for x in c)
    n, mean = len(tails), sum(map(len, tails)) / len(tails)
    idf = packing.weights_of(dict(df), n)
    index = packing.Index(tails, idf, mean, 2)
    for k in range(n):
        want = []
        for c, t in zip(counts, tails):
            s = 0.0
            for x in set(counts[k]) - {2}:
                if c[x]:
                    s += math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * len(t) / mean))
            want.append(s)
        assert np.allclose(index.scores(k), want)


def plain_fill(lengths, scores, window):
    """The rules one after the other, on sets."""
    unused, out, rest = set(range(len(lengths))), [], None
    while unused or rest:
        if rest:
            sequence, asked = [rest], rest[0]
        else:
            asked = min(unused)
            unused.discard(asked)
            sequence = [(asked, 0, lengths[asked])]
        rest, room = None, window - sequence[0][2]
        s = scores(asked)
        near = sorted((k for k in unused if s[k] > 0), key=lambda k: (-s[k], k))
        best = None
        for k in near:
            if room and lengths[k] <= room:
                sequence.append((k, 0, lengths[k]))
                unused.discard(k)
                room -= lengths[k]
            elif room and best is None:
                best = k
        while room and unused:
            k, best = (min(unused) if best is None else best), None
            unused.discard(k)
            part = min(room, lengths[k])
            sequence.append((k, 0, part))
            room -= part
            if part < lengths[k]:
                rest = (k, part, lengths[k] - part)
        out.append(sequence)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_fill_by_score(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 16, 80).tolist()
    table = rng.integers(0, 4 if seed else 1, (80, 80)).astype(float)
    got = packing.fill(lengths, lambda k: table[k], 16)
    assert got == plain_fill(lengths, lambda k: table[k], 16)
    assert all(sum(p[2] for p in s) == 16 for s in got[:-1])
    parts = packing.split_last([(0, 3, 5), (1, 0, 6)])
    assert [sum(p[2] for p in s) for s in parts] == [8, 2, 1] and [p for s in parts for p in s] == [(0, 3, 5), (1, 0, 3), (1, 3, 2), (1, 5, 1)]


def test_topics_share_or_split_shards():
    plan = packing.shards_of({-1: 3, 5: 4, 7: 25, 8: 1, 9: 9, 12: 1}, 10)
    assert plan == [(-1, 0, 1), (5, 0, 1), (7, 1, 3), (8, 4, 1), (9, 4, 1), (12, 5, 1)]


def test_every_id_lies_in_one_piece(spark, docs):
    texts = [None, "", "  \n ", "a", "a"] + [" ".join(f"{w} {k % 7}" for k in range(n)) for n, w in ((3, "tree"), (40, "tree"), (400, "stone"), (41, "stone"), (5, "river"))] + ["same words again"] * 60
    d = docs(texts)
    extra = spark.createDataFrame([(None, "null id"), (3, "again"), (3, "again")], "doc_id long, text string")
    d = d.select("doc_id", "text").unionByName(extra).selectExpr("*", "'x' as ids", "1 as shard", "2 as at")
    whole = Tokenizer.from_file(PATH)
    rows = packing.pack(d.repartition(3), PATH, window=64, end_id=2, shard_tokens=256).collect()
    ids = {}
    for r in rows:
        own = np.frombuffer(r.ids, "<u4")
        assert len(own) == r.length > 0
        for k, x in enumerate(own.tolist()):
            ids.setdefault((r.doc_id, r.doc_tokens), []).append((r.start + k, x))
    for text, doc in [*zip(texts, range(len(texts))), ("null id", None)]:
        want = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        if doc != 3:  # this id stands on three rows
            assert sorted(ids[doc, len(want)]) == list(enumerate(want))
    assert sum(r.length for r in rows) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*texts, "null id", "again", "again"])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0
    assert max(sum(n for _, n in s) for s in sequences.values()) == 64


def test_neighbours_share_a_window_and_empty_tables(docs):
    texts = [" ".join([w] * 7 + [f"{k}"]) for k in range(6) for w in ("oak", "granite", "delta")]
    rows = packing.pack(docs(texts), PATH, window=32, shard_tokens=10_000).collect()
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, set()).add(texts[r.doc_id].split()[0])
    assert sum(len(v) == 1 for v in of.values()) >= len(of) - 3
    assert packing.pack(docs([]), PATH).collect() == []
