import hashlib
import heapq
import zlib

import pytest
from pyspark.sql import functions as F

from plinth.llm import mixing, sharding


def test_schedule_deviates_by_less_than_one_block():
    for weights, period in (({"a": 5, "b": 3, "c": 1, "d": 0.01}, 100), ({"x": 1}, 10), ({str(i): i + 1 for i in range(17)}, 997)):
        counts = mixing.quotas(weights, period)
        assert sum(counts.values()) == period and min(counts.values()) >= 1
        had = dict.fromkeys(counts, 0)
        for s, _, slot in mixing.schedule(counts):
            had[s] += 1
            for k, c in counts.items():
                assert abs(had[k] - c / period * (slot + 1)) < 1


def test_mix_equals_a_slot_by_slot_simulation(docs):
    """Earliest deadline first over all blocks, one slot after the other, without a period."""
    counts, block = {"a": 5, "b": 3, "c": 1}, 2
    n = {"a": 130, "b": 61, "c": 40}
    d = docs([f"t{i}" for i in range(sum(n.values()))], [s for s in n for _ in range(n[s])])
    out = mixing.mix(d, counts, block=block, period=36).collect()
    total = sum(counts.values())
    want, had = {}, dict.fromkeys(counts, 0)
    for slot in range(2000):
        ready = []
        for s, c in counts.items():
            j = had[s]
            if j * total // c <= slot:
                ready.append((-(-(j + 1) * total // c), 1 if (j + 1) * total % c == 0 else 0, s, j))
        if ready:
            due, _, s, j = min(ready)
            assert slot < due
            want[s, j] = slot
            had[s] += 1
    got = {(r.source, r.mix_block): r.mix_slot for r in out}
    assert got == {k: want[k] for k in got} and len(got) == 65 + 31 + 20
    by_block = {}
    for r in out:
        by_block.setdefault((r.source, r.mix_block), []).append(r.mix_position - r.mix_slot * block)
    assert all(sorted(x) == list(range(len(x))) for x in by_block.values())


def test_too_many_sources_are_refused(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    d = docs(["a", "b", "c"])
    with pytest.raises(ValueError, match="more than 2 sources"):
        mixing.tempered(d)
    with pytest.raises(ValueError, match="more than 2 sources"):
        mixing.mix(d, {"s0": 1, "s1": 1, "s2": 1})


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (3, "b"), (4, None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 2, "b": 1, "\x00null": 1}, block=1, period=8)
    assert sorted(((r.doc_id, r.source) for r in out.collect()), key=str) == sorted(rows, key=str)
    assert out.select("mix_position").distinct().count() == len(rows)


def test_mix_places_every_row_once(docs):
    d = docs([f"t{i}" for i in range(300)], ["hot" if i % 3 else ("cold" if i % 2 else None) for i in range(300)])
    out = mixing.mix(d, {"hot": 0.5, "cold": 0.3, "\x00null": 0.2}, block=4, period=20).collect()
    assert sorted(r.doc_id for r in out) == list(range(300))
    assert len({r.mix_position for r in out}) == 300
    blocks = {}
    for r in out:
        blocks.setdefault((r.source, r.mix_block), set()).add(r.mix_slot)
    assert all(len(x) == 1 for x in blocks.values())
    order = sorted((next(iter(s)), k[0]) for k, s in blocks.items())
    last = min(max(s for s, src in order if src == x) for x in ("hot", "cold", None))
    for t in range(1, last):
        for src, w in (("hot", 0.5), ("cold", 0.3), (None, 0.2)):
            assert abs(sum(s < t and a == src for s, a in order) - w * t) < 1
    assert all(r.in_mix == (r.mix_slot <= last) for r in out)


def test_mix_errors_empty_and_clash(docs):
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(docs(["a"], ["s"]), {"t": 1.0}).collect()
    assert mixing.mix(docs([]), {"a": 1.0}).count() == 0
    assert mixing.mix(docs([]), mixing.tempered(docs([]))).count() == 0
    clash = docs(["a", "b"]).withColumn("mix_slot", F.lit(9))
    assert mixing.mix(clash, mixing.tempered(clash)).columns[-4:] == ["mix_block", "mix_slot", "mix_position", "in_mix"]
    twice = docs(["a"]).unionByName(docs(["a"]))
    assert mixing.mix(twice, {"s0": 1.0}).count() == 2


def test_shards(docs):
    texts = [f"text {i % 50} " * (i % 7 + 1) for i in range(400)] + [None, "", "é" * 1000] + ["same"] * 150
    out = sharding.shard(docs(texts), shards=5, bundles=64).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    home = {}
    for r in out:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t) and r.grown_shard is None and r.law == "bytes"
        assert home.setdefault(t, r.shard) == r.shard
    loads = {s: sum(r.size for r in out if r.shard == s) for s in range(5)}
    assert max(loads.values()) - min(loads.values()) < 0.1 * sum(loads.values()) / 5
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_shards_equal_longest_first_over_all_groups(docs):
    """With more bundles than bytes every group is an item of its own, and the plan is the textbook's."""
    texts = [f"text {i % 90} " * (i % 11 + 1) for i in range(500)] + [None, "", "z" * 4000]
    groups = {}
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 8
    heap, home = [(0, s) for s in range(6)], {}
    for t, size in sorted(groups.items(), key=lambda x: (-x[1], hashlib.sha256(x[0].encode()).hexdigest())):
        load, s = heapq.heappop(heap)
        home[t] = s
        heapq.heappush(heap, (load + size, s))
    out = sharding.shard(docs(texts), shards=6, bundles=1 << 20).collect()
    assert {r.doc_id: r.shard for r in out} == {i: home[t or ""] for i, t in enumerate(texts)}


def test_the_fullest_shard_is_over_the_mean_by_less_than_an_item(docs):
    texts = [f"t{i}" * (i % 13 + 1) for i in range(900)] + ["long " * 300] * 3
    for bundles in (2, 8, 64):
        out = sharding.shard(docs(texts), shards=7, bundles=bundles)
        loads = [r.bytes for r in sharding.balance(out).collect()]
        sizes = {}
        for t in texts:
            sizes[t] = sizes.get(t, 0) + len(t) + 8
        small = [x for x in sizes.values() if x * 7 * bundles < sum(sizes.values())]
        largest = max(max(sizes.values()), sum(small) if bundles == 2 else 3 * sum(small) / (7 * bundles) + max(small))
        assert max(loads) < sum(loads) / 7 + largest


def test_shards_of_little(docs):
    assert sharding.shard(docs([])).count() == 0
    assert sharding.shard(docs([None])).first().slot == 0
    clash = docs(["a", "a"]).withColumn("shard", F.lit("x")).withColumn("item", F.lit("y"))
    assert {r.shard for r in sharding.shard(clash, 3).collect()} <= {0, 1, 2}
    assert sharding.balance(sharding.shard(docs(["a", "b"]), 2)).count() == 2


def test_slots_follow_positions(docs):
    texts = [f"text {i} " * (i % 7 + 1) for i in range(300)] + ["same"] * 60
    place = lambda rows: rows.withColumn("position", (F.col("doc_id") * 7919 % 20011).cast("long"))
    out = sharding.shard(docs(texts), shards=4, bundles=16, place=place).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for s in range(4):
        mine = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [r.doc_id * 7919 % 20011 for r in mine] == sorted(r.doc_id * 7919 % 20011 for r in mine)
