import importlib.util
import pathlib
import random

import pyarrow as pa

import corpus_pipeline
from plinth.llm import mixing, queries


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak = text(30)
    rows = [(i, text(60), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in text(60).split()), "en", "s0") for i in range(40)]
    rows += [(300, rows[5][1], "en", "s1"), (301, text(20) + " " + leak + " " + text(20), "en", "s2"), (302, None, "en", None), (303, "", "en", "s1")]
    kind = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, kind).selectExpr("*", "cast(coalesce(length(text), 0) as long) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rows if r[0] < 240 and r[0] % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.write_and_read(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {i for i in range(200, 240)} and 301 not in ids and 300 not in ids
    assert set(range(120)) <= ids and {302, 303} <= ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids and len(out) == len(ids)
    assert len(corpus_pipeline.STAGES) == 5


def test_shards_follow_the_mixture(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.random()) for _ in range(12)), "en", "big" if i % 10 < 7 else "mid" if i % 10 < 9 else "small", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    laid = corpus_pipeline.write_and_read(corpus_pipeline.mix_stage(spark, docs, str(tmp_path)), "mix")
    out = corpus_pipeline.shard_stage(spark, laid, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    weights = mixing.tempered(docs, power=0.7)
    source, place = {r[0]: r[3] for r in rows}, {r.doc_id: r for r in corpus_pipeline.mixed(docs, weights, corpus_pipeline.F.xxhash64("text")).collect()}
    shards = {}
    for r in sorted(out.collect(), key=lambda r: r.slot):
        shards.setdefault(r.shard, []).append(r.doc_id)
    assert len(shards) == 24 and sorted(sum(shards.values(), [])) == list(range(4000))
    prefix = []
    for ids in shards.values():
        positions = [place[i].mix_position for i in ids]
        assert positions == sorted(positions)
        prefix += ids[:60]
    # In order of a hash the share of `big` is 0.7; its weight is 0.59.
    for s, w in weights.items():
        assert abs(sum(source[i] == s for i in prefix) / len(prefix) - w) < 0.03


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak, near = text(30), text(60).split()
    rows = [(i, text(60), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [rows[4]] * 3  # equal rows
    rows += [(5, text(60), "en", "s0", 0), (5, text(60), "en", "s2", 0)]  # other documents of one id
    rows += [(None, text(60), "en", "s1", 0), (None, text(60), "en", None, 0), (None, rows[6][1], "en", "s1", 0), (None, None, "en", "s1", 0)]
    rows += [(70, " ".join(near), "en", "s1", 0), (70, " ".join([*near, "more"]), "en", "s1", 0), (None, " ".join(["less", *near]), "en", "s0", 0)]
    rows += [(7, text(20) + " " + leak, "en", "s1", 0), (None, leak + " " + text(20), "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted([*range(60), 5, 5, 70])
    assert sum(r.doc_id is None for r in out) == 3
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def beside(name):
    """A test module of this folder, for its brute-force functions."""
    spec = importlib.util.spec_from_file_location(name, pathlib.Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages_equal_brute_force(spark, tmp_path):
    """Copies by all pairs, passages by all windows, the classifier's verdicts by its own scores, every row in one shard."""
    near, leaks = beside("test_neardup"), beside("test_decontaminate")
    rng = random.Random(12)
    texts = near.sample(4, 40)
    items = [leaks.filled(s, rng, ["Otto", "Anna"]) for s in leaks.made_items(rng, 9)]
    texts += [f"{t} {rng.choice(items)} and more" for t in near.sample(5, 24)] + [None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    model = corpus_pipeline.quality.fit(docs, labels)
    scores = model.scores(pa.array(texts, pa.string()))
    assert ids(corpus_pipeline.quality_stage(spark, docs, str(tmp_path))) == [i for i, x in enumerate(scores) if x >= 0.3]
    found = near.brute(texts, 80)
    assert ids(corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))) == [i for i in range(len(texts)) if found[i][1] == i]
    holders = {d for d, _ in leaks.brute(texts, items)}
    assert holders and ids(corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path))) == [i for i in range(len(texts)) if i not in holders]
    laid = corpus_pipeline.mix_stage(spark, docs.unionByName(docs.where("doc_id < 3")), str(tmp_path))
    assert sorted(map(tuple, laid.collect()), key=str) == sorted(rows + rows[:3], key=str)
    out = corpus_pipeline.shard_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size) for r in out) == [(i, len((t or "").encode()) + 8) for i, t in enumerate(texts)]


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


CLASHING = ["score", "predicted", "mix_block", "mix_slot", "mix_position", "in_mix", "_row", "_key", "_id", "_text", "_own", "_source", "component_id", "kept", "n_shingles", "_rank", "_carried_0", "doc_id_", "hash", "size", "shard", "slot", "a.b"]


def test_columns_of_any_name_come_back(spark, tmp_path):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ako", "emi", "oru", "uta")]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    rows = [(i % 50 if i % 7 else None, t, "en", f"s{i % 2}", 0, *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    rows += [rows[3], (*rows[4][:-1], "other"), (70, "x" * 200_000 + " end", "en", None, 1, *["long"] * len(CLASHING)), (71, "", None, None, None, *["empty"] * len(CLASHING))]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, kind)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "nothing of the kind stands anywhere in these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).checkpoint()
        assert kept.schema.names == docs.schema.names, name
        assert {tuple(r) for r in kept.collect()} <= set(rows), name
    assert len(kept.collect()) == len(set(rows)) - 1  # one of equal rows and one of the two near copies stay
    out = corpus_pipeline.shard_stage(spark, kept, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() == kept.count()
    assert stage_of_nothing(spark, docs.where("false"), str(tmp_path)) == []


def stage_of_nothing(spark, docs, folder):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    return docs.collect()
