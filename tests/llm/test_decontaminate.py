import collections
import itertools
import random

import pytest
import regex
from pyspark.sql import functions as F

from plinth.llm import decontaminate

ITEM = "A farmer named Otto sold 12 apples and 30 pears at the market for 5 dollars each before the train to Berlin left the station."
MOVED = "A farmer named Karl sold 14 apples and 99 pears at the market for 8 euros each before the train to Vienna left the station."
PLAIN = "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from the old stone wall"


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(0, ITEM), (1, PLAIN), (2, ""), (3, None), (4, "hello there")], "item_id long, text string")


def found(docs, items, texts, **options):
    return sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(texts), items, **options).collect())


def test_verbatim_and_re_parameterised(docs, items):
    texts = ["filler words here " + ITEM + " and more", MOVED, "x y z " + PLAIN.upper() + "!", "nothing of the kind is in this text at all", None, "", PLAIN[:40], "Hello, THERE!", "a hello there b"]
    assert found(docs, items, texts) == [(0, 0), (1, 0), (2, 1), (7, 4)]


def test_broadcast_and_shuffle_agree(docs, items):
    texts = [ITEM, MOVED, PLAIN, "other words stand here in their place now"]
    assert found(docs, items, texts) == found(docs, items, texts, broadcast_windows=0)


def test_slots_must_be_consistent(spark, docs):
    item = spark.createDataFrame([(0, "so Anna gave Anna a book and Anna took the pen while Anna read what Anna wrote to Anna")], "item_id long, text string")
    same = "so Bea gave Bea a book and Bea took the pen while Bea read what Bea wrote to Bea"
    mixed = "so Bea gave Carl a book and Dora took the pen while Emil read what Fritz wrote to Gerda"
    assert found(docs, item, [same, mixed]) == [(0, 0)]


def test_windows_of_slots_alone_say_nothing(spark, docs):
    item = spark.createDataFrame([(0, "1 2 3 4 5 6 7 8 9 10")], "item_id long, text string")
    assert found(docs, item, ["11 12 13 14 15 16 17 18 19 20", "1 2 3 4 5 6 7 8 9 10"]) == []


def test_names_that_start_sentences(spark, docs):
    asked = "Otto has 5 apples. Otto buys 3 more apples at the shop. How many apples does Otto have now?"
    once = "Otto has 5 apples. Then 3 more apples come from the shop in the town. \"Anna takes some of them,\" he said.\nFive are left."
    item = spark.createDataFrame([(0, asked), (1, once)], "item_id long, text string")
    changed = asked.replace("Otto", "Karl").replace("5", "7").replace("3", "9")
    other = once.replace("Otto", "Karl").replace("Anna", "Berta").replace("Five", "Six").replace("5", "7")
    mixed = "Karl has 5 apples. Emil buys 3 more apples at the shop. How many apples does Fritz have now?"
    texts = [asked, changed, "so it was: " + changed, "we ask: if " + changed, other, mixed, "Nothing of this. Is in here. At all. Now or then. Or ever."]
    assert found(docs, item, texts) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)]


def brute_tokens(text):
    """(kind, value) of each word, by the module's word patterns."""
    d = decontaminate
    out = regex.sub(d._JOINED_UNIT, r"\1 ", text)
    for kind, pattern in (("name", d._NAME), ("maybe", d._INITIAL), ("num", d._NUMBER)):
        out = regex.sub(pattern, lambda m, kind=kind: f"{d._OPEN}{kind}{d._CLOSE}{m[0]}", out)
    words = regex.sub(rf"[^\p{{L}}\p{{M}}\p{{N}}{d._OPEN}{d._CLOSE}\s]+", "", out.lower()).split()
    found = []
    for w in words:
        kind, _, value = w[1:].partition(d._CLOSE) if w[0] == d._OPEN else ("word", "", w)
        value = value.rsplit(d._CLOSE, 1)[-1]
        if kind in ("word", "maybe"):
            kind = "num" if value in d.NUMBER_WORDS else "unit" if value in d.UNITS else kind
        found.append((kind, value))
    return found


def brute_windows(words, item):
    """Templates of each window, in each choice of words that may be names."""
    out = []
    for i in range(max(1, len(words) - 4) if words else 0):
        options = []
        for kind, value in words[i : i + 5]:
            options.append([("name", None)] if kind == "name" else [(kind, None)] if kind in ("num", "unit") else [("word", value)] if kind == "word" else [("word", value), ("name", None)])
        made = set(itertools.product(*options))
        out.append({t for t in made if not item or any(k == "word" for k, _ in t)})
    return out


def brute(texts, items, threshold=0.8):
    out = {}
    for d, text in enumerate(texts):
        words = brute_tokens(text or "")
        holds = collections.defaultdict(list)
        for i, w in enumerate(brute_windows(words, False)):
            for t in w:
                holds[t].append(i)
        for k, item in enumerate(items):
            own = brute_tokens(item or "")
            first = [("maybe", own[0][1]) if own[0][0] == "word" else own[0]] if own else []
            wanted = {i: w for i, w in enumerate(brute_windows(first + own[1:], True)) if w}
            hit = [(pos, i) for i, w in wanted.items() for t in w for pos in holds.get(t, ())]
            if not wanted or len({i for _, i in hit}) < threshold * len(wanted) - 1e-9:
                continue
            votes = collections.defaultdict(collections.Counter)
            for at, item_at in {(pos + j, i + j) for pos, i in hit for j in range(5)}:
                if at < len(words) and item_at < len(own) and words[at][0] != "word" and own[item_at][0] != "word":
                    (a, x), (b, y) = words[at], own[item_at]
                    if a == "maybe" and (a, x) == (b, y):
                        continue
                    a, b = ("name" if z == "maybe" else z for z in (a, b))
                    votes[at - item_at, (b, y)][a, x] += 1
            n = sum(sum(v.values()) for v in votes.values())
            most = sum(max(v.values()) for v in votes.values())
            if not n or most >= threshold * n - 1e-12:
                out[d, k] = (round(len({i for _, i in hit}) / len(wanted), 9), n)
    return out


def made_items(rng, n):
    """Questions with names, numbers and units, some of one template."""
    plain = "the a of some train box river old green quickly carry sold bought found and with from at many how much will before after house market apples pears books street".split()
    shapes = [[rng.choice([*plain, "NAME", "NUM", "UNIT", "."]) if i % 4 else rng.choice(plain) for i in range(rng.randint(6, 40))] for _ in range(max(1, n - 4))]
    return [shapes[i % len(shapes)] for i in range(n)]


def filled(shape, rng, names):
    same = {}
    value = lambda kind, choices: same.setdefault((kind, rng.randrange(3)), rng.choice(choices))
    words = [value(w, names) if w == "NAME" else str(value(w, range(2, 90))) if w == "NUM" else value(w, ["kg", "miles", "hours", "dollars"]) if w == "UNIT" else w for w in shape]
    return " ".join(words).replace(" .", ". The").strip() + "?"


def test_against_brute_force(spark, docs):
    rng = random.Random(9)
    shapes = made_items(rng, 14)
    items = [filled(s, rng, ["Otto", "Anna", "Emil"]) for s in shapes] + ["", None, "Short one", "1 2 3"]
    texts = [f"before it. {filled(rng.choice(shapes), rng, ['Karl', 'Berta', 'Otto'])} and after it {rng.choice(items)}" for _ in range(40)]
    texts += [items[0], items[3].upper(), "Short one", "short", "", None, " ".join(i or "" for i in items)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 9), r.n_slots) for r in decontaminate.contaminated(docs(texts), table).collect()}
    want = brute(texts, items)
    assert got == want and len(want) > 50


def test_recall_of_re_parameterised_items(spark, docs):
    """Every benchmark item with slots put into it, all of whose names, numbers and units are then changed."""
    rng = random.Random(10)
    read = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect()
    items, texts = [], []
    for r in read:
        words, asked, changed = r.text.split(), [], []
        slots = [("Otto", "Karl"), ("12", "47"), ("3.5", "8"), ("miles", "hours"), ("Anna", "Berta"), ("five", "nine")]
        for i, w in enumerate(words):
            asked.append(w)
            changed.append(w)
            if i % 5 == 4:
                a, b = slots[rng.randrange(len(slots))]
                asked.append(a)
                changed.append(b)
        items.append(" ".join(asked))
        texts.append("some text that comes before. " + " ".join(changed) + " and more of it after that")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(texts), table).collect()}
    caught = sum((i, i) in found for i in range(len(items)))
    assert caught >= 0.95 * len(items) and all(a == b for a, b in found)


def test_null_and_repeated_ids(spark):
    inconsistent = "so Bea gave Carl a book and Dora took the pen while Emil read what Fritz wrote to Gerda"
    item = "so Anna gave Anna a book and Anna took the pen while Anna read what Anna wrote to Anna"
    rows = [(None, inconsistent), (5, inconsistent), (None, ITEM), (7, ITEM), (7, "clean text " * 9), (7, MOVED)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (1, ITEM), (1, PLAIN)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, items).collect()), key=str)
    assert got == [(7, 1), (7, 1), (None, 1)]
    renamed = decontaminate.contaminated(df.toDF("k", "body"), items.toDF("q", "words"), id_col="k", text_col="body", item_id_col="q", item_text_col="words")
    assert renamed.count() == 3
    kept = decontaminate.clean(df, items).collect()
    assert sorted(r.text[:5] for r in kept) == ["clean", "so Be", "so Be"]


def test_clean_keeps_rows_and_columns(docs, items):
    d = docs([ITEM, "fine text that is clean", None]).withColumn("item_id", F.lit("x")).withColumn("hash", F.lit(1))
    out = decontaminate.clean(d, items)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_empty_tables_and_long_text(docs, items):
    assert found(docs, items, []) == []
    assert found(docs, items.limit(0), [ITEM]) == []
    assert found(docs, items, ["pad " * 20000 + ITEM]) == [(0, 0)]


def test_main_path_is_native(docs, items):
    plan = decontaminate.contaminated(docs([ITEM]), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
