"""Benchmark decontamination by template windows, with Spark expressions only.

Texts are canonicalised: numbers, units and names become typed placeholders
(`<num>`, `<unit>`, `<name>`), letters are lower-cased and other characters go.
A name is a capitalised word in mid-sentence. A capitalised word anywhere else
(at the start of a sentence, a line or a quotation) may be a name or not: its
windows are hashed both ways, in items and documents, so it need not stand in
mid-sentence as well to match as a name. Five-word template windows of
benchmark items are hash-joined with those of whole documents. A document
holds an item when at least `threshold` of the item's windows occur in it and
the slots are consistent: along a diagonal of the match each value of the item
stands for one value of the document, for at least `threshold` of the slots.
That catches items whose numbers or names were changed throughout.

An item's first word may stand in mid-sentence in a document, so it is tried
both ways even if it is not capitalised. Where both texts have the same word
that may be a name, it is no slot. Item windows of
placeholders alone say nothing and are left out. A text of fewer
than five words is one window. Null or empty texts and items match nothing.
Where ids of documents or items are null or repeated, each row is judged by
itself and returned under the id it has. Other columns are not read, whatever
their names. Texts of any length are gone through whole; empty tables give
an empty result. Item windows are broadcast only if there are at most
`broadcast_windows` of them; beyond that the join shuffles.

A template that many items and many documents hold would pair them all. As an
item needs a share `threshold` of its windows, a document that holds it has at
least one of any (1 - threshold) * n + 1 of them: only those that the corpus
has least often make candidates, and the other windows are looked at for
candidates alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.llm.common import aside, cut, if_small, told_apart

WIDTH = 5
#: Number words and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm km kg mg ml lb lbs oz mph kph kilometers kilometres meters metres centimeters centimetres miles mile inches inch feet foot yards yard kilograms kilogram grams gram pounds pound ounces liters litres liter litre gallons gallon hours hour minutes minute seconds days day weeks week months month years year dollars dollar cents cent euros euro percent degrees degree".split()

# Each pattern starts with the character class that fails fastest; what stands before it is looked at after.
_JOINED_UNIT = r"(\d)(?=(?:mm|cm|km|kg|mg|ml|lb|lbs|oz)(?![\p{L}\p{N}]))"
_NUMBER = r"\d(?<![\p{L}\p{N}_]\d)[\d.,:/]*(?:st|nd|rd|th)?%?(?![\p{L}\p{N}_])"
_NAME = r"\p{Lu}(?<=[^\s.!?:][ \t]\p{Lu})\p{Ll}[\p{L}'’\-]*"
#: A capitalised word elsewhere: only characters that are dropped stand between it and the space or edge before it.
_INITIAL = r"\p{Lu}(?<=(?:^|\s)[^\p{L}\p{M}\p{N}\s\ue001]{0,8}\p{Lu})(?=\p{Ll})"
#: Brackets that mark a slot's type; texts lose these characters first.
_OPEN, _CLOSE = "\ue000", "\ue001"
_MAYBE, _AS_NAME = f"{_OPEN}maybe{_CLOSE}", f"{_OPEN}name{_CLOSE}"
#: For each mask of the words of a window that may be names, the masks of those taken as names.
_CHOICES = [[c for c in range(m + 1) if c & m == c] for m in range(1 << WIDTH)]


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits; a slot is OPEN type CLOSE value."""
    out = F.translate(text, _OPEN + _CLOSE, "")
    out = F.regexp_replace(out, _JOINED_UNIT, "$1 ")  # a number written together with its unit is two words
    for pattern, kind in ((_NAME, "name"), (_INITIAL, "maybe"), (_NUMBER, "num")):
        out = F.regexp_replace(out, pattern, f"{_OPEN}{kind}{_CLOSE}$0")
    out = F.regexp_replace(F.lower(out), rf"[^\p{{L}}\p{{M}}\p{{N}}{_OPEN}{_CLOSE}\s]+", "")
    words = F.filter(F.split(out, r"\s+"), lambda w: w != "")
    slot = lambda kind, w: F.concat(F.lit(f"{_OPEN}{kind}{_CLOSE}"), w)

    known = lambda w, v: F.when(v.isin(*NUMBER_WORDS), slot("num", v)).when(v.isin(*UNITS), slot("unit", v)).otherwise(w)

    def typed(w: Column) -> Column:
        maybe = F.when(w.startswith(_MAYBE), known(w, F.substring_index(w, _CLOSE, -1))).otherwise(w)
        return F.when(w.startswith(_OPEN), maybe).otherwise(known(w, w))

    return F.transform(words, typed)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: inlined, it would be computed again at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(words: Column, need_word: bool = False) -> Column:
    """xxhash64 of each window's templates, for each choice of words that may be names; with `need_word`, null for slots alone."""
    # A slot goes without its value; a word that may be a name stands for itself here.
    bare = lambda w: F.when(w.startswith(_MAYBE), F.substring_index(w, _CLOSE, -1)).otherwise(F.substring_index(w, _CLOSE, 1))
    template = lambda w: F.xxhash64(F.when(w.startswith(_OPEN), bare(w)).otherwise(w))
    name = F.xxhash64(F.lit(_AS_NAME[:-1]))

    def windows(w: Column, h: Column, maybe: Column) -> Column:
        def choice(i: Column, c: Column | None) -> Column:
            """The hash with the words of mask `c` taken as names."""
            taken = lambda j, x: x if c is None else F.when(c.bitwiseAND(F.lit(1 << j)) != 0, name).otherwise(x)
            hashed = F.xxhash64(*[taken(j, F.get(h, i + j)) for j in range(WIDTH)])
            if not need_word:
                return hashed
            has_word = F.lit(False)
            for j in range(WIDTH):
                at = F.get(w, i + j)
                is_word = ~at.startswith(_OPEN) | (at.startswith(_MAYBE) & ((F.lit(0) if c is None else c).bitwiseAND(F.lit(1 << j)) == 0))
                has_word = has_word | F.coalesce(is_word, F.lit(False))
            return F.when(has_word, hashed)

        def window(i: Column) -> Column:
            mask = F.get(maybe, i)
            for j in range(1, WIDTH):
                mask = mask + F.coalesce(F.get(maybe, i + j), F.lit(0)) * (1 << j)
            several = lambda m: F.transform(F.get(F.lit(_CHOICES), m), lambda c: choice(i, c))
            return _let(mask, lambda m: F.when(m == 0, F.array(choice(i, None))).otherwise(several(m)))

        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WIDTH, F.lit(0))), window))

    return _let(
        words,
        lambda w: _let(F.transform(w, template), lambda h: _let(F.transform(w, lambda x: x.startswith(_MAYBE).cast("int")), lambda maybe: windows(w, h, maybe))),
    )


def _windows(rows: DataFrame, key: str, words: Column, need_word: bool = False) -> DataFrame:
    # The outer form: for the inner one Spark adds a filter that computes the array a second time.
    found = rows.select(key, F.posexplode_outer(_hashes(words, need_word)).alias("pos", "hashes"))
    return found.select(key, "pos", F.explode_outer("hashes").alias("hash")).where("hash is not null")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item_pos, hash; the first word and words that may be names also as names."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_t"))
    words = F.transform(tokens(F.col("_t")), lambda w, i: F.when((i == 0) & ~w.startswith(_OPEN), F.concat(F.lit(_MAYBE), w)).otherwise(w))
    return _windows(rows, "item_id", words, True).withColumnRenamed("pos", "item_pos").distinct()


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, broadcast_windows: int = 1_000_000, broadcast_ids: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, coverage, slot_consistency, n_slots, changed_slots of each document that holds an item."""
    rows, same_docs = told_apart(docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")), "_own", "_doc")
    known, same_items = told_apart(items.select(F.col(item_id_col).alias("_own_item"), F.col(item_text_col).alias("_item_text")), "_own_item", "_item")
    out = _holders(rows.select(F.col("_doc").alias("doc_id"), "_text"), known.select(F.col("_item").alias("item_id"), "_item_text"), threshold, broadcast_windows, broadcast_ids)
    for same, table, key, own, name in ((same_docs, rows, "_doc", "_own", "doc_id"), (same_items, known, "_item", "_own_item", "item_id")):
        if not same:
            names = table.select(F.col(key).alias(name), F.col(own).alias("_shown"))
            out = out.join(names, name).drop(name).withColumnRenamed("_shown", name)
    return out.select("doc_id", "item_id", "coverage", "slot_consistency", "n_slots", "changed_slots")


def _holders(rows: DataFrame, items: DataFrame, threshold: float, broadcast_windows: int, broadcast_ids: int) -> DataFrame:
    """`contaminated` for rows (doc_id, _text) and items (item_id, _item_text) whose ids tell them apart."""
    bench = cut(item_windows(items, "item_id", "_item_text"))
    sizes = bench.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"))
    # Distinct templates share their hash rows; item ids come back after the large join.
    known = bench.select("hash").distinct()
    small = bench.count() <= broadcast_windows
    fit = F.broadcast if small else (lambda df: df)
    texts = rows.where("_text is not null")
    hits = cut(_windows(texts, "doc_id", tokens(F.col("_text"))).join(fit(known), "hash"))
    # The windows of each item that the corpus has least often, one more than a holder may lack.
    often = hits.groupBy("hash").agg(F.count("*").alias("_often"))
    places = bench.join(fit(often), "hash", "left").groupBy("item_id", "item_pos").agg(F.coalesce(F.sum("_often"), F.lit(0)).alias("_often"))
    ranked = places.withColumn("_rank", F.row_number().over(Window.partitionBy("item_id").orderBy("_often", "item_pos")))
    needed = F.ceil(F.col("item_windows") * threshold - 1e-9)
    probes = ranked.join(sizes, "item_id").where(F.col("_rank") <= F.col("item_windows") - needed + 1).select("item_id", "item_pos")
    probes = cut(bench.join(probes, ["item_id", "item_pos"]).select("item_id", "hash").distinct())
    candidates = hits.select("doc_id", "hash").join(fit(probes), "hash").select("doc_id", "item_id").distinct()
    # Joined on the hash first: a document's hits meet the items that have them, not all its candidates.
    matched = cut(hits.join(fit(bench), "hash").join(candidates, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "pos", "item_pos"))
    covered = matched.groupBy("doc_id", "item_id").agg(F.countDistinct("item_pos").alias("hit_windows"))
    covered = covered.join(fit(sizes), "item_id")
    covered = covered.withColumn("coverage", F.col("hit_windows") / F.col("item_windows")).where(F.col("hit_windows") >= needed)
    covered = cut(covered.select("doc_id", "item_id", "coverage"))

    # Slots of the covered pairs only: their texts are read again.
    wanted = matched.join(covered.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
    held = cut(texts.join(if_small(covered.select("doc_id").distinct(), broadcast_ids), "doc_id", "left_semi"))
    doc_slots = held.select("doc_id", F.posexplode_outer(tokens(F.col("_text"))).alias("at", "doc_value")).where(F.col("doc_value").startswith(_OPEN)).distinct()
    item_slots = items.select("item_id", F.posexplode_outer(tokens(F.col("_item_text"))).alias("item_at", "item_value")).where(F.col("item_value").startswith(_OPEN)).distinct()
    at = wanted.select("doc_id", "item_id", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("_j"), "pos", "item_pos")
    at = at.select("doc_id", "item_id", (F.col("pos") + F.col("_j")).alias("at"), (F.col("item_pos") + F.col("_j")).alias("item_at")).distinct()
    slots = at.join(doc_slots, ["doc_id", "at"]).join(item_slots, ["item_id", "item_at"])
    slots = slots.where(~(F.col("doc_value").startswith(_MAYBE) & (F.col("doc_value") == F.col("item_value"))))
    for side in ("doc_value", "item_value"):
        slots = slots.withColumn(side, F.when(F.col(side).startswith(_MAYBE), F.concat(F.lit(_AS_NAME), F.substring_index(side, _CLOSE, -1))).otherwise(F.col(side)))
    slots = slots.withColumn("diagonal", F.col("at") - F.col("item_at"))
    votes = slots.groupBy("doc_id", "item_id", "diagonal", "item_value", "doc_value").count()
    best = votes.groupBy("doc_id", "item_id", "diagonal", "item_value").agg(
        F.max("count").alias("_most"), F.sum("count").alias("_all"), F.sum(F.when(F.col("item_value") != F.col("doc_value"), F.col("count")).otherwise(0)).alias("_changed")
    )
    agreed = best.groupBy("doc_id", "item_id").agg(F.sum("_most").alias("_most"), F.sum("_all").alias("n_slots"), F.sum("_changed").alias("changed_slots"))
    out = covered.join(agreed, ["doc_id", "item_id"], "left")
    consistency = F.coalesce(F.col("_most") / F.col("n_slots"), F.lit(1.0))
    out = out.select("doc_id", "item_id", "coverage", consistency.alias("slot_consistency"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("changed_slots", F.lit(0)).alias("changed_slots"))
    return out.where(F.col("slot_consistency") >= threshold)


def clean(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, broadcast_windows: int = 1_000_000, broadcast_ids: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` that hold no item, with their columns, whatever their names; where ids are null or repeated, each row is judged by itself."""
    rows, back = aside(docs, id_col, text_col)
    rows, _ = told_apart(rows, id_col, "_row")
    known, _ = told_apart(items.select(F.col(item_id_col).alias("_own_item"), F.col(item_text_col).alias("_item_text")), "_own_item", "_item")
    found = _holders(rows.select(F.col("_row").alias("doc_id"), F.col(text_col).alias("_text")), known.select(F.col("_item").alias("item_id"), "_item_text"), threshold, broadcast_windows, broadcast_ids)
    gone = if_small(found.select(F.col("doc_id").alias("_row")).distinct(), broadcast_ids)
    return back(rows.join(gone, "_row", "left_anti"))
