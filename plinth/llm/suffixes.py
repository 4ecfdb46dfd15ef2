"""Removal of long repeated passages by a hash-compared suffix sort.

A byte goes when a string of `length` bytes that covers it also starts
somewhere else in the table; overlapping occurrences count, and strings never
cross documents.

1. Each stretch of `length` bytes has one anchor: the start of its seed
   (`seed` bytes) with the least hash, the last one on ties. The choice hangs
   on the bytes alone, so equal stretches have equal anchors at one offset, and
   comparing places with equal seeds finds every repeat.
2. A place is an anchor with its context: as far to the left and right as
   stretches with this anchor reach. Places with equal seed and equal context
   are repeats over the whole context. Contexts are compared by a 128-bit
   BLAKE2 digest of all their bytes, which, other than a polynomial hash, no
   structure of the text can make collide. Only seeds that also have other
   places go on, one place for each context.
3. The places of a seed are sorted by their suffixes from the anchor, and by
   their reversed prefixes, by mergesort. Two suffixes are compared by binary
   search for their common extension over prefix polynomial hashes, and the
   extension is checked on the bytes. Longest common extensions of neighbours
   are the only offsets at which a repeated stretch can begin first or last, so
   the stretches at these offsets are compared, again with a check of the
   bytes; each place's outermost repeated stretches bound what goes.

A seed with more than `most_contexts` different contexts is not sorted in one
task: each of its stretches is dealt by two polynomial hashes of unrelated
bases and byte codes, and equal ones are repeats.

`repeated_words` finds passages of at least `words` words that stand elsewhere
too, by the same steps over 32-bit hashes of the words (A-Z lower-cased), so
that spaces and line breaks do not matter and a passage need not have `length`
bytes.

Null texts are empty; texts shorter than `length` lose nothing, and texts of
any length are gone through in windows of bounded size. Where ids are null or
repeated, each row is a document of its own. An empty table gives an empty
result. Only id and text are read; other columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.llm.common import chunks, cut, if_small, remove_table, text_bytes, told_apart, write_table
from plinth.llm.shingles import _BASE, _CODE, mix, powers, word_hashes

LENGTH, SEED, WORDS, SEED_WORDS = 400, 50, 50, 8
#: Bytes of a window of text, and bits that hold a place in one.
WINDOW = 1 << 18
_PLACE_BITS = np.uint64(21)
_SECOND = np.random.RandomState(11).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
#: (code of each byte, base) of the two polynomial hashes.
_FIRST_HASH, _SECOND_HASH = (_CODE, _BASE), (_SECOND, 0xD1342543DE82EF95)
#: What is sent to each executor at most.
BROADCAST_BYTES = 32 << 20


def prefix_hashes(data: np.ndarray, kind: tuple[np.ndarray, int] = _FIRST_HASH) -> np.ndarray:
    """h[i] of the first i bytes; `span_hash` reads any span from it."""
    code, base = kind
    up, _ = powers(len(data) + 1, base)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    _, down = powers(len(prefix), base)
    return (prefix[end] - prefix[start]) * down[start]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima in blocks."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(behind[: n - width + 1], ahead[width - 1 :])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Positions of anchors, their first and last stretch starts, and the prefix hashes."""
    prefix = prefix_hashes(data)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, prefix
    starts = np.arange(len(data) - seed + 1)
    seeds = mix(span_hash(prefix, starts, starts + seed))
    # The last of equal seeds is least: the place counts down in the low bits.
    marked = (seeds >> _PLACE_BITS << _PLACE_BITS) | (np.uint64((1 << int(_PLACE_BITS)) - 1) - starts.astype(np.uint64))
    least = sliding_least(marked, length - seed + 1)
    at = (np.uint64((1 << int(_PLACE_BITS)) - 1) - (least & np.uint64((1 << int(_PLACE_BITS)) - 1))).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(at)), side="right") - 1
    inside = np.arange(len(at)) + length <= offsets[row + 1]
    starts = np.flatnonzero(inside)
    at = at[starts]
    if not len(at):
        return empty, empty, empty, prefix
    # Anchors do not fall back from one stretch to the next, so equal ones are neighbours.
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], starts[first], starts[last], prefix


def parts_of(offsets: np.ndarray, length: int, most: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first row, begin in the buffer, offsets of rows from there, begin in the first row) of parts of about `most` bytes.

    A longer row comes in several parts, each stretch of `length` bytes in one of them.
    """
    for i, j in chunks(offsets, most):
        size = int(offsets[j] - offsets[i])
        if j - i > 1 or size <= 2 * most:
            yield i, int(offsets[i]), offsets[i : j + 1] - offsets[i], 0
            continue
        for at in range(0, size - length + 1, most):
            yield i, int(offsets[i]) + at, np.array([0, min(size - at, most + length - 1)], np.int64), at


def _places(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """_id, seed hash, context digest, begin, at, end of each place."""
        np.seterr(over="ignore")
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, begin, own, shift in parts_of(offsets, length):
                part = data[begin : begin + int(own[-1])]
                at, first, last, prefix = anchors(part, own, length, seed)
                if not len(at):
                    continue
                end = last + length
                row = np.searchsorted(own, at, side="right") - 1
                raw = part.tobytes()
                digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist())])
                digest = np.frombuffer(digests, np.uint64).reshape(-1, 2)
                columns = [
                    pa.array(ids[i : i + len(own) - 1][row]),
                    pa.array(span_hash(prefix, at, at + seed).view(np.int64)),
                    pa.array((digest[:, 0] ^ mix((at - first).astype(np.uint64))).view(np.int64)),
                    pa.array(digest[:, 1].copy().view(np.int64)),
                    *[pa.array((x - own[row] + shift).astype(np.int32)) for x in (first, at, end)],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "seed", "c1", "c2", "first", "at", "end"])

    return run


class Suffixes:
    """Suffixes of a buffer that end at given places, compared by hashed common extensions."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.data, self.start, self.end = data, start, end
        self.prefix = prefix_hashes(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b share: binary search over prefix hashes, then a check of the bytes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.end[a] - self.start[a], self.end[b] - self.start[b])
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            same = span_hash(self.prefix, self.start[a], self.start[a] + middle) == span_hash(self.prefix, self.start[b], self.start[b] + middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`extension`, cut at the first byte that differs should two hashes have collided."""
        found = self.extension(a, b)
        if len(found) and (most := int(found.max())):
            for i in range(0, len(a), 4096):
                n = found[i : i + 4096]
                step = np.arange(most)[None, :]
                left = self.data[np.minimum(self.start[a[i : i + 4096]][:, None] + step, len(self.data) - 1)]
                right = self.data[np.minimum(self.start[b[i : i + 4096]][:, None] + step, len(self.data) - 1)]
                differ = (left != right) & (step < n[:, None])
                found[i : i + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        return found

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; equal ones by index."""
        n = self.extension(a, b)
        left, right = self.end[a] - self.start[a] == n, self.end[b] - self.start[b] == n
        x = np.where(left, -1, self.data[np.minimum(self.start[a] + n, len(self.data) - 1)].astype(np.int64))
        y = np.where(right, -1, self.data[np.minimum(self.start[b] + n, len(self.data) - 1)].astype(np.int64))
        return (x < y) | ((x == y) & (a < b))

    def sort(self, groups: np.ndarray) -> np.ndarray:
        """Mergesort of all suffixes within groups (ascending labels); all merges of a level go at once."""
        order = np.arange(len(self.start))
        n = len(order)
        begins = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.zeros(0, np.int64)
        bound = np.concatenate((begins, [n]))
        own = np.searchsorted(bound, order, side="right") - 1
        place = order - bound[own]
        size, largest = 1, int(np.diff(bound).max(initial=0))
        while size < largest:
            # The run of each item and its sister run, within the group.
            run = place // (2 * size)
            base = bound[own] + run * 2 * size
            middle = np.minimum(base + size, bound[own + 1])
            top = np.minimum(base + 2 * size, bound[own + 1])
            is_left = np.arange(n) < middle
            low, high = np.where(is_left, middle, base), np.where(is_left, top, middle)
            begin = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                probe = (low[open_] + high[open_]) // 2
                goes_first = self.before(order[probe], order[open_])
                low[open_] = np.where(goes_first, probe + 1, low[open_])
                high[open_] = np.where(goes_first, high[open_], probe)
            rank = np.arange(n) - np.where(is_left, base, middle) + (low - begin)
            merged = np.empty_like(order)
            merged[base + rank] = order
            order = merged
            size *= 2
        return order


def repeats(data: np.ndarray, start: np.ndarray, at: np.ndarray, end: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each place, offsets from its anchor of the first and last repeated stretch (1, 0: none).

    Places lie in `data` at start..end with their anchor; groups are ascending.
    """
    n = len(at)
    left, right = at - start, end - at
    forward = Suffixes(data, at, end)
    mirrored = data[::-1]
    backward = Suffixes(mirrored, len(data) - at, len(data) - start)
    critical_group, critical = [], []
    for suffixes, is_left in ((forward, False), (backward, True)):
        order = suffixes.sort(groups)
        a, b = order[:-1], order[1:]
        same = groups[a] == groups[b]
        a, b = a[same], b[same]
        shared = suffixes.verified(a, b)
        critical_group.append(groups[a])
        critical.append(shared if is_left else length - shared)
    # Offsets (bytes to the left of the anchor) at which a repeated stretch can be first or last.
    pairs = np.unique(np.stack((np.concatenate(critical_group), np.concatenate(critical))), axis=1)
    begins = np.searchsorted(groups, pairs[0], side="left")
    ends = np.searchsorted(groups, pairs[0], side="right")
    first, last = np.full(n, -1, np.int64), np.full(n, length + 1, np.int64)
    count = ends - begins
    each = 1 << 20
    splits = np.searchsorted(np.cumsum(count), np.arange(each, count.sum() + each, each), side="left")
    i = 0
    for j in [*np.unique(splits + 1).tolist(), len(count)]:
        j = min(j, len(count))
        if j <= i:
            continue
        sizes = count[i:j]
        which = np.repeat(np.arange(i, j), sizes)
        member = np.repeat(begins[i:j], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        offset = pairs[1][which]
        fits = (offset <= left[member]) & (length - offset <= right[member]) & (offset >= 0)
        which, member, offset = which[fits], member[fits], offset[fits]
        begin = at[member] - offset
        hashes = mix(span_hash(forward.prefix, begin, begin + length) + mix(which.astype(np.uint64)))
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order[1:]] == hashes[order[:-1]]
        x, y = order[:-1][equal], order[1:][equal]
        good = np.ones(len(x), bool)
        for k in range(0, len(x), 4096):
            span = np.arange(length)[None, :]
            good[k : k + 4096] = (data[begin[x[k : k + 4096]][:, None] + span] == data[begin[y[k : k + 4096]][:, None] + span]).all(axis=1)
        for hit in (x[good], y[good]):
            np.maximum.at(first, member[hit], offset[hit])
            np.minimum.at(last, member[hit], offset[hit])
        i = j
    return first, last


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, seed: int = SEED, most_contexts: int = 4096, broadcast_ids: int = BROADCAST_BYTES // 32, encode: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """_id, begin, stop (bytes) over `texts` (_id, _text; ids tell rows apart): every repeated stretch is covered; spans may overlap.

    `encode` turns the texts into the bytes to be compared.
    """
    long_texts = encode(texts).where(F.octet_length("_text") >= length)
    kinds = "_id long, seed long, c1 long, c2 long, first int, at int, end int"
    found, folder = write_table(long_texts.mapInArrow(_places(length, seed), kinds), "places")
    # Seeds found once, most of them, go first, by a count alone.
    # Kept apart from the join, so that a hot seed's places can be split over tasks.
    again = cut(found.groupBy("seed").agg(F.count("*").alias("_n")).where("_n > 1").select("seed"))
    places = cut(found.join(again, "seed"))
    remove_table(texts.sparkSession, folder)
    contexts = places.groupBy("seed", "c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("_id", "at", "first", "end")).alias("one"))
    per_seed = contexts.groupBy("seed").agg(F.count("*").alias("contexts"))
    contexts = cut(contexts.join(per_seed, "seed"))
    copied = contexts.where("copies > 1").select("seed", "c1", "c2")
    whole = places.join(copied, ["seed", "c1", "c2"]).select("_id", F.col("first").alias("begin"), F.col("end").alias("stop"))
    # Seeds with places in different contexts; those whose every context is copied are settled already.
    open_seeds = contexts.groupBy("seed").agg(F.min("copies").alias("_least"), F.count("*").alias("_n")).where("_n > 1 and _least = 1")
    mixed = contexts.join(open_seeds.select("seed"), "seed", "left_semi").select("seed", F.col("one._id").alias("_id"), "one.at", "one.first", "one.end", "contexts")
    mixed = cut(mixed)
    is_hot = F.col("contexts") > most_contexts

    def carry(part: DataFrame) -> DataFrame:
        """The texts that have places in `part`, with these places."""
        wanted = part.groupBy("_id").agg(F.collect_list(F.struct("seed", "first", "at", "end")).alias("places"))
        named = if_small(part.select("_id").distinct(), broadcast_ids)
        return encode(texts.join(named, "_id", "left_semi")).join(wanted, "_id").select("_id", "_text", "places")

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for own, begin, found in zip(batch.column(0).to_pylist(), offsets.tolist(), batch.column(2).to_pylist()):
                out += [(own, p["seed"], p["first"], p["at"], p["end"], data[begin + p["first"] : begin + p["end"]].tobytes()) for p in found]
            for i in range(0, len(out), 5000):
                part = list(zip(*out[i : i + 5000]))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(part, kinds)], names=["_id", "seed", "first", "at", "end", "context"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for own, begin, found in zip(batch.column(0).to_pylist(), offsets.tolist(), batch.column(2).to_pylist()):
                for p in found:
                    part = data[begin + p["first"] : begin + p["end"]]
                    at = np.arange(len(part) - length + 1)
                    pair = [pa.array(mix(span_hash(prefix_hashes(part, kind), at, at + length, kind[1])).view(np.int64)) for kind in (_FIRST_HASH, _SECOND_HASH)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own)), pa.array((at + p["first"]).astype(np.int32)), *pair], names=["_id", "begin", "h1", "h2"])

    context = carry(mixed.where(~is_hot)).mapInArrow(excerpts, "_id long, seed long, first int, at int, end int, context binary")
    parts = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2)
    dealt = context.repartition(parts, "seed").sortWithinPartitions("seed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for whole_groups in _by_seed(batches):
            lengths = np.diff(np.frombuffer(whole_groups.column(5).cast(pa.large_binary()).buffers()[1], np.int64)[: whole_groups.num_rows + 1])
            data = np.frombuffer(b"".join(whole_groups.column(5).to_pylist()), np.uint8)
            begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            own_first, own_at = whole_groups.column(2).to_numpy().astype(np.int64), whole_groups.column(3).to_numpy().astype(np.int64)
            groups = np.cumsum(np.concatenate(([0], np.diff(whole_groups.column(1).to_numpy()) != 0)))
            first, last = repeats(data, begin, begin + own_at - own_first, begin + lengths, groups, length)
            hit = np.flatnonzero(first >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(whole_groups.column(0).to_numpy()[hit]), pa.array((own_at - first)[hit].astype(np.int32)), pa.array((own_at - last + length)[hit].astype(np.int32))], names=["_id", "begin", "stop"])

    settled = dealt.mapInArrow(compare, "_id long, begin int, stop int")
    spans = whole.unionByName(settled)
    if mixed.where(is_hot).isEmpty():
        return spans
    dealt_stretches = cut(carry(mixed.where(is_hot)).mapInArrow(stretches, "_id long, begin int, h1 long, h2 long"))
    again = dealt_stretches.groupBy("h1", "h2").count().where("count > 1")
    hot = dealt_stretches.join(again, ["h1", "h2"], "left_semi").select("_id", "begin", (F.col("begin") + length).alias("stop"))
    return spans.unionByName(hot)


def _by_seed(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes that never part the rows of a seed; rows come sorted by seed."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            seeds = whole.column(1).to_numpy()
            edge = int(np.flatnonzero(np.concatenate(([True], seeds[1:] != seeds[:-1])))[-1])
            if edge:
                yield whole.slice(0, edge)
                whole = whole.slice(edge)
            held, size = [whole], whole.nbytes
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from table.to_batches()[:1]


def _runs(spans: DataFrame) -> DataFrame:
    """_id, begin, stop of the unions of spans that overlap or touch."""
    along = Window.partitionBy("_id").orderBy("begin", "stop")
    reached = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("_opens", F.when(F.col("begin") <= reached, 0).otherwise(1))
    numbered = opens.withColumn("_run", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_id", "_run").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop")).drop("_run")


def _told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id (tells rows apart), _own (the id as it is) and _text."""
    rows = docs.select(F.col(id_col).cast("long").alias("_own"), F.col(text_col).alias("_text"))
    return told_apart(rows, "_own", "_id")[0].select("_id", "_own", "_text")


def _as_words(rows: DataFrame) -> DataFrame:
    """Texts as 32-bit hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, WINDOW):
                words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                made = (words >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([made[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["_id", "_text"])

    return rows.select("_id", "_text").mapInArrow(run, "_id long, _text binary")


def _repeated_words(rows: DataFrame, words: int, most_contexts: int) -> DataFrame:
    """_id, n_repeat_words: words in passages of at least `words` words that stand elsewhere too, where there are any."""
    spans = _runs(repeated_spans(rows.select("_id", "_text"), 4 * words, 4 * min(SEED_WORDS, words), most_contexts, encode=_as_words))
    # A span is of whole words but for chance; what is left of one after rounding inward has to be long enough.
    n = F.floor(F.col("stop") / 4) - F.ceil(F.col("begin") / 4)
    return spans.select("_id", n.alias("_n")).where(F.col("_n") >= words).groupBy("_id").agg(F.sum("_n").alias("n_repeat_words"))


def repeated_words(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = 4096) -> DataFrame:
    """`id_col` and n_repeat_words of each row."""
    rows = _told_apart(docs, id_col, text_col)
    found = _repeated_words(rows, words, most_contexts)
    return rows.select("_id", "_own").join(found, "_id", "left").select(F.col("_own").alias(id_col), F.coalesce("n_repeat_words", F.lit(0)).alias("n_repeat_words"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = 4096, words: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`id_col`, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans of each row; with `words`, also n_repeat_words of passages of so many words, which are not removed for that."""
    rows = _told_apart(docs, id_col, text_col)
    runs = _runs(repeated_spans(rows.select("_id", "_text"), length, min(SEED, length), most_contexts, broadcast_bytes // 32))
    of_doc = runs.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("spans"))
    if words:
        of_doc = of_doc.join(_repeated_words(rows, words, most_contexts), "_id", "full")
    of_doc = cut(of_doc)
    n_docs, n_runs = of_doc.agg(F.count("*"), F.coalesce(F.sum(F.size(F.coalesce("spans", F.array()))), F.lit(0))).first()
    if 64 * n_docs + 24 * n_runs <= broadcast_bytes:
        of_doc = F.broadcast(of_doc)
    more = [F.coalesce("n_repeat_words", F.lit(0)).alias("n_repeat_words")] if words else []
    joined = rows.join(of_doc, "_id", "left").select("_own", F.coalesce("_text", F.lit("")).alias("_text"), "spans", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n_removed, merged, kept = [], [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                runs = [[s["begin"], s["stop"]] for s in found or []]
                cuts = [0, *[x for r in runs for x in r], len(own)]
                kept.append(b"".join(own[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2])))
                merged.append(runs)
                n_removed.append(sum(b - a for a, b in runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array([len(r) for r in merged], pa.int64()), pa.array(kept, pa.binary()), pa.array(merged, pa.list_(pa.list_(pa.int32()))), *batch.columns[3:]],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "spans", *["n_repeat_words"][: len(batch.columns) - 3]],
            )

    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<int>>" + ", n_repeat_words long" * bool(words))
