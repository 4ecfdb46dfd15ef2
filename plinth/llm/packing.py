"""Packing documents into sequences by lexical retrieval.

Documents become token ids plus an end id. Whole windows of a long document are
sequences of their own; its tail, shorter than a window, is packed. Each seed
tail asks a BM25 inverted index for unused neighbours, which fill its window in
the order of their scores: those that fit go in whole, then the best that does
not is cut where the window ends, and its rest is the next seed. Where no unused
neighbour shares a term with the seed, the next unused tail follows. So windows
are full; what is left of a shard at the end is cut into powers of two.

The index is sharded: tails with the same weightiest term go together, terms
with few tokens share a shard of about `shard_tokens` and terms with more are
dealt by a hash over several, so a group of near copies is never one task. A
shard is indexed and packed in one task of bounded size, with the statistics of
all tails; index terms are token ids, so these are one row for each id of the
vocabulary at most.

Texts are encoded in stretches cut at blanks, line ends and tabs, which the
tokenizer drops, so memory is bounded for texts of any length (but for one word
without any of them). Null and empty texts are the end id alone. Null and
repeated ids and repeated rows are rows like any other. An empty table gives an
empty result. Columns other than id and text are not carried.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plinth.llm.common import write_table

#: Characters of a text that are split into words at a time, and words kept with their ids.
STRETCH, KNOWN_WORDS = 1 << 18, 600_000
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Sequences that one window can be cut into are told apart by this factor.
SPLITS = 64

BLANK, WORD = re.compile(r"[ \t\n\r]"), re.compile(r"[^ \t\n\r]+")
#: Separators that str.split() takes for blanks and tokenizers do not.
CONTROL = re.compile("[\x1c-\x1f]")

#: Letters that have one lower-case letter each and that normalisation leaves alone.
_L = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Other characters need the whole tokenizer (marks join with letters before them), as do special tokens.
ODD, SPECIAL = re.compile(f"[^\x00-\x1b -~{_L}]"), "<|"
#: What a `folds` tokenizer cuts from runs of letters in plain text: contractions, digits and runs of signs.
SIGNS = f"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\t-\\r {_L}0-9]+"


class Runs(dict):
    """Ids (as bytes) of lower-case runs, from the tokenizer's model when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.model, spelt = tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # The letter that stands for each byte of plain text, in whole words of one and two bytes.
        self.letters = {b: z for c in (*range(0x80), *range(0xC0, 0x180)) for b, z in zip(chr(c).encode(), spelt(chr(c))[0][0])}

    def __missing__(self, run: str) -> bytes:
        signs = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(signs)]
        self[run] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found


class Words(dict):
    """Ids (as bytes) of words between blanks that need the whole tokenizer."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        self[word] = found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return found


def folds(tokenizer) -> bool:
    """Whether a tokenizer composes, lower-cases and then splits contractions, letters, digits and signs into byte-level words."""
    parts = json.loads(tokenizer.to_str())
    split = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
    cuts = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    special = all(t["content"].startswith("<|") for t in parts["added_tokens"])
    by = [c.get("pattern", {}).get("Regex") for c in cuts]
    return special and steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and by[0] == split and not cuts[1]["use_regex"]


class Encoder:
    """Texts to ids (uint32) by a tokenizers file whose ids do not hang on what stands across a blank.

    Where the tokenizer folds, plain stretches are lower-cased, cut and numbered by Arrow kernels, so that Python sees
    each different run of a batch once. Words of other stretches (and of other tokenizers) go to the tokenizer, once each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.words, self.runs = Words(tokenizer), Runs(tokenizer) if folds(tokenizer) else None

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        stretches, owners, odd = [], [], []
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = BLANK.search(text, at + STRETCH) if at + STRETCH < len(text) else None
                end = end.start() if end else len(text)
                stretch = text[at:end]
                odd.append(self.runs is None or SPECIAL in stretch or ODD.search(stretch) is not None)
                stretches.append(stretch)
                owners.append(k)
                at = end
        plain = iter(self.by_runs([s for s, o in zip(stretches, odd) if not o]))
        for stretch, k, o in zip(stretches, owners, odd):
            parts[k].append(self.by_words(stretch) if o else next(plain))
        for held in (self.words, self.runs):
            if held is not None and len(held) > KNOWN_WORDS:
                held.clear()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, "<u4") for p in parts]

    def by_words(self, stretch: str) -> np.ndarray:
        words = WORD.findall(stretch) if CONTROL.search(stretch) else stretch.split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")

    def by_runs(self, stretches: list[str]) -> list[np.ndarray]:
        if not stretches:
            return []
        apart = pc.replace_substring_regex(pc.utf8_lower(pa.array(stretches, pa.large_string())), SIGNS, " \\0 ")
        lists = pc.ascii_split_whitespace(apart)
        numbered = lists.flatten().dictionary_encode()
        found = [self.runs[run] if run else b"" for run in numbered.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        at = numbered.indices.to_numpy()
        ends = np.cumsum(sizes[at])
        out = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - sizes[at]), sizes[at])]
        bounds = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a worker, which keeps the runs and words it has seen."""
    return Encoder(path)


def in_batches(batches: Iterator[pa.RecordBatch], encode: Encoder, most: int = 1 << 23) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    """Owner and ids of each text; texts are encoded together up to about `most` characters."""
    owners, held, size = [], [], 0
    for batch in batches:
        for owner, text in zip(batch["_id"], batch["_text"]):
            owners.append(owner)
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size > most:
                yield from zip(owners, encode(held))
                owners, held, size = [], [], 0
    yield from zip(owners, encode(held))


def topic(terms: np.ndarray, counts: np.ndarray, end_id: int) -> int:
    """The term that weighs most in a tail, -1 without any: its count times the logarithm of its id, as ids of merged vocabularies rise with rarity."""
    weight = np.where(terms == end_id, 0.0, counts * np.log1p(terms))
    return int(terms[np.argmax(weight)]) if len(terms) and weight.max() > 0 else -1


_PIECE = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("at", pa.int64()), ("topic", pa.int64()), ("held", pa.binary())])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows and tails of all documents: id, start, length, doc_tokens, ids (little-endian uint32), `at`, unique, and a tail's topic.

    The last row of each partition is no piece: `held` has the terms of its tails (uint32) and then their numbers of tails (uint64).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = encoder(tokenizer), TaskContext.get().partitionId() << 33
        end, tails = np.array([end_id], "<u4"), np.zeros(1 << 16, np.int64)
        found: list[list] = [[] for _ in range(8)]
        held = 0

        def rows(found: list[list]) -> pa.RecordBatch:
            arrays = [pa.array(c, f.type) for c, f in zip(found, [pa.field("_id", kind), *_PIECE])]
            return pa.RecordBatch.from_arrays(arrays, names=["_id", *_PIECE.names])

        for owner, ids in in_batches(batches, encode):
            ids = np.concatenate([ids, end])
            for start in range(0, len(ids), window):
                piece, about = ids[start : start + window], None
                if len(piece) < window:
                    terms, counts = np.unique(piece, return_counts=True)
                    if terms[-1] >= len(tails):
                        tails = np.concatenate([tails, np.zeros(int(terms[-1]) + 1, np.int64)])
                    tails[terms] += 1
                    about = topic(terms, counts, end_id)
                for column, value in zip(found, (owner, start, len(piece), len(ids), piece.tobytes(), at, about, None)):
                    column.append(value)
                at += 1
                held += len(piece)
                if held > 1 << 20:
                    yield rows(found)
                    found, held = [[] for _ in range(8)], 0
        if found[0]:
            yield rows(found)
        terms = np.flatnonzero(tails)
        if len(terms):
            sums = terms.astype("<u4").tobytes() + tails[terms].astype("<u8").tobytes()
            yield rows([[None]] * 7 + [[sums]])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = to_arrow_type(rows.schema["_id"].dataType)
    kinds = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("ids", T.BinaryType()), ("at", T.LongType()), ("topic", T.LongType()), ("held", T.BinaryType())]
    owner = T.StructField("_id", rows.schema["_id"].dataType)
    return rows.mapInArrow(run, T.StructType([owner, *[T.StructField(n, k) for n, k in kinds]]))


def document_frequencies(written: DataFrame) -> DataFrame:
    """term, n: tails that hold a term, from the sums of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums in batch["held"].to_pylist():
                n = len(sums) // 12
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(sums, "<u4", n).astype(np.int64)), pa.array(np.frombuffer(sums, "<u8", n, 4 * n).astype(np.int64))], names=["term", "n"])

    return written.where("held is not null").select("held").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def weights_of(frequencies: dict[int, int], n: int) -> np.ndarray:
    """BM25's idf by term; terms that no tail holds are 0."""
    out = np.zeros(max(frequencies, default=0) + 1)
    terms = np.fromiter(frequencies, np.int64, len(frequencies))
    df = np.fromiter(frequencies.values(), np.int64, len(frequencies))
    out[terms] = np.log1p((n - df + 0.5) / (df + 0.5))
    return out


def shards_of(tokens: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(topic, first shard, shards): topics in order share a shard up to `most` tokens, larger ones get several."""
    out, shard, held = [], 0, 0
    for topic in sorted(tokens):
        n = tokens[topic]
        if held and held + n > most:
            shard, held = shard + 1, 0
        parts = -(-n // most)
        out.append((topic, shard, parts))
        held += n
        if parts > 1:
            shard, held = shard + parts, 0
    return out


class Index:
    """BM25 postings of a shard's tails, by term, with their whole weights."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, end_id: int):
        self.n, lengths = len(tails), np.array([len(t) for t in tails], np.int64)
        ids = np.concatenate(tails).astype(np.int64) if tails else np.zeros(0, np.int64)
        docs = np.repeat(np.arange(self.n), lengths)[ids != end_id]
        pairs, counts = np.unique(ids[ids != end_id] * max(self.n, 1) + docs, return_counts=True)
        terms, self.doc = np.divmod(pairs, max(self.n, 1))
        self.weight = idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[self.doc] / mean))
        _, first, row = np.unique(terms, return_index=True, return_inverse=True)
        self.bounds = np.append(first, len(terms))
        by_doc = np.argsort(self.doc, kind="stable")
        self.rows, self.ends = row[by_doc], np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))

    def scores(self, k: int) -> np.ndarray:
        """BM25 of all tails for the terms of tail k."""
        rows = self.rows[self.ends[k] : self.ends[k + 1]]
        starts, sizes = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill(lengths: list[int], score: Callable[[int], np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, start within the tail, length), each full but the last.

    A seed's window takes its unused neighbours in the order of their scores (ties: earlier tails): those that fit
    whole, then a part of the best that does not; after those that share a term, unused tails in order.
    """
    n, out = len(lengths), []
    used = np.zeros(n, bool)
    sizes = np.array(lengths, np.int64)
    seed, start, first = None, 0, 0
    while True:
        while first < n and used[first]:
            first += 1
        if seed is None:
            if first == n:
                return out
            seed, start = first, 0
            used[first] = True
        window_of = [(seed, start, int(sizes[seed]) - start)]
        room, asked = window - window_of[0][2], seed
        seed = None
        if room and not used.all():
            scores = score(asked)
            near = np.flatnonzero((scores > 0) & ~used)
            near = near[np.argsort(-scores[near], kind="stable")]
            passed = []
            for k in near.tolist():
                if not room:
                    break
                if sizes[k] <= room:
                    window_of.append((k, 0, int(sizes[k])))
                    used[k] = True
                    room -= int(sizes[k])
                else:
                    passed.append(k)
            following = first
            while room:
                if passed:
                    k, passed = passed[0], []
                else:
                    while following < n and used[following]:
                        following += 1
                    if following == n:
                        break
                    k = following
                used[k] = True
                part = min(room, int(sizes[k]))
                window_of.append((k, 0, part))
                room -= part
                if part < sizes[k]:
                    seed, start = k, part
        out.append(window_of)


def powers(length: int) -> list[int]:
    """A length as falling powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def split_last(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two."""
    out, rest = [], list(sequence)
    for size in powers(sum(p[2] for p in sequence)):
        part = []
        while size:
            k, start, length = rest.pop(0)
            take = min(size, length)
            part.append((k, start, take))
            size -= take
            if take < length:
                rest.insert(0, (k, start + take, length - take))
        out.append(part)
    return out


_OUT = [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]


def _packed(tails: DataFrame, idf: np.ndarray, mean: float, end_id: int, window: int) -> DataFrame:
    """Each shard packed in a task."""
    shared = tails.sparkSession.sparkContext.broadcast(idf)  # one double for each id of the vocabulary
    schema = T.StructType([tails.schema["_id"], *_OUT, T.StructField("ids", T.BinaryType())])

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.take(np.argsort(shard["at"].to_numpy(), kind="stable"))
        ids = [np.frombuffer(v, "<u4") for v in shard["ids"].to_pylist()]
        index = Index(ids, shared.value, mean, end_id)
        sequences = fill([len(i) for i in ids], index.scores, window)
        if sequences and sum(p[2] for p in sequences[-1]) < window:
            sequences[-1:] = split_last(sequences[-1])
        at, base, total = shard["at"].to_numpy(), shard["start"].to_numpy(), shard["doc_tokens"].to_numpy()
        took: dict[int, int] = {}
        found: list[list] = [[] for _ in range(7)]
        for sequence in sequences:
            seed, offset = sequence[0][0], 0
            name = int(at[seed]) * SPLITS + took.get(seed, 0)
            took[seed] = took.get(seed, 0) + 1
            for k, start, length in sequence:
                row = (k, int(base[k]) + start, length, int(total[k]), name, offset, ids[k][start : start + length].tobytes())
                for column, value in zip(found, row):
                    column.append(value)
                offset += length
        own = shard["_id"].combine_chunks().take(pa.array(found[0], pa.int64()))
        longs = [pa.array(c, pa.int64()) for c in found[1:6]]
        return pa.table([own, *longs, pa.array(found[6], pa.binary())], names=[f.name for f in schema.fields])

    return tails.groupBy("shard").applyInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, doc_tokens, sequence_id, offset and ids (little-endian uint32).

    The token table stays in the shared folder until the driver ends.
    """
    written, _ = write_table(pieces(docs, tokenizer, end_id, window, id_col, text_col), "tokens")
    whole = written.where(F.col("length") == window)
    tails = written.where(F.col("length") < window).drop("held")
    n, total = tails.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    frequencies = {r["term"]: r["n"] for r in document_frequencies(written).collect()}  # one row for each id of the vocabulary at most
    idf = weights_of(frequencies, n)
    sums = tails.groupBy("topic").agg(F.sum("length").alias("n")).collect()  # likewise, and one for none
    plan = shards_of({r["topic"]: r["n"] for r in sums}, shard_tokens)
    places = docs.sparkSession.createDataFrame(plan, "topic long, first long, parts long")
    dealt = tails.join(F.broadcast(places), "topic").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("at"), F.col("parts")))
    packed = _packed(dealt.drop("topic", "first", "parts"), idf, total / n if n else 1.0, end_id, window)
    alone = whole.select("_id", "start", "length", "doc_tokens", (F.col("at") * SPLITS).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    return alone.unionByName(packed).withColumnRenamed("_id", id_col)
