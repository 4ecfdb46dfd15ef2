"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary (a sentencepiece model file,
whose path is a parameter, read on the driver). Each language has a probability
for each piece. A word's likelihood in a language is the sum over all its
segmentations into pieces of the product of piece probabilities, found by the
forward algorithm; a text's is the product over its words. Words are maximal
runs of letters of any length, lower-cased. A letter that no piece covers costs
a fixed small probability, alike in all languages.

Piece probabilities are learned by expectation-maximisation (forward and
backward) on word counts of each language, in one task, and smoothed. The
sample is bounded: more than half of `rows_each` rows of each language (all,
where there are no more), with the lowest hashes of their ids; runs of more
than LEARNED letters are no words and are not learned from. Prediction covers
whole texts and all words.

The score is the posterior of the predicted language under a uniform prior
with the evidence of one word averaged over SHARPNESS words at most, so that
it stays comparable between short and long texts. A null text or one without
letters is `und` with score 0; without training rows every text is. Ties go to
the first language by name. Rows of null or repeated ids are rows like others;
columns named lang_pred or score are replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType
from pyspark.sql.window import Window

from plinth.llm.common import with_fields

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LEARNED = 64
UNKNOWN = 1e-7
SHARPNESS = 50
#: Steps after which tiny values of the forward algorithm are scaled up; so many unknown letters stay above the least double.
_STEPS, _TINY = 8, 1e-100
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces that are letters, lower-cased, `▁` marking a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(x for x in found if re.fullmatch(r"▁?[^\W\d_]+|▁", x))


def _encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of code points and the lengths of words."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    matrix = np.zeros((len(words), int(size.max(initial=1))), np.uint64)
    at = np.arange(matrix.shape[1])[None, :] < size[:, None]
    matrix[at] = flat
    return matrix, size


@dataclass
class Pieces:
    """Lookup of pieces and of their beginnings by hash; hashes are checked to differ when the table is built."""

    names: list[str]
    hashes: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        known = {x[:i]: len(self.names) for x in self.names for i in range(1, len(x) + 1)}
        known.update({x: i for i, x in enumerate(self.names)})
        made = np.zeros(len(known), np.uint64)
        for i, name in enumerate(known):
            h = 0
            for c in name:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            made[i] = h
        order = np.argsort(made)
        self.hashes, self.ids = made[order], np.array(list(known.values()), np.int64)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a piece begins so, and the index of the piece that is just this, or len(names)."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return found, np.where(found, self.ids[at], len(self.names))

    def lattice(self, words: list[str]) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
        """(start, end, rows, pieces) of every piece in the words, by start; the words' lengths."""
        matrix, size = _encode(words)
        out = []
        for start in range(matrix.shape[1]):
            rows, end = np.flatnonzero(size > start), start
            rolled = np.zeros(len(rows), np.uint64)
            while len(rows):
                rolled = rolled * _BASE + matrix[rows, end] + np.uint64(1)
                end += 1
                begins, ids = self.find(rolled)
                # a single letter is always an edge, so each word has a segmentation
                known = np.ones(len(rows), bool) if end == start + 1 else ids < len(self.names)
                if known.any():
                    out.append((start, end, rows[known], ids[known]))
                begins &= size[rows] > end
                rows, rolled = rows[begins], rolled[begins]
        return out, size


def forward(edges: list[tuple[int, int, np.ndarray, np.ndarray]], size: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alpha of each word, position and language, and the logarithm of what long words' last values were divided by.

    `probability` has a last row for unknown letters.
    """
    alpha = np.zeros((len(size), int(size.max(initial=0)) + 1, probability.shape[1]))
    scale = np.zeros((len(size), probability.shape[1]))
    alpha[:, 0] = 1
    done = 0
    for start, end, rows, ids in edges:
        if start >= done + _STEPS:
            done = start
            now = alpha[:, start]
            small = (now < _TINY) & (now > 0)
            if small.any():
                alpha[:, start:] = np.where(small[:, None, :], alpha[:, start:] / _TINY, alpha[:, start:])
                scale += np.where(small, np.log(_TINY), 0.0)
        alpha[rows, end] += alpha[rows, start] * probability[ids]
    return alpha, scale


def _by_length(words: list[str], langs: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Indexes of words in groups of like length whose alphas have about `most` values."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and j - i < 8192 and (j + 1 - i) * (size[order[j]] + 1) * langs <= most:
            j += 1
        yield order[i:j]
        i = j


def log_likelihoods(words: list[str], table: Pieces, probability: np.ndarray) -> np.ndarray:
    """log p(word | language) of each word, by language."""
    out = np.zeros((len(words), probability.shape[1]))
    for own in _by_length(words, probability.shape[1]):
        edges, size = table.lattice([words[i] for i in own])
        alpha, scale = forward(edges, size, probability)
        out[own] = np.log(np.maximum(alpha[np.arange(len(size)), size], 1e-300)) + scale
    return out


def learn(words: list[str], counts: np.ndarray, table: Pieces, rounds: int = 3, smooth: float = 0.5) -> np.ndarray:
    """Piece probabilities by language from words' counts (words x languages), words of at most LEARNED letters."""
    n, langs = len(table.names), counts.shape[1]
    probability = np.full((n + 1, langs), 1.0 / n)
    probability[n] = UNKNOWN
    for _ in range(rounds):
        expected = np.zeros((n + 1, langs))
        for own in _by_length(words, langs):
            part = counts[own]
            edges, size = table.lattice([words[i] for i in own])
            alpha, _ = forward(edges, size, probability)
            beta = np.zeros_like(alpha)
            beta[np.arange(len(size)), size] = 1
            for start, end, rows, ids in reversed(edges):
                beta[rows, start] += beta[rows, end] * probability[ids]
            whole = np.maximum(alpha[np.arange(len(size)), size], 1e-300)
            for start, end, rows, ids in edges:
                share = alpha[rows, start] * probability[ids] * beta[rows, end] / whole[rows] * part[rows]
                for lang in range(langs):
                    expected[:, lang] += np.bincount(ids, share[:, lang], n + 1)
        expected = expected[:n] + smooth
        probability[:n] = expected / expected.sum(axis=0)
    return probability


def split(text: str) -> list[str]:
    """Words with a start mark."""
    return ["▁" + w for w in _WORD.findall(text.lower())]


@dataclass
class Model:
    langs: list[str]
    table: Pieces
    probability: np.ndarray

    def predict(self, texts: list[str | None], memory: Memory) -> tuple[list[str], list[float]]:
        """Language and score of each text; `memory` keeps words' likelihoods between calls."""
        words = [split(t) if t else [] for t in texts]
        words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
        size = np.array([len(w) for w in words], np.int64)
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        full = np.flatnonzero(size)
        if not self.langs or not len(full):
            return langs, scores
        rows = memory.rows([x for w in words for x in w], self)
        total = np.add.reduceat(rows, np.concatenate(([0], np.cumsum(size[full])[:-1])), axis=0)
        total *= np.minimum(1.0, SHARPNESS / size[full])[:, None]
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, k, p in zip(full.tolist(), odds.argmax(axis=1).tolist(), odds.max(axis=1).tolist()):
            langs[i], scores[i] = self.langs[k], p
        return langs, scores


class Memory:
    """Likelihoods of words seen by a task, started anew when there are `most` of them."""

    def __init__(self, most: int = 300_000) -> None:
        self.most, self.at, self.values = most, {}, None

    def rows(self, words: list[str], model: Model) -> np.ndarray:
        if len(self.at) > self.most:
            self.at, self.values = {}, None
        new = list(set(words).difference(self.at))
        if new:
            made = log_likelihoods(new, model.table, model.probability)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.values = made if self.values is None else np.concatenate((self.values, made))
        return self.values[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def sample(docs: DataFrame, rows_each: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """_lang and _text of rows with a language: the lowest hashes of ids, at most `rows_each` of each language.

    Rows are counted by steps of their hash, an eighth of a power of two each; the lowest steps that fit are taken. So
    no task ranks the rows of a language, and but for small languages the sample holds over half of `rows_each`.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(1)), 11) + 1) / float(1 << 53)
    step = F.floor(-8 * F.log2(uniform)).cast("int")
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), step.alias("_step"))
    counts = known.groupBy("_lang", "_step").agg(F.count("*").alias("_n"))  # at most 425 steps of a language
    down = Window.partitionBy("_lang").orderBy(F.desc("_step"))
    fits = counts.withColumn("_upto", F.sum("_n").over(down)).where(F.col("_upto") <= rows_each)
    least = fits.groupBy("_lang").agg(F.min("_step").alias("_least"))  # one row for each language
    return known.join(F.broadcast(least), "_lang").where("_step >= _least").select("_lang", "_text")


def fit(docs: DataFrame, rows_each: int = 600, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = 3) -> Model:
    """A model of at most `rows_each` rows of each language; the caller leaves out held-out rows."""
    word = F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}+)"), 1)).alias("word")
    chosen = sample(docs, rows_each, id_col, text_col, lang_col)
    counted = chosen.select("_lang", word).where(F.length("word") <= LEARNED).groupBy("_lang", "word").agg(F.count("*").alias("n"))
    names = pieces(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        rows = pa.Table.from_batches(parts).sort_by([("word", "ascending"), ("_lang", "ascending")]) if parts else None
        if not rows:
            return
        langs = sorted(set(rows["_lang"].to_pylist()))
        at: dict[str, int] = {}
        places = [(at.setdefault("▁" + w, len(at)), langs.index(a)) for a, w in zip(rows["_lang"].to_pylist(), rows["word"].to_pylist())]
        counts = np.zeros((len(at), len(langs)))
        np.add.at(counts, tuple(np.array(places).T), rows["n"].to_numpy())
        made = learn(list(at), counts, Pieces(names), rounds)
        yield pa.RecordBatch.from_arrays([pa.array([langs], pa.list_(pa.string())), pa.array([made.tobytes()], pa.binary())], names=["langs", "probability"])

    # One task gets the word counts of the bounded sample; the driver gets pieces x languages numbers.
    fitted = counted.repartition(1).mapInArrow(run, "langs array<string>, probability binary").collect()
    if not fitted:
        return Model([], Pieces(["▁"]), np.zeros((2, 0)))
    return Model(list(fitted[0].langs), Pieces(names), np.frombuffer(fitted[0].probability).reshape(len(names) + 1, -1))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` plus lang_pred and score; `text_col` alone is looked at."""
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*columns)
    at = columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(at).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    return rows.mapInArrow(run, with_fields(rows, lang_pred=StringType(), score=DoubleType()))
