"""Quality classifier with supervised subword embeddings.

A text is the average of the vectors of its hashed features: words, word
pairs (an immediate repeat is one shared feature) and character n-grams over
UTF-8 bytes. A softmax over two classes reads the average. Vectors and output
weights are trained by numpy stochastic gradient descent on a bounded sample
of labelled rows: at most `rows` of them, lowest hash of the id first. Scores
cover every whole text.

As the output is linear in the average, each feature's share of the logit is
computed once and texts are scored by one table lookup for each feature.

Null and empty texts have no features and get the score of the bias. Without
labelled rows each score is 0.5. Null labels are not learned from; of repeated
labels of an id the lowest counts. Extra columns pass through unread; columns
named score or predicted are replaced. Rows whose hashes of ids tie go by id,
texts of any length are gone through whole, and an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plinth.llm.common import aside, chunks, text_bytes, with_fields
from plinth.llm.shingles import _CODE, mix, word_hashes

BITS = 18
GRAMS = (3, 4)
_REPEAT = np.uint64(0x1234567)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, offsets by row) for words, word pairs and each n-gram size."""
    shift = np.uint64(64 - BITS)
    words, by_row = word_hashes(data, offsets, lower=False)
    found = [((words >> shift).astype(np.int32), by_row)]
    if len(words):
        pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
        pairs[words[:-1] == words[1:]] = mix(np.array([_REPEAT]))[0]
        found.append(_within((pairs >> shift).astype(np.int32), by_row, 2))
    code = _CODE[data]
    for n in GRAMS:
        if len(data) >= n:
            rolled = code[: len(data) - n + 1].copy()
            factor = 0x9E3779B97F4A7C15
            for j in range(1, n):
                rolled += code[j : len(data) - n + 1 + j] * np.uint64(factor)
                factor = factor * 0x9E3779B97F4A7C15 % 2**64
            rolled ^= rolled >> np.uint64(32)
            rolled *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
            found.append(_within((rolled >> shift).astype(np.int32), offsets, n))
    return found


def _within(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `width` items that lie in one row, from windows over the concatenation."""
    keep = np.ones(len(values), bool)
    for back in range(1, width):
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < len(values))]] = False
    made = np.concatenate(([0], np.cumsum(keep)))
    ends = np.minimum(offsets, len(values))
    return values[keep], made[ends]


@dataclass
class Model:
    shares: np.ndarray  # of the logit, by bucket
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        out = np.zeros(len(offsets) - 1)
        old = np.seterr(over="ignore")
        for i, j in chunks(offsets):
            part = offsets[i : j + 1]
            total, count = np.zeros(j - i), np.zeros(j - i)
            for buckets, at in features(data[part[0] : part[-1]], part - part[0]):
                running = np.concatenate(([0.0], np.cumsum(self.shares[buckets], dtype=np.float64)))
                total += running[at[1:]] - running[at[:-1]]
                count += np.diff(at)
            out[i:j] = total / np.maximum(count, 1) + self.bias
        np.seterr(**old)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(texts: pa.Array, labels: np.ndarray, width: int = 16, epochs: int = 5, rate: float = 4.0, seed: int = 0) -> Model:
    """Stochastic gradient descent, one row at a time, with a linearly falling rate."""
    if not len(labels):
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    rng = np.random.RandomState(seed)
    data, offsets = text_bytes(texts)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    old = np.seterr(over="ignore")
    for i, j in chunks(offsets):
        part = offsets[i : j + 1]
        found = features(data[part[0] : part[-1]], part - part[0])
        made = []
        for k in range(j - i):
            own = np.concatenate([b[at[k] : at[k + 1]] for b, at in found])
            buckets, count = np.unique(own, return_counts=True)
            made.append((buckets, (count / max(1, len(own))).astype(np.float32)))
        # One block of memory for a chunk's rows, which goes back to the system whole.
        ends = np.cumsum([0, *[len(b) for b, _ in made]])
        all_buckets, all_weights = (np.concatenate([x[n] for x in made]) for n in (0, 1))
        rows += [(all_buckets[a:b], all_weights[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    np.seterr(**old)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << BITS, width)).astype(np.float32)
    output, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            now = rate * (1 - step / steps)
            step += 1
            buckets, weight = rows[r]
            hidden = weight @ vectors[buckets] if len(buckets) else np.zeros(width, np.float32)
            logits = hidden @ output + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[labels[r]] -= 1
            back = output @ wrong
            output -= now * 0.1 * np.outer(hidden, wrong)
            bias -= now * 0.01 * wrong
            if len(buckets):
                # Rows differ in length by far; scaling by the weights' norm gives each the same say.
                scale = now / float(weight @ weight + 1e-3)
                vectors[buckets] -= np.float32(min(scale, 50.0 * now)) * weight[:, None] * back[None, :]
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of at most `rows` labelled rows; the caller leaves out held-out rows of `labels`."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    # `rows` bounds both the broadcast and what the driver gathers.
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    got = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(sample), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            table = pa.Table.from_batches(parts).sort_by("_id")
            model = train(table["_text"].combine_chunks(), table["_label"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([model.shares.tobytes()], pa.binary()), pa.array([model.bias])], names=["shares", "bias"])

    # One task gets the bounded sample; the driver gets 2**BITS floats.
    fitted = got.select("_id", "_text", "_label").repartition(1).mapInArrow(run, "shares binary, bias double").collect()
    return Model(np.frombuffer(fitted[0].shares, np.float32), fitted[0].bias) if fitted else train(pa.array([], pa.string()), np.zeros(0, np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """`docs` plus score and predicted (1 if score >= least)."""
    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*columns)
    at = columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(at)))], names=[*columns, "score"])

    out = rows.mapInArrow(run, with_fields(rows, score=DoubleType()))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their columns, whatever their names."""
    rows, back = aside(docs, "doc_id", "text")
    return back(score(rows, fit(rows, labels, **options)).where("predicted = 1"))
