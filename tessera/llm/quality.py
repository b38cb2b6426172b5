"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Features of a text, hashed to 2**20 places: its words (between white space, A-Z lower-cased) and pairs of neighbouring words;
and one-, two- and three-grams of the words' shapes (case, marks at the ends, digits, length class, same
as the word before). Each of the two views has the length 1; counts enter by their logarithm. Weights are learnt by FTRL-proximal with
per-coordinate rates in one pass after another over a bounded sample of labelled documents; the sample is
drawn by a hash of the id, so it is the same each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import quoted
from tessera.llm.text import LOWER, SOLID, STEP, U, Block, blocks, mix
from tessera.plans.session import ship

BITS = 20
#: Labelled documents that the model is fitted on at most.
SAMPLE = 8_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.02, 0.02

_MARK = np.zeros(256, dtype=np.uint8)
_MARK[33:48] = np.arange(1, 16)
_MARK[58:65] = np.arange(16, 23)
_MARK[91:97] = np.arange(23, 29)
_MARK[123:127] = np.arange(29, 33)
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def shapes(block: Block, begin: np.ndarray, end: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One code for each word."""
    data = block.data
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    total = lambda t: (c := np.concatenate([[0], np.cumsum(t[data])]))[end] - c[begin]
    size, upper, digit = end - begin, total(_UPPER), total(_DIGIT)
    last = _MARK[data[end - 1]].astype(np.int64)
    before = np.where(size > 1, _MARK[data[np.maximum(end - 2, 0)]], 0).astype(np.int64)
    head = _MARK[data[begin]].astype(np.int64)
    again = np.zeros(len(h), dtype=np.int64)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = 0
    case = np.where(upper == 0, 0, np.where(2 * upper > size - (last > 0) - (before > 0), 2, 1))
    length = np.searchsorted([3, 7, 12, 25], size)
    code = ((((((case * 40 + last) * 40 + before) * 40 + head) * 2 + again) * 2 + (digit > 0)) * 5 + length).astype(np.uint64)
    return mix(code * STEP[7] + U(1))


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each text's first feature (one more), places, values."""
    begin, end, h, first = block.words(SOLID)
    shape = shapes(block, begin, end, h, first)
    owner = np.repeat(np.arange(block.n, dtype=np.int64), np.diff(first))
    rows = []
    for view, size, g in ((0, 1, h), (0, 2, h), (1, 1, shape), (1, 2, shape), (1, 3, shape)):
        if len(g) < size:
            continue
        v = np.zeros(len(g) - size + 1, dtype=np.uint64)
        for j in range(size):
            v += g[j : len(g) - size + 1 + j] * STEP[j]
        v = mix(v ^ STEP[2 * size + view]) >> U(64 - BITS)
        inside = owner[: len(v)] == owner[size - 1 :]
        rows.append(((owner[: len(v)][inside] * 2 + view) << BITS) | v[inside].astype(np.int64))
    if not rows:
        return np.zeros(block.n + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    key, count = _runs(np.sort(np.concatenate(rows)))
    value = np.log1p(count)
    part = key >> BITS  # text and view
    norm = np.sqrt(np.bincount(part, weights=value * value, minlength=2 * block.n))
    value = value / norm[part]
    return np.searchsorted(part >> 1, np.arange(block.n + 1)), key & ((1 << BITS) - 1), value


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[head], np.diff(np.append(head, len(x)))


class Ftrl:
    """FTRL-proximal for logistic loss."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def step(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - s * w
        self.n[i] += g * g


def fit(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Weights; the last is the bias."""
    rows = []
    for b in blocks(texts):
        at, place, value = features(b)
        rows += [(np.append(place[at[i] : at[i + 1]], 1 << BITS), np.append(value[at[i] : at[i + 1]], 1.0), int(labels[b.first + i])) for i in range(b.n)]
    model = Ftrl()
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            model.step(*rows[k])
    return model.weights(np.arange((1 << BITS) + 1))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got).sort_by("rank").combine_chunks()
        w = fit(t.column("text").combine_chunks(), t.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["w"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, kept_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rank, y, text) of at most most labelled rows outside the fold kept out: the first ids by a hash, and one text of each.

    Null ids and labels other than 0 and 1 teach nothing; an id labelled twice takes its smaller label, and of an id with several texts
    the one of the smallest hash counts (tasks reduce these before they meet).
    """
    known = labels.select(quoted(id_col).cast("long").alias("_id"), quoted(label).cast("int").alias("y")).filter("_id is not null and y in (0, 1)")
    known = known.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % fold != kept_out) if kept_out is not None else known
    known = known.groupBy("_id").agg(F.min("y").alias("y")).withColumn("rank", F.xxhash64("_id")).orderBy("rank", "_id").limit(most)
    text = docs.select(quoted(id_col).cast("long").alias("_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    own = text.join(F.broadcast(known), "_id").groupBy("_id", "rank", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return own.select("rank", "y", F.col("t.text").alias("text"))


def held_out(id_col: str, fold: int, kept_out: int):
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % fold == kept_out, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, kept_out: int = 0, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights fitted in one task on a sample bounded by most rows; zeros where there is nothing to learn from."""
    spark = docs.sparkSession
    ship(spark)
    got = labelled(docs, labels, label, fold, kept_out, most, id_col, text_col).repartition(1).mapInArrow(_fit, "w binary").collect()
    return np.frombuffer(got[0].w, dtype=np.float32).astype(np.float64) if got else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: the chance of label 1. Null texts count as empty; an empty text's score is that of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for b in blocks(batch.column(1)):
                at, place, value = features(b)
                total = np.concatenate([[0.0], np.cumsum(w[place] * value)])
                s = 1 / (1 + np.exp(-(total[at[1:]] - total[at[:-1]] + w[-1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), pa.array(s)], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: int = 5, kept_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold). One row for each row of docs."""
    out = score(docs, train(docs, labels, "quality", fold, kept_out))
    return out.select("doc_id", held_out("doc_id", fold, kept_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
