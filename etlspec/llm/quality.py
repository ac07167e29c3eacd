"""Quality classifier: naive Bayes features under a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import column, held_out, without

BITS = 20
#: Bytes of text whose features are computed at once; arrays of that length stay in the processor's cache.
BLOCK_BYTES = 1 << 17


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 8, np.uint8)
    kinds[ord("a") : ord("z") + 1] = 1
    kinds[ord("A") : ord("Z") + 1] = 2
    kinds[ord("0") : ord("9") + 1] = 4
    kinds[128:] = 16
    return kinds


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram id), each pair once, sorted: the n-grams that each text has.

    Words are runs without ASCII white space. N-grams: words and pairs of words
    in lower case; and runs of one to three word shapes. A shape is the kinds of
    characters that a word has, its last sign, and whether it repeats the word
    before.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.cumsum(lengths) - lengths
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(space & ~before) - 1
    word = np.cumsum(~space & before) - 1
    place = (np.arange(len(data)) - starts[np.maximum(word, 0)]) & 63
    powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)
    lower = np.arange(256, dtype=np.uint64) + 1
    lower[ord("A") : ord("Z") + 1] += 32
    with np.errstate(over="ignore"):
        values = lower[data] * powers[place]
        values[space] = 0
        words = np.add.reduceat(values, starts)
        kinds = _byte_classes()[data]
        kinds[space] = 0
        last = data[ends].astype(np.uint64)
        sign = np.where(_byte_classes()[data[ends]] == 8, last, 0)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        follows = np.concatenate(([False], doc[1:] == doc[:-1]))
        repeats = follows & np.concatenate(([False], words[1:] == words[:-1]))
        shape = np.bitwise_or.reduceat(kinds, starts).astype(np.uint64) * 1024 + sign * 4 + repeats * np.uint64(2) + 1

        def runs(value: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
            h = np.full(len(value) - n + 1, salt, np.uint64) if len(value) >= n else np.zeros(0, np.uint64)
            for k in range(n):
                h = (h ^ value[k : len(value) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            whole = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
            return doc[: len(h)][whole], (h[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)

        parts = [runs(words, 1, 1), runs(words, 2, 2), runs(shape, 1, 3), runs(shape, 2, 4), runs(shape, 3, 5)]
    pairs = np.unique(np.concatenate([(d << BITS) | h.astype(np.int64) for d, h in parts]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """weights: log-count ratio times weight; ratios: squared ratios, for the length of a text's vector."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        doc, ids = features(texts)
        total = np.bincount(doc, self.weights[ids], minlength=len(texts))
        length = np.sqrt(np.bincount(doc, self.squares[ids], minlength=len(texts)))
        return total / np.maximum(length, 1e-9) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.intercept, -30, 30)))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int) -> np.ndarray:
    """Weights of the linear hinge-loss model; ``rows`` hold (ids, values) of unit length, the last weight is the bias."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, values = rows[i]
            gradient = y[i] * (values @ w[ids] + w[size]) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost[i])  # the squared length is 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ids] += step * values
                w[size] += step
                alpha[i] = new
    return w


def fit_rows(y: np.ndarray, rows: list[np.ndarray], epochs: int = 10, cost: float = 1.0) -> Model:
    """Fit on n-gram id arrays and labels 0/1. A quarter of the rows is set apart to turn margins into probabilities."""
    size = 1 << BITS
    rate = (y.sum() + 1) / (len(y) + 2)
    flat = Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    apart = np.arange(len(y)) % 4 == 3
    train = np.flatnonzero(~apart)
    if len(set(y[train].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        return flat
    counts = {k: np.bincount(np.concatenate([rows[i] for i in train if y[i] == k]), minlength=size) + 1.0 for k in (0, 1)}
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] == 1) & (counts[1] == 1)] = 0
    squares = ratio**2
    unit = [(rows[i], ratio[rows[i]] / max(np.sqrt(squares[rows[i]].sum()), 1e-9)) for i in train]
    sign = np.where(y[train] == 1, 1.0, -1.0)
    share = np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    w = dual_coordinate_descent(unit, sign, cost * 0.5 / share, size, epochs)
    weights = w[:size] * ratio
    margin = np.array([weights[r].sum() / max(np.sqrt(squares[r].sum()), 1e-9) + w[size] for r in (rows[i] for i in np.flatnonzero(apart))])
    target, a, b = y[apart].astype(float), 1.0, 0.0
    for _ in range(50):  # logistic regression on the margin by Newton's method
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((target - p) * margin).sum() - 1e-3 * a, (target - p).sum()])
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    return Model(weights, squares, float(w[size]), float(a), float(b))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y, texts = batch.column(0).to_numpy(zero_copy_only=False), [t or b"" for t in batch.column(1).to_pylist()]
        for i, j in blocks(texts):
            doc, ids = features(texts[i:j])
            cuts = np.searchsorted(doc, np.arange(j - i + 1))
            rows = [ids[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(y[i:j].astype("i4")), pa.array(rows, pa.binary())], ["y", "ids"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(y, bytes(ids)) for b in batches for y, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    found.sort()  # the order in which rows arrive must not matter
    order = np.random.default_rng(1).permutation(len(found))
    found = [found[i] for i in order]
    m = fit_rows(np.array([y for y, _ in found], dtype=np.int64), [np.frombuffer(x, "<i4") for _, x in found])
    line = [m.weights.astype("<f4").tobytes(), m.squares.astype("<f4").tobytes(), m.bias, m.slope, m.intercept]
    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in line], ["weights", "squares", "bias", "slope", "intercept"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 8000,
) -> Model:
    """Learn from labelled documents outside the held-out fifth.

    About ``sample_rows`` labelled rows are used, chosen by a hash of their id
    where there are more; their n-grams are found in parallel and one task fits
    the model. Labels other than 0 and 1, and rows without an id, are not used.
    With one class or none, scores are the share of label 1.
    """
    key = column(labels, id_col)
    usable = labels.select(key.alias("k"), column(labels, label_col).cast("int").alias("y")).where("y IN (0, 1) AND k IS NOT NULL").where(~held_out(F.col("k")))
    total = usable.count()
    if total > sample_rows:
        usable = usable.where(F.pmod(F.xxhash64(F.col("k"), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    texts = docs.select(column(docs, id_col).alias("k"), column(docs, text_col).cast("binary").alias("t"))
    rows = texts.join(F.broadcast(usable), "k").select("y", "t").mapInArrow(_featured, "y int, ids binary")
    found = rows.repartition(1).mapInArrow(_fitted, "weights binary, squares binary, bias double, slope double, intercept double").first()
    array = lambda x: np.frombuffer(bytes(x), "<f4").astype(np.float64)
    return Model(array(found["weights"]), array(found["squares"]), found["bias"], found["slope"], found["intercept"])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the probability of label 1, from the whole text alone.

    Null texts score as empty ones, which have no n-gram. A ``score_col`` already
    present is replaced; other columns and repeated rows pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or b"" for t in batch]
            yield pd.Series(np.concatenate([shared.value.scores(texts[i:j]) for i, j in blocks(texts)] or [np.zeros(0)]), dtype="float64")

    out = without(docs, [score_col])
    return out.withColumn(score_col, of(column(docs, text_col).cast("binary")))
