"""Toxicity by classifier chains.

Categories are label columns of 0 and 1, predicted in order by linear (logistic) models; the
probability of each earlier category is a feature of the later ones. So that a later model learns
from probabilities as it will meet them, those in its training rows come from
models that did not see the row: out-of-fold predictions, folds by a hash of doc_id. Features
are the presence of words and of word beginnings of 4, 5 and 6 letters, hashed; of them the
``FEATURES`` of the largest chi-square for any category are used.

The models are fitted on at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id (all if
fewer). Each category's threshold is the one of the best F1 among its out-of-fold predictions.
Labels that are null, neither 0 nor 1, or of unknown documents are not learned from; where a
label row repeats, each counts. A null or empty text has no features. Prediction reads
nothing but the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import sliced, table
from tesserine.llm.words import slices, words

SPACE = 1 << 18
FEATURES = 4096
TRAIN_ROWS = 12_000
FOLDS = 5
MEMORY = 400_000
#: The chain's order: poor quality first, then toxic; each with the label value that means the category.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def _numbers(word: str) -> list[int]:
    raw = word.encode()
    out = [zlib.crc32(raw)]
    for n in (4, 5, 6):
        if len(word) > n:
            out.append(zlib.crc32(word[:n].encode(), n))
    return [x & (SPACE - 1) for x in out]


def features(text: str | None) -> set[int]:
    out: set[int] = set()
    for part in slices(text) if text else ():
        for w in set(words(part)):
            out.update(_numbers(w))
    return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows have each feature, in all and of each category."""
    total = None
    for b in sliced(batches):
        labels = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)]).astype(np.int64)
        total = np.zeros((1 + len(labels), SPACE), np.int64) if total is None else total
        for text, own in zip(b.column(0).to_pylist(), labels.T, strict=True):
            at = np.fromiter(features(text), np.int64)
            total[0, at] += 1
            for k in np.flatnonzero(own):
                total[k + 1, at] += 1
    if total is not None:
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[:, at].T.tolist(), pa.list_(pa.int64()))], ["feature", "n"])


def _fit(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, ridge: float = 1.0, steps: int = 120) -> np.ndarray:
    """Logistic regression of y on sparse presence (rows, cols) and dense columns, by accelerated gradients; the last weights are of the dense columns and the constant."""
    n = len(y)
    dense = np.concatenate([extra, np.ones((n, 1))], axis=1)
    w = np.zeros(width + dense.shape[1])
    look = w.copy()
    # A bound of the curvature: a quarter of the largest row norm times the largest column sum would be loose; scale each weight by its own.
    scale = np.concatenate([np.bincount(cols, minlength=width).astype(float), (dense**2).sum(axis=0)]) * 0.25 + ridge
    heavy = np.bincount(rows, minlength=n).mean() + dense.shape[1]
    scale *= max(1.0, heavy**0.5)
    for step in range(steps):
        z = np.bincount(rows, weights=look[cols], minlength=n) + dense @ look[width:]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(cols, weights=r[rows], minlength=width), dense.T @ r])
        g[:-1] += ridge * look[:-1]
        new = look - g / scale
        look = new + step / (step + 3) * (new - w)
        w = new
    return w


def _prob(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, n: int, w: np.ndarray, width: int) -> np.ndarray:
    z = np.bincount(rows, weights=w[cols], minlength=n) + np.concatenate([extra, np.ones((n, 1))], axis=1) @ w[width:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    at = int(np.argmax(f1)) if len(y) else 0
    if not len(y) or not y.sum():
        return 1.1
    below = p[order[at + 1]] if at + 1 < len(y) else 0.0
    return float((p[order[at]] + below) / 2)


class Chain:
    """For each category in order: its weights, and its threshold."""

    def __init__(self, chosen: np.ndarray, weights: list[np.ndarray], thresholds: list[float]):
        self.chosen, self.weights, self.thresholds = chosen, weights, thresholds

    def open(self) -> Chain:
        self.place = {int(f): i for i, f in enumerate(self.chosen)}
        self.known: dict[str, tuple[int, ...]] = {}
        return self

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= MEMORY:
            self.known.clear()
        get = self.place.get
        found = self.known[word] = tuple(i for x in _numbers(word) if (i := get(x)) is not None)
        return found

    def predict(self, text: str | None) -> list[float]:
        has: set[int] = set()
        known, of = self.known, self._of
        for part in slices(text) if text else ():
            for w in set(words(part)):
                f = known.get(w)
                if f is None:
                    f = of(w)
                if f:
                    has.update(f)
        at = np.fromiter(has, np.int64, len(has))
        out: list[float] = []
        width = len(self.chosen)
        for w in self.weights:
            z = w[at].sum() + float(np.dot(w[width:-1], out)) + w[-1]
            out.append(1 / (1 + float(np.exp(-np.clip(z, -30, 30)))))
        return out


def train(docs: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES) -> Chain:
    """A chain of ``docs(doc_id, text)`` and ``labels(doc_id, ...)``."""
    given = labels.where("doc_id is not null")
    for _, column, _ in categories:
        given = given.where(F.col(column).isin(0, 1))
    given = given.select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.col(c) == v).cast("int").alias(name) for name, c, v in categories])
    total = given.count()
    # At most about TRAIN_ROWS ids and a few bits each: a bounded side.
    some = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, TRAIN_ROWS / max(1, total))))
    names = [name for name, _, _ in categories]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.join(F.broadcast(some), "doc_id")
    counted = rows.select("text", *names).mapInArrow(_presence, "feature int, n array<long>")
    summed = counted.groupBy("feature").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(names) + 1)])
    n = rows.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in names]).first()
    score = [F.expr(f"power({n[0]}D * n{i} - n0 * {n[i]}D, 2) / (1D + n0 * ({n[0]}D - n0) * {n[i]}D * ({n[0]}D - {n[i]}D)) * {n[0]}D") for i in range(1, len(names) + 1)]
    best = summed.where("n0 >= 3").withColumn("score", F.greatest(*score, F.lit(0.0))).where("score > 8").orderBy(F.desc("score"), "feature").limit(FEATURES)
    chosen = np.sort(np.array([r[0] for r in best.select("feature").collect()], np.int64))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [np.flatnonzero(np.isin(chosen, np.fromiter(features(t), np.int64))).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), *b.columns[2:]], ["doc_id", "f", *names])

    data = rows.select("doc_id", "text", *names).mapInArrow(few, "doc_id long, f array<int>, " + ", ".join(f"{x} int" for x in names)).toPandas().sort_values("doc_id", kind="stable")
    fold = np.array([zlib.crc32(str(x).encode(), 5) % FOLDS for x in data["doc_id"]])
    lists = data["f"].tolist()
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(at) else np.empty(0, np.int64)
    width, size = len(chosen), len(lists)
    out_of_fold, weights, thresholds = np.zeros((size, 0)), [], []
    for name in names:
        y = data[name].to_numpy(float)
        p = np.zeros(size)
        for f in range(FOLDS):
            inner, own = fold != f, fold == f
            if not own.any() or not inner.any():
                continue
            use, test = inner[at], own[at]
            renumber = np.cumsum(inner) - 1
            w = _fit(renumber[at[use]], col[use], out_of_fold[inner], y[inner], width)
            renumber = np.cumsum(own) - 1
            p[own] = _prob(renumber[at[test]], col[test], out_of_fold[own], int(own.sum()), w, width)
        weights.append(_fit(at, col, out_of_fold, y, width) if size else np.zeros(width + out_of_fold.shape[1] + 1))
        thresholds.append(_threshold(p, y))
        out_of_fold = np.concatenate([out_of_fold, p[:, None]], axis=1)
    return Chain(chosen, weights, thresholds)


def classify(docs: DataFrame, chain: Chain, categories: tuple = CATEGORIES) -> DataFrame:
    """``doc_id`` with the probability ``p_<category>`` and the decision ``is_<category>`` of every category, for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((chain.chosen, chain.weights, chain.thresholds))
    names = [name for name, _, _ in categories]
    thresholds = chain.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Chain(*shared.value).open()
        for b in sliced(batches):
            p = [c.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in p], pa.float64()) for i in range(len(names))]], ["doc_id", *[f"p_{x}" for x in names]])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{x} double" for x in names))
    return out.select("*", *[(F.col(f"p_{x}") >= t).alias(f"is_{x}") for x, t in zip(names, thresholds, strict=True)])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``documents`` that the chain finds toxic, with the probabilities of all categories."""
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.where("is_toxic")
