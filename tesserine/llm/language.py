"""Language ID by multilingual mixture inference.

A language is a distribution of character trigrams (hashed to ``GRAMS`` numbers) of lower-case
words with their boundaries, learned from labelled documents. A document is a mixture: each
word comes from one language with the product of its trigrams' probabilities, and
expectation-maximisation over the document's words estimates the proportions. The set of languages is
selected by penalised likelihood: of the sets of the most frequent 1, 2, ... languages, the one with the largest
log-likelihood less ``PENALTY`` times the logarithm of the word count for each language.
The prediction is the language of the largest proportion (ties: first by name), the score that
proportion.

Training uses documents whose crc32(doc_id as text) mod 5 is not 0 and whose lang is not null:
about ``TRAIN_DOCS`` of them, by a hash of the id, all if fewer. Neither lang, source nor doc_id enters a prediction.
Null text and text without letters are ``und`` with score 0, as is everything when nothing was
learned. A null doc_id is not held out and not learned from. Repeated rows are predicted alike.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import sliced, table
from tesserine.llm.words import slices, words

GRAMS = 1 << 15
TRAIN_DOCS = 12_000
PENALTY = 4.0
SMOOTHING = 0.05
UNKNOWN = "und"
#: Distinct words a task remembers.
MEMORY = 300_000
#: In the pipeline: a smaller share of its first language rejects a document.
REJECT_BELOW = 0.5
_STEPS, _CLOSE = 60, 1e-4


def grams(word: str) -> list[int]:
    padded = f" {word} ".encode()
    crc = zlib.crc32
    return [crc(padded[i : i + 3]) & (GRAMS - 1) for i in range(len(padded) - 2)]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    for b in sliced(batches):
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            count = seen.setdefault(lang, Counter())
            for part in slices(text):
                count.update(words(part))
            if len(count) > MEMORY:
                yield _summed(lang, seen.pop(lang))
    for lang, count in seen.items():
        yield _summed(lang, count)


def _summed(lang: str, count: Counter) -> pa.RecordBatch:
    total = np.zeros(GRAMS, np.int64)
    for word, n in count.items():
        for g in grams(word):
            total[g] += n
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "gram", "n"])


class Model:
    """Languages in order of name, and the log-probability of each trigram in each."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p

    def open(self) -> Model:
        self.place: dict[str, int] = {}
        self.scores = np.empty((MEMORY, len(self.languages)))
        return self

    def _new(self, word: str) -> int:
        if len(self.place) >= MEMORY:
            self.place.clear()
        at = self.place[word] = len(self.place)
        self.scores[at] = self.log_p[grams(word)].sum(axis=0)
        return at

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores and counts of the distinct words of a text."""
        if len(text) <= 1 << 20:
            count = Counter(words(text))
        else:
            count = Counter()
            for part in slices(text):
                count.update(words(part))
        if len(count) > MEMORY:
            return np.array([self.log_p[grams(w)].sum(axis=0) for w in count]), np.fromiter(count.values(), np.float64, len(count))
        if len(self.place) + len(count) > MEMORY:  # so that no place changes hands within a text
            self.place.clear()
        get, new = self.place.get, self._new
        at = [i if (i := get(w)) is not None else new(w) for w in count]
        return self.scores[at], np.fromiter(count.values(), np.float64, len(count))

    def mixture(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Prediction, score and the proportions of the selected languages."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, {}
        score, n = self._words(text)
        if not len(n):
            return UNKNOWN, 0.0, {}
        share, _ = _em(score, n)
        order = np.argsort(-share, kind="stable")
        total = n.sum()
        best, chosen = None, None
        for k in range(1, len(order) + 1):
            if k > 1 and share[order[k - 1]] * total < 1:  # less than a word
                break
            use = np.sort(order[:k])
            part, fit = _em(score[:, use], n)
            fit -= PENALTY * k * np.log(total + 1)
            if best is not None and fit <= best:
                break
            best, chosen = fit, dict(zip([self.languages[i] for i in use], part.tolist(), strict=True))
        first = max(chosen, key=lambda lang: (chosen[lang], [-ord(c) for c in lang]))
        return first, min(1.0, max(0.0, chosen[first])), chosen


def _em(score: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns and the log-likelihood."""
    top = score.max(axis=1)
    p = np.exp(score - top[:, None])
    k, total = p.shape[1], n.sum()
    share = np.full(k, 1 / k)
    mixed = p @ share
    for _ in range(_STEPS if k > 1 else 0):
        new = share * (p.T @ (n / mixed)) / total
        done = np.abs(new - share).max() < _CLOSE
        share = new
        mixed = p @ share
        if done:
            break
    return share, float((n * (np.log(mixed) + top)).sum())


def train(docs: DataFrame) -> Model:
    """A model of ``docs(doc_id, text, lang)``."""
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = usable.count()
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, TRAIN_DOCS / max(1, total))))
    counted = some.select("text", "lang").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()  # at most GRAMS rows for each language
    languages = sorted(rows["lang"].unique().tolist())
    n = np.full((GRAMS, len(languages)), SMOOTHING)
    n[rows["gram"].to_numpy(), [languages.index(x) for x in rows["lang"]]] += rows["n"].to_numpy()
    return Model(languages, np.log(n / n.sum(axis=0)))


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``proportions``, their names after ``prefix``; they replace columns of these names."""
    from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

    added = [f"{prefix}{x}" for x in ("lang_pred", "score", "proportions")]
    text = docs.columns.index("text")
    names = [c for c in docs.columns if c.lower() not in added]
    kept = [docs.columns.index(c) for c in names]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value).open()
        for b in sliced(batches):
            found = [m.mixture(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))], [*names, *added])

    more = [StructField(x, t) for x, t in zip(added, (StringType(), DoubleType(), MapType(StringType(), DoubleType())), strict=True)]
    return docs.mapInArrow(run, StructType([*[docs.schema.fields[i] for i in kept], *more]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(docs)
    asked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(asked, model).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without documents of no language and of none that makes up half of it."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    found = predict(docs, model, "_tesserine_")
    return found.where((F.col("_tesserine_lang_pred") != UNKNOWN) & (F.col("_tesserine_score") >= REJECT_BELOW)).select(docs.columns)
