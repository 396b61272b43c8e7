"""What several operators share: table reads, lineage cuts and vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space of the word contracts: space and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SHINGLE_WORDS = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: At the end of an execution Spark removes its shuffle files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's checkpoint folder and drop its lineage.

    The folder is the session's ``spark.checkpoint.dir``; only a session of one machine (a ``local`` master, as in
    tests) may go without, and gets a temporary one. Shuffle files go as soon as the cut is made, since
    nothing reads them again; checkpoint files when Spark's cleaner sees that nothing refers to them, for which
    the collectors of both languages are called.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tesserine-checkpoint-"))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # read when a frame is made
    try:
        out = df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    del df
    freed(out)
    return _sized(out)


def _sized(df: DataFrame) -> DataFrame:
    """A checkpoint with Spark's default size in place of an estimate beyond it.

    A checkpoint takes over the estimate of its plan, which for joins is the product of both sides. Squared from cut to cut, as
    by joins of a frame with itself in a loop, it comes to millions of digits that the driver plans with for seconds over gigabytes.
    """
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    plan = df._jdf.queryExecution().analyzed()
    if "E+" not in plan.stats().simpleString():  # as Spark writes sizes from 2048 EiB on; the number itself may be too long for Python
        return df
    some, none = jvm.scala.Option.apply(plan.constraints()), jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, some)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def freed(df: DataFrame) -> None:
    """Removes checkpoint files that no frame needs any more, in the session of ``df``."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: a bijection on 64 bits in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_byte_codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True
_base = np.uint64(0x2545F4914F6CDD1D)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, _base, np.uint64)]), dtype=np.uint64)
    return _powers


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


_lower_codes = _byte_codes[lower_ascii(np.arange(256))]


def word_hashes(text: str, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each white-space separated word, with the words' byte offsets (start, end) in UTF-8.

    The hash is a polynomial over random byte codes, evaluated for the whole text
    by one cumulative sum, so its cost does not depend on the number of words.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    codes = (_lower_codes if lower else _byte_codes)[raw]
    space = np.concatenate([[True], _is_space[raw], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    powers = _power_table(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[len(raw) - 1 :: -1][: len(raw)], dtype=np.uint64)])
        # A word's polynomial carries the factor base^(bytes after it); the inverse takes it out.
        words = (sums[ends] - sums[starts]) * _inverse_powers(len(raw) + 1)[len(raw) - ends]
        return mix64(words + (ends - starts).astype(np.uint64)), starts, ends


_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        step = np.uint64(pow(int(_base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, step, np.uint64)]), dtype=np.uint64)
    return _inverse


def shingle_hashes(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``k`` words in order; of the whole sequence where it has fewer words; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = out * _base + words[i : n - k + 1 + i]
        return mix64(out)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words in order, at a cost that does not depend on ``k``; there are ``k`` words or more."""
    n = len(words)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power_table(n)[:n], dtype=np.uint64)])
        return mix64((sums[k:] - sums[:-k]) * _inverse_powers(n)[: n - k + 1] + np.uint64(k))
