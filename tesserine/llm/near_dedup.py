"""MinHash near-dedup by min-max hashing.

Under each of ``PERMUTATIONS`` permutations of the shingle hashes both the smallest and
the largest value are kept: two nearly independent unbiased estimates of the Jaccard
similarity for one hash evaluation. The values are banded; documents that share a band are
candidates, and links are confirmed on the full shingle sets.

Rows: a document with null or empty text, or only white space, has an empty set and links
with nothing. Every input row has its output row; classes of equal sets that have the same
smallest doc_id (repeated ids) count as one document. A row with null doc_id links with nothing and is kept, its component null. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import cut, mix64, shingle_hashes, sliced, table, word_hashes
from tesserine.llm.graph import bucket_components, crowded

PERMUTATIONS = 96
BAND_ROWS = 6
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75

_rng = np.random.default_rng(20240131)
_multipliers = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_offsets = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    return np.unique(shingle_hashes(word_hashes(text)[0])) if text else np.empty(0, np.uint64)


def min_max(values: np.ndarray) -> np.ndarray:
    """For each permutation the minimum, then for each the maximum; ``values`` must not be empty."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096]
            mixed = part[None, :] * _multipliers[:, None] + _offsets[:, None]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            np.minimum(low, mixed.min(axis=1), out=low)
            np.maximum(high, mixed.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit value for each run of BAND_ROWS signature values and its place."""
    rows = signature.reshape(-1, BAND_ROWS)
    with np.errstate(over="ignore"):
        out = np.arange(1, len(rows) + 1, dtype=np.uint64)
        for i in range(BAND_ROWS):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _node(doc_id: int, digest: bytes, by_text: bool) -> int:
    """What stands for a document among the links: its id, or its set."""
    return int.from_bytes(digest[:8], "little", signed=True) if by_text else doc_id


def _sketch(by_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            count, digest, banded, node = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text)
                count.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                banded.append(bands(min_max(s)) if len(s) else np.empty(0, np.int64))
                node.append(_node(doc_id, digest[-1], by_text) if len(s) else None)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(node, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "node", "key"])

    return run


def _sets(by_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(text) for text in batch.column(1).to_pylist()]
            nodes = [_node(i, _digest(s), by_text) for i, s in zip(batch.column(0).to_pylist(), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "data"])

    return run


def _listed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    return _found(docs).drop("key")


def _found(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """The same with ``key``, a hash of the text; ``by_text``: rows of one doc_id and different sets are documents of their own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = cut(docs.withColumn("key", F.xxhash64("text")).mapInArrow(_sketch(by_text), "doc_id long, n_shingles long, digest binary, bands array<long>, node long, key long"))
    # Documents with one shingle set are one class, which its smallest doc_id stands for.
    known = sketched.where("doc_id is not null and digest is not null")
    classes = cut(known.groupBy("digest").agg(F.min("node").alias("id"), F.min("doc_id").alias("first_doc"), F.min_by("bands", "doc_id").alias("bands")))
    members = cut(crowded(classes.select(F.explode("bands").alias("bucket"), "id")))
    wanted = members.select("id").distinct()
    wanted = wanted.join(classes, "id").select(F.col("first_doc").alias("doc_id")) if by_text else wanted.withColumnRenamed("id", "doc_id")
    contents = cut(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(by_text), "id long, data array<long>"))
    linked = bucket_components(members, contents, _listed, PERCENT)
    found = classes.join(linked, "id", "left").select("digest", "first_doc", F.coalesce("component", "id").alias("component_id"))
    if by_text:
        found = found.join(found.groupBy("component_id").agg(F.min("first_doc").alias("first")), "component_id").select("digest", F.col("first").alias("component_id"))
    out = sketched.join(found.select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are not kept; all columns stay. Of rows that share a doc_id each goes or stays by its own text."""
    gone = _found(docs, by_text=True).where("not kept").select(F.col("doc_id").alias("_tesserine_doc"), F.col("key").alias("_tesserine_key")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("_tesserine_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_tesserine_key"))
    return docs.join(gone, same, "left_anti")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS id, any_value(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), postings AS (
  SELECT id, n, unnest(s) AS g FROM classes
), pairs AS (
  SELECT p.id AS a, q.id AS b, p.n AS na, q.n AS nb, count(*) AS c FROM postings p JOIN postings q ON p.g = q.g AND p.id < q.id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT id AS a, id AS b FROM classes UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a
), smallest AS (
  SELECT a AS id, min(b) AS component FROM reach GROUP BY a
), of_set AS (
  SELECT list_sort(c.s) AS s, m.component FROM classes c JOIN smallest m ON m.id = c.id
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(o.component, d.doc_id) AS component_id, d.doc_id = coalesce(o.component, d.doc_id) AS kept
FROM sets d LEFT JOIN of_set o ON list_sort(d.s) = o.s AND len(d.s) > 0
"""
