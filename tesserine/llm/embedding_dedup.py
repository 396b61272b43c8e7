"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random and reduced to the signs of its coordinates; with it goes
the inner product of the vector and its code, the correction factor. Code times rotated
vector over that factor is an unbiased estimate of the cosine, with an error bound
that shrinks with the dimension. Signs of independent rotations also serve as bucket
codes: vectors of one label that agree on all bits of a table meet in a bucket. To the buckets go ids and codes
alone: the signs with the rotated coordinates in 8 bits, whose rounding enters the bound. Only vectors of pairs that
estimate and bound leave open are fetched; those pairs are recomputed exactly in double precision, and
only those with cosine >= THRESHOLD are links, counted in the first table where they meet.

The bits of a table grow with the logarithm of the largest label (a bucket holds about ``FILL`` of it), the tables so that a pair
exactly at the threshold is missed with a probability below MISS. Buckets beyond BLOCK members
are compared block by block in separate tasks, all pairs of them. Labels of any type are compared as they are written.

Null, zero and non-finite vectors and null labels link with nothing. Identical vectors of one
label are one class whose size counts in its links. Vectors of another length only
meet their own length. A row with null vec_id is returned with no links. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import cut, table
from tesserine.llm.graph import components
from tesserine.llm.vectors import packed, runs

THRESHOLD = 0.93
MISS = 1e-4
#: Members of a bucket that one task compares with another such block.
BLOCK = 512
#: Members of a bucket that the bits aim at.
FILL = 256
#: Standard errors that the bound adds to the estimate.
SIGMAS = 4.0
SEED = 11


def plan(largest: int) -> tuple[int, int]:
    """Bits of a table, and tables, for the largest label."""
    bits = max(2, min(30, math.ceil(math.log2(max(largest, 1) / FILL + 1))))
    agree = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def rotations(width: int, count: int) -> np.ndarray:
    """``count`` random rotations of ``width`` dimensions, one above the other."""
    rng = np.random.default_rng(SEED + width)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((width, width)))
        out.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(out)


def _encode(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            raws = b.column(3).to_pylist()
            widths = np.array([len(r) // 8 for r in raws])
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                x = np.frombuffer(b"".join(raws[i] for i in at), np.float64).reshape(len(at), width)
                p = known.setdefault(width, rotations(width, math.ceil(bits * tables / width)))
                turned = x @ p.T
                signs = (turned > 0)[:, : bits * tables].reshape(len(at), tables, bits)
                codes = signs @ (1 << np.arange(bits, dtype=np.int64))
                # The first rotation's coordinates in 8 bits, none of them 0, so that they keep the signs.
                turned = turned[:, :width]
                step = np.maximum(np.abs(turned).max(axis=1) / 127, 1e-300)
                short = np.clip(np.rint(np.abs(turned) / step[:, None]), 1, 127) * np.where(turned > 0, 1, -1)
                factor = np.abs(turned).sum(axis=1) / math.sqrt(width)
                part = b.take(pa.array(at))
                lists = [pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array([r.tobytes() for r in short.astype(np.int8)], pa.binary()), pa.array(step), pa.array(factor)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*b.schema.names, "codes", "short", "step", "factor"])

    return run


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each block that have a pair which the estimate leaves open, from the codes alone."""
    for key, t in runs(batches, _KEYS):
        if t.num_rows < 2:
            continue
        width, low, high = key[1], key[4], key[5]
        block, factor, step = (t.column(c).to_numpy() for c in ("block", "factor", "step"))
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        if not len(left) or not len(right):
            continue
        short = packed(t.column("short"), np.int8).astype(np.float32)
        code = np.where(short > 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(width))
        estimate = ((code[left] @ short[right].T) * step[right][None] / factor[left][:, None]).astype(np.float64)
        rounding = (math.sqrt(width) * step[right])[None] / factor[left][:, None]
        possible = estimate + _error(factor[left], width)[:, None] + rounding + 1e-5 >= THRESHOLD
        if low == high:
            np.fill_diagonal(possible, False)
        use = np.union1d(left[possible.any(axis=1)], right[possible.any(axis=0)])
        if len(use):
            yield t.select([*_KEYS, "block", "row"]).take(pa.array(use)).combine_chunks().to_batches()[0]


def _error(factor: np.ndarray, width: int) -> np.ndarray:
    """The bound of an estimate that divides by ``factor``."""
    return SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(width - 1, 1))


_KEYS = ["label", "width", "at", "code", "low", "high"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of links and, for each linked vector, an edge to the smallest id it is connected with in the block."""
    ids: list[np.ndarray] = []
    for key, t in runs(batches, _KEYS):
        if t.num_rows < 2:
            continue
        found = _links(t, key)
        if found is not None:
            ids.append(found)
        if len(ids) >= 2000:
            yield _rows(np.concatenate(ids))
            ids = []
    if ids:
        yield _rows(np.concatenate(ids))


def _rows(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2])], ["id", "root", "links"])


_rotation: dict[int, np.ndarray] = {}


def _links(t: pa.Table, key: tuple) -> np.ndarray | None:
    _, width, at, _, low, high = key
    ids = t.column("id").to_numpy()
    count = t.column("n").to_numpy()
    codes = np.array(t.column("codes").to_pylist(), np.int32)
    block = t.column("block").to_numpy()
    x = packed(t.column("vector"))
    p = _rotation.setdefault(width, rotations(width, 1))
    turned = x @ p.T
    code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(width)
    factor = (code * turned).sum(axis=1)
    # Rows of block low against rows of block high; within a block every pair once.
    left = np.flatnonzero(block == low)
    right = left if low == high else np.flatnonzero(block == high)
    if not len(left) or not len(right):
        return None
    estimate = (code[left] @ turned[right].T) / factor[left][:, None]
    i, j = np.nonzero(estimate + _error(factor[left], width)[:, None] >= THRESHOLD)
    i, j = left[i], right[j]
    if low == high:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return None
    near = np.einsum("ij,ij->i", x[i], x[j]) >= THRESHOLD
    i, j = i[near], j[near]
    if at and len(i):  # an earlier table has this pair already
        first = ~(codes[i, :at] == codes[j, :at]).any(axis=1)
        i, j = i[first], j[first]
    if not len(i):
        return None
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, count[j])
    np.add.at(links, j, count[i])
    root = ids.copy()
    while True:  # smallest id over the pairs of this block
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    has = links > 0
    return np.stack([ids[has], root[has], links[has]], axis=1)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for r in b.column(1).to_pylist():
                v = None if r is None or None in r else np.array(r, np.float64)
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    out.append(None)
                    continue
                v = v / np.abs(v).max()  # squares neither overflow nor vanish
                out.append((v / np.sqrt((v * v).sum()) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])

    kind = "long" if vectors.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast(kind).alias("label"))
    prepared = cut(vectors.mapInArrow(prepare, f"vec_id long, label {kind}, vector binary"))
    usable = prepared.where("vector is not null and label is not null and vec_id is not null")
    classes = cut(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("row", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest)
    coded = classes.select("row", "label", "n", "vector").mapInArrow(_encode(bits, tables), f"row long, label {kind}, n long, vector binary, codes array<int>, short binary, step double, factor double")
    coded = cut(coded.withColumn("width", F.length("short")).drop("n", "vector"))
    each = coded.select("row", "label", "width", "short", "step", "factor", F.posexplode("codes").alias("at", "code"))
    sizes = each.groupBy("label", "width", "at", "code").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    # A member goes to the pairs of its block with every block, each pair (low, high) once.
    block = each.join(sizes, ["label", "width", "at", "code"]).withColumn("block", F.pmod(F.xxhash64("row", "at"), F.col("blocks")).cast("int"))
    dealt = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "width", "at", "code", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row", "short", "step", "factor")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = f"label {kind}, width int, at int, code int, low int, high int"
    opened = cut(dealt.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_open, f"{keyed}, block int, row long"))
    whole = opened.join(classes.select("row", "id", "n", "vector"), "row").join(coded.select("row", "codes"), "row").select(*_KEYS, "block", "id", "n", "codes", "vector")
    compared = whole.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_compare, "id long, root long, links long")
    found = cut(compared.groupBy("id", "root").agg(F.sum("links").alias("links")))
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.select("label", "vector", "id", "n").join(counts, "id", "left").join(linked, "id", "left")
    of_class = of_class.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = prepared.join(of_class, ["label", "vector"], "left")
    out = out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) AS s FROM embeddings
), usable AS (
  SELECT vec_id, label, [x / sqrt(s) FOR x IN e] AS u FROM v WHERE label IS NOT NULL AND s > 0 AND isfinite(s) AND len(list_filter(e, lambda x: x IS NULL)) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, s.component_id, e.vec_id = s.component_id AS kept
FROM embeddings e JOIN smallest s ON s.a = e.vec_id
"""
