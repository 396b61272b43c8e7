"""Nearest neighbours by multiprobe p-stable hashing with exact distance reranking.

Every vector is filed in one table or in ``TABLES`` under ``floor((a.v + b) / w)`` for some Gaussian
directions a. For a query the success probability of a bucket is the product, over
the directions, of the mass that a Gaussian of the expected neighbour distance around the
query's projection puts into the bucket's slot; buckets are visited in falling order of it
until the tables together are expected to hold ``TARGET`` of the neighbours. Tables and directions are those of which the
sample expects the least work (rows visited, and ``ROW`` of them for each bucket listed) among those whose listed
buckets reach that for nearly every sampled query; a query for which they do not is searched against all rows. Candidates of all
tables are merged and ranked by exact double-precision distance.

The expected distance is fitted on a documented, bounded sample: ``SAMPLE_QUERIES`` queries
against ``SAMPLE_ROWS`` rows, brought to the full count by the rank that k takes there. Every
row is indexed. Large buckets are split into blocks of ``BLOCK`` rows (up to ``BLOCKS`` times that where the rows fill all
tasks several times), so that one key with many rows becomes many tasks. A task holds one block and takes its queries in
small batches, however many they are. A query whose buckets hold fewer than k candidates is
searched again against all rows, in blocks.

Vectors that are null, zero or hold null or non-finite components take no part, neither
as query nor as candidate; rows of another length than a query are not its candidates. Ties go to the smaller
vec_id; repeated rows of one id count once, at their smallest distance. No queries: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tesserine.llm.common import cut, mix64, table
from tesserine.llm.vectors import packed

K = 10
TABLES = 2
#: Expected share of neighbours in the visited buckets.
TARGET = 0.985
SAMPLE_QUERIES, SAMPLE_ROWS = 256, 8192
#: Slot tuples of a table that are listed for a query.
TUPLES = 20_000
#: Share of sampled queries that may miss the target with the directions chosen.
MISSED = 0.01
BLOCK, BLOCKS = 4096, 16
#: Distances that cost as much as sending a query to a bucket.
ROW = 200
#: Queries that are compared with a block at once, and rows of queries that are sent at once.
ASKED, SENT = 64, 16_384
#: Buckets, if no more, that are known while queries are sent, so that no query goes to an empty one.
KNOWN = 1 << 20
SEED = 7


def directions(count: int) -> int:
    """Hash directions of a table: buckets grow with the rows."""
    return max(2, min(10, round(math.log2(max(count, 1) / 4096 + 1))))


class Index:
    """The hash functions for one vector length, slot width and expected neighbour distance."""

    def __init__(self, width: int, functions: int, slot: float, distance: float, tables: int = TABLES):
        rng = np.random.default_rng(SEED * 1000 + width)
        self.functions, self.slot, self.distance, self.tables, self.tuples = functions, slot, max(distance, 1e-12), tables, TUPLES
        self.a = rng.standard_normal((tables * functions, width))
        self.b = rng.uniform(0, slot, tables * functions)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers, rows by tables."""
        slots = np.floor((x @ self.a.T + self.b) / self.slot).astype(np.int64)
        return self.fold(slots.reshape(len(x), self.tables, self.functions))

    @staticmethod
    def fold(slots: np.ndarray) -> np.ndarray:
        """One number for a tuple of slots: 6 bits each, enough for slots that hold data; far slots may share one."""
        out = np.zeros(slots.shape[:-1], np.int64)
        for i in range(slots.shape[-1]):
            out = (out << 6) | (slots[..., i] & 63)
        return out

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """For one query and each table, bucket numbers in falling order of estimated success, until the target is met; none where it can't be met."""
        at = x @ self.a.T + self.b
        out = []
        share = 1 - (1 - TARGET) ** (1 / self.tables)
        for t in range(self.tables):
            mass, slots = np.ones(1), np.zeros((1, 0), np.int64)
            for f in range(t * self.functions, (t + 1) * self.functions):
                low = math.floor((at[f] - 4 * self.distance) / self.slot)
                high = math.floor((at[f] + 4 * self.distance) / self.slot)
                s = np.arange(low, high + 1)
                edge = np.array([_phi((e * self.slot - at[f]) / self.distance) for e in range(low, high + 2)])
                p = np.diff(edge)
                s, p = s[p > 1e-3], p[p > 1e-3]
                mass = (mass[:, None] * p[None]).ravel()
                slots = np.concatenate([np.repeat(slots, len(s), axis=0), np.tile(s, len(slots))[:, None]], axis=1)
                if len(mass) > self.tuples:  # what the tail holds counts as not reached below
                    keep = np.argsort(-mass)[:self.tuples]
                    mass, slots = mass[keep], slots[keep]
            order = np.argsort(-mass, kind="stable")
            reached = np.cumsum(mass[order])
            if reached[-1] < share:
                return [np.empty(0, np.int64)] * self.tables
            take = int(np.searchsorted(reached, share)) + 1
            out.append(np.unique(self.fold(slots[order[:take]])))
        return out


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column(1)
        at = column.offsets.to_numpy().astype(np.int64)
        x = column.values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        bad, some = (np.concatenate([[0], np.cumsum(v)]) for v in (~np.isfinite(x), x != 0))
        fine = column.is_valid().to_numpy(zero_copy_only=False) & (at[1:] > at[:-1]) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
        rows = np.flatnonzero(fine)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([x[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())], ["id", "vector"])


def _by_width(batches: Iterator[pa.RecordBatch], dtype: np.dtype, rows: int) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """Rows of (id, vector) of equal length, a few at a time: length, ids, raw vectors and vectors."""
    for b in batches:
        lengths = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False) // dtype.itemsize
        for width in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == width)
            for i in range(0, len(at), rows):
                part = pa.array(at[i : i + rows])
                raw = b.column(1).take(part)
                yield width, b.column(0).take(part).to_numpy(zero_copy_only=False), raw, packed(raw, dtype).astype(np.float64)


def _counted(indexes: dict[int, Index], dtype: np.dtype):
    """The buckets of rows of (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, ids, _, x in _by_width(batches, dtype, 4096):
            numbers = indexes[width].buckets(x)
            for t in range(numbers.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), v, k)) for v, k in ((width, np.int32), (t, np.int32))] + [pa.array(numbers[:, t])], ["width", "at", "bucket"])

    return run


class Sizes:
    """How many blocks each bucket has, of those of more than one, and which buckets there are, if known."""

    def __init__(self, many: dict[tuple[int, int], dict[int, int]], known: dict[tuple[int, int], np.ndarray] | None):
        self.known = known
        self.many = {k: (np.array(sorted(v)), np.array([v[x] for x in sorted(v)])) for k, v in many.items()}

    def blocks(self, width: int, at: int, numbers: np.ndarray) -> np.ndarray:
        """Of each bucket number; 0 where the bucket is known to be empty."""
        out = np.ones(len(numbers), np.int64)
        if self.known is not None:
            out[~np.isin(numbers, self.known.get((width, at), np.empty(0, np.int64)))] = 0
        if (width, at) in self.many:
            large, count = self.many[width, at]
            i = np.minimum(np.searchsorted(large, numbers), len(large) - 1)
            out = np.where(large[i] == numbers, count[i], out)
        return out


def _filed(indexes: dict[int, Index], sizes: Sizes, dtype: np.dtype):
    """Rows of (id, vector) under each of their buckets, in one of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, ids, raw, x in _by_width(batches, dtype, 4096):
            mixed = mix64(ids.astype(np.int64).view(np.uint64) ^ x[:, 0].copy().view(np.uint64))
            numbers = indexes[width].buckets(x)
            for t in range(numbers.shape[1]):
                block = (mixed % np.maximum(sizes.blocks(width, t, numbers[:, t]), 1).astype(np.uint64)).astype(np.int32)
                yield _run_rows(width, np.full(len(ids), t), numbers[:, t], block, 0, ids, raw)

    return run


def _probed(indexes: dict[int, Index], sizes: Sizes, dtype: np.dtype):
    """Queries (id, vector) under each block of each bucket that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, ids, raw, x in _by_width(batches, dtype, 256):
            held, n = [], 0
            for i, v in enumerate(x):
                for t, numbers in enumerate(indexes[width].probes(v)):
                    blocks = sizes.blocks(width, t, numbers)
                    each = np.repeat(numbers, blocks)
                    block = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    held.append((np.full(len(each), i), np.full(len(each), t), each, block))
                    n += len(each)
                if n and (n > SENT or i == len(x) - 1):
                    row, at, bucket, block = (np.concatenate(c) for c in zip(*held, strict=True))
                    for k in range(0, n, SENT):
                        some = slice(k, k + SENT)
                        yield _run_rows(width, at[some], bucket[some], block[some], 1, ids[row[some]], raw.take(pa.array(row[some])))
                    held, n = [], 0

    return run


def _run_rows(width: int, at: np.ndarray, bucket: np.ndarray, block: np.ndarray, ask: int, ids: np.ndarray, raw: pa.Array) -> pa.RecordBatch:
    columns = [np.full(len(ids), width, np.int32), at.astype(np.int32), bucket.astype(np.int64), block.astype(np.int32), np.full(len(ids), ask, np.int32), ids.astype(np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), raw], _FILED_NAMES)


_FILED = "width int, at int, bucket long, block int, ask int, id long, vector binary"
_FILED_NAMES = [c.split()[0] for c in _FILED.split(", ")]


def _search(dtype: np.dtype):
    """The K nearest of each query in each block of a bucket; the block's rows come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        key, parts, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)])
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            ids = b.column(5).to_numpy()
            for a, e in zip(edges, [*edges[1:], b.num_rows], strict=True):
                if (own := tuple(keys[:4, a])) != key:
                    key, parts, block = own, [], None
                if not keys[4, a]:
                    parts.append((ids[a:e], packed(b.column(6).slice(a, e - a), dtype)))
                    continue
                if block is None and parts:
                    block = _Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.float64))
                    parts = []
                if block is None:
                    continue
                for i in range(a, e, ASKED):
                    n = min(ASKED, e - i)
                    kept += block.nearest(ids[i : i + n], packed(b.column(6).slice(i, n), dtype).astype(np.float64))
                if sum(map(len, kept)) > 400_000 or len(kept) > 4000:
                    kept = [_best(np.concatenate(kept))]
                    if len(kept[0]) > 300_000:
                        yield _batch(kept[0])
                        kept = []
        if kept:
            yield _batch(_best(np.concatenate(kept)))

    return run


class _Block:
    """Rows of a bucket that queries are compared with."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.norms = ids, x, (x**2).sum(axis=1)
        self.repeated = len(np.unique(ids)) < len(ids)
        self.slack = 1e-9 * (1 + self.norms.max())

    def nearest(self, ids: np.ndarray, asked: np.ndarray) -> list[np.ndarray]:
        """Triples of the nearest rows of some queries."""
        rough = asked @ self.x.T
        rough *= -2
        rough += self.norms
        n = min(K + 6, len(self.ids))  # more are looked at where ids come again
        near = np.argpartition(rough, n - 1, axis=1)[:, :n] if n < len(self.ids) else np.tile(np.arange(n), (len(asked), 1))
        # Where more candidates than that are as near as the last, ties are settled among all of them.
        crowd = np.zeros(len(asked), bool)
        if n < len(self.ids):
            kth = np.sort(np.take_along_axis(rough, near, axis=1), axis=1)[:, K] + self.slack
            crowd = (rough <= kth[:, None]).sum(axis=1) > n
            if self.repeated:
                crowd[:] = True
                kth[:] = np.inf
        d = np.sqrt(((self.x[near] - asked[:, None, :]) ** 2).sum(axis=-1))
        q_ids, v_ids = np.repeat(ids, n), self.ids[near].ravel()
        keep = (q_ids != v_ids) & ~np.repeat(crowd, n)
        out = [_triples(q_ids[keep], v_ids[keep], d.ravel()[keep])]
        for r in np.flatnonzero(crowd):
            these = np.flatnonzero((rough[r] <= kth[r]) & (self.ids != ids[r]))
            far = np.sqrt(((self.x[these] - asked[r]) ** 2).sum(axis=1))
            out.append(_best(_triples(np.full(len(these), ids[r]), self.ids[these], far)))
        return out


_TRIPLE = np.dtype([("q", "<i8"), ("v", "<i8"), ("d", "<f8")])


def _triples(q: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    out = np.empty(len(v), _TRIPLE)
    out["q"], out["v"], out["d"] = q, v, d
    return out


def _best(t: np.ndarray) -> np.ndarray:
    """The K nearest distinct candidates of each query."""
    t = t[np.lexsort((t["d"], t["v"], t["q"]))]
    first = np.ones(len(t), bool)
    first[1:] = (t["q"][1:] != t["q"][:-1]) | (t["v"][1:] != t["v"][:-1])
    t = t[first]
    t = t[np.lexsort((t["v"], t["d"], t["q"]))]
    start = np.flatnonzero(np.concatenate([[True], t["q"][1:] != t["q"][:-1]])) if len(t) else np.empty(0, np.int64)
    rank = np.arange(len(t)) - np.repeat(start, np.diff([*start, len(t)]))
    return t[rank < K]


def _batch(t: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t["q"].copy()), pa.array(t["v"].copy()), pa.array(t["d"].copy())], ["query_id", "vec_id", "score"])


def _misses(index: Index, q: np.ndarray) -> bool:
    """Whether more than ``MISSED`` of some queries can't reach the target."""
    some = q[:64]
    return sum(not len(index.probes(x)[0]) for x in some) > MISSED * len(some)


def _work(index: Index, q: np.ndarray, c: np.ndarray, count: int) -> float:
    """Distances that a query is expected to cost among ``count`` rows, by some of the queries ``q`` and the rows ``c``."""
    filed, out = index.buckets(c), []
    for x in q[:64]:
        visited = index.probes(x)
        if len(visited[0]):
            out.append(sum(count * np.isin(filed[:, t], n).mean() + ROW * len(n) for t, n in enumerate(visited)))
        else:
            out.append(count)
    return float(np.mean(out)) if out else 0.0


def _fit(valid: DataFrame, counts: dict[int, int], dtype: np.dtype) -> dict[int, Index]:
    """One index for each vector length, fitted on a sample whose size is bounded by the parameters."""
    out = {}
    for width, count in counts.items():
        rows = SAMPLE_ROWS + SAMPLE_QUERIES
        some = valid.where(F.length("vector") == dtype.itemsize * width).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / count))).select("vector").limit(2 * rows).collect()
        x = np.array([np.frombuffer(r[0], dtype) for r in some]).reshape(-1, width).astype(np.float64)
        q, c = x[:SAMPLE_QUERIES], x[SAMPLE_QUERIES:] if len(x) > 2 * SAMPLE_QUERIES else x
        square = np.maximum((q**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * q @ c.T, 0) if len(x) else np.zeros((1, 1))
        far = np.sort(np.sqrt(square), axis=1)
        # The k-th neighbour among all rows is nearer than the k-th in the sample: take the k-th there, an upper bound.
        distance = float(np.quantile(far[:, min(K, far.shape[1] - 1)], 0.75)) if len(x) else 1.0
        spread = float(np.median(far)) or 1.0
        slot = 1.25 * max(spread / math.sqrt(2), 1e-12)
        best, least = Index(width, 1, slot, distance, 1), math.inf
        for tables in range(1, TABLES + 1):
            for functions in range(1, directions(count) + 1):
                index = Index(width, functions, slot, distance, tables)
                if functions > 1 and _misses(index, q):
                    break
                work = _work(index, q, c, count) if len(x) else 0.0
                if work < least:
                    best, least = index, work
                elif work > 3 * least:
                    break
        out[width] = best
    return out


def nearest(vectors: DataFrame, is_query: str) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vectors(vec_id, embedding)``; rows for which the SQL predicate ``is_query`` holds are the queries."""
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    dtype = np.dtype(np.float32 if single else np.float64)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding")).where("vec_id is not null")
    valid = cut(plain.mapInArrow(_valid, "id long, vector binary"))
    counts = {int(r[0]) // dtype.itemsize: int(r[1]) for r in valid.groupBy(F.length("vector")).count().collect()}
    queries = valid.where(is_query.replace("vec_id", "id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = max(counts.values(), default=0)
    block = min(BLOCKS * BLOCK, max(BLOCK, total // (4 * parts)))
    indexes = _fit(valid, counts, dtype)
    sized = cut(valid.mapInArrow(_counted(indexes, dtype), "width int, at int, bucket long").groupBy("width", "at", "bucket").count())
    many: dict[tuple[int, int], dict[int, int]] = {}
    for r in sized.where(F.col("count") > block).collect():  # fewer than there are blocks
        many.setdefault((r.width, r.at), {})[r.bucket] = math.ceil(r["count"] / block)
    known = None
    if sized.count() <= KNOWN:
        found = sized.select("width", "at", "bucket").toArrow()
        own = np.stack([found.column(i).to_numpy().astype(np.int64) for i in range(3)])
        known = {(w, t): own[2, (own[0] == w) & (own[1] == t)] for w, t in {*zip(*own[:2].tolist(), strict=True)}}
    sizes = Sizes(many, known)

    def search(rows: DataFrame) -> DataFrame:
        run = ["width", "at", "bucket", "block"]
        return rows.repartition(parts, *run).sortWithinPartitions(*run, "ask").mapInArrow(_search(dtype), "query_id long, vec_id long, score double")

    found = cut(_merge(search(valid.mapInArrow(_filed(indexes, sizes, dtype), _FILED).union(queries.mapInArrow(_probed(indexes, sizes, dtype), _FILED)))))
    # Too few candidates, or a target that the buckets can't reach: against all rows of that length, in blocks.
    short = queries.join(found.groupBy("query_id").count().where(f"count >= {K}").select(F.col("query_id").alias("id")), "id", "left_anti")
    short = cut(short)
    if not short.isEmpty():
        blocks = max(1, math.ceil(total / block))
        frame = lambda df, number, ask: df.select((F.length("vector") / dtype.itemsize).cast("int").alias("width"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("bucket"), number.cast("int").alias("block"), F.lit(ask).alias("ask"), "id", "vector")
        whole = search(frame(valid, F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)), 0).union(frame(short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), F.col("block"), 1)))
        found = _merge(found.select("query_id", "vec_id", "score").union(whole))
    return found.select("query_id", F.col("rank"), "vec_id", "score")


def _merge(found: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(f"rank <= {K}")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")
