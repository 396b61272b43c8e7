"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document is cut where it fills whole windows; what remains is cut into equal pieces of at
most ``PIECE`` tokens. Remaining pieces are dealt into blocks of about ``BLOCK_WINDOWS``
windows. In a block the partition into k windows starts with every piece as a partial
partition of its own; the two partitions of the largest spread are merged again and again,
the fullest window of one with the emptiest of the other. If a window exceeds the capacity,
k rises by one and the block starts again.

A null or empty text is its end token alone. Rows are independent: repeated rows or ids are
packed once each. A null doc_id stays null. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.bpe import MEMORY, encoder, tokenizer_path
from tesserine.llm.common import cut, sliced, table

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
PIECE = 512
END_ID = 1
BLOCK_WINDOWS = 192
_BITS = 24  # of a sequence's number within its block


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of ``sizes`` in k groups with nearly equal sums. A partial partition lists its windows that hold anything, fullest first."""
    children: list[tuple[int, int]] = []
    heap: list[tuple] = [(-size, i, None, None) for i, size in enumerate(sizes)]  # a piece alone needs no arrays
    heapq.heapify(heap)
    base, turn = len(sizes), len(sizes)

    def opened(entry: tuple) -> tuple[np.ndarray, np.ndarray]:
        return entry[2:] if entry[2] is not None else (np.array([-entry[0]]), np.array([entry[1]]))

    while len(heap) > 1:
        (sums, nodes), (other, theirs) = opened(heapq.heappop(heap)), opened(heapq.heappop(heap))
        if len(sums) + len(other) <= k:  # no two windows meet: all stay as they are
            sums, merged = np.concatenate([sums, other]), np.concatenate([nodes, theirs])
            order = np.argsort(-sums, kind="stable")
            sums, merged = sums[order], merged[order]
            heapq.heappush(heap, (int((sums[-1] if len(sums) == k else 0) - sums[0]), turn, sums, merged))
            turn += 1
            continue
        (sums, nodes), (other, theirs) = _filled(sums, nodes, k), _filled(other, theirs, k)
        sums, theirs = sums + other[::-1], theirs[::-1]
        both = np.flatnonzero((nodes >= 0) & (theirs >= 0))
        merged = np.where(nodes >= 0, nodes, theirs)
        merged[both] = base + len(children) + np.arange(len(both))
        children.extend(zip(nodes[both].tolist(), theirs[both].tolist(), strict=True))
        order = np.argsort(-sums, kind="stable")
        sums, merged = sums[order], merged[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, merged))
        turn += 1
    groups = []
    for node in opened(heap[0])[1].tolist() if heap else []:
        group, todo = [], [node] if node >= 0 else []
        while todo:
            n = todo.pop()
            if n < base:
                group.append(n)
            else:
                todo.extend(children[n - base])
        groups.append(group)
    return groups


def _filled(sums: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A partial partition with its empty windows."""
    return np.concatenate([sums, np.zeros(k - len(sums), np.int64)]), np.concatenate([nodes, np.full(k - len(nodes), -1, np.int64)])


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of ``sizes`` (each within the capacity) in near-equal groups within the capacity."""
    if not sizes:
        return []
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


def _pieces(path: str, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task, row, end = encoder(path, memory=memory), TaskContext.get().partitionId(), 0, END_ID.to_bytes(4, "little")
        for b in sliced(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = e.encode(text) + end
                n = len(ids) // 4
                whole, rest = n - n % CAPACITY, n % CAPACITY
                cuts = [*range(0, whole, CAPACITY)]
                parts = math.ceil(rest / PIECE)
                cuts += [whole + rest * i // parts for i in range(parts)]
                for at, to in zip(cuts, [*cuts[1:], n], strict=True):
                    out.append((doc_id, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), n, (task << 32) + row))
                    row += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return run


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row", kind="stable").reset_index(drop=True)
    sizes = rows["length"].to_numpy()
    small = np.flatnonzero(sizes < CAPACITY)
    groups = [[i] for i in np.flatnonzero(sizes == CAPACITY).tolist()] + [[int(small[i]) for i in sorted(g)] for g in windows(sizes[small].tolist())]
    sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for s, group in enumerate(groups):
        at = 0
        for i in group:
            sequence[i], offset[i] = (int(key[0]) << _BITS) + s, at
            at += int(sizes[i])
    return rows.assign(sequence_id=sequence, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})


def pack(docs: DataFrame, path: str, memory: int = MEMORY) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``, with its place in a sequence. ``memory``: chunks that a Python process remembers, for speed alone."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(docs.mapInArrow(_pieces(path, memory), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, total // (BLOCK_WINDOWS * CAPACITY))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
