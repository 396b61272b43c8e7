"""BPE encoding and decoding of a table of texts.

``encode`` returns ids, ``decode`` texts; the registered query returns digests of both.
A null text is empty: no ids, the empty text. Rows are independent, so repeated rows, ties
and extra columns change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.bpe import encoder, tokenizer_path
from tesserine.llm.common import sliced, table

VOCABULARY = "word_bpe_49k.json"
#: Bytes of an unsplit run beyond which it is encoded by tree concatenation: the longer words of ordinary text are.
LONG = 16


def encode(df: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """``df`` with an array of token ids of its column ``text``; it replaces a column ``out``."""
    at, kept = df.columns.index(text), [i for i, c in enumerate(df.columns) if c.lower() != out.lower()]
    names = [df.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        e = encoder(path, LONG)
        for b in sliced(batches):
            ids = [np.frombuffer(e.encode(x), "<u4").astype("int32") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(ids, pa.list_(pa.int32()))], [*names, out])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return df.mapInArrow(run, StructType([*[df.schema.fields[i] for i in kept], StructField(out, ArrayType(IntegerType()))]))


def decode(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """``df`` with the text of its array column ``ids``, which replaces a column ``out``; a null array decodes to the empty text."""
    at, kept = df.columns.index(ids), [i for i, c in enumerate(df.columns) if c.lower() != out.lower()]
    names = [df.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        e = encoder(path, LONG)
        for b in sliced(batches):
            texts = [e.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(texts, pa.string())], [*names, out])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInArrow(run, StructType([*[df.schema.fields[i] for i in kept], StructField(out, StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, LONG)
        for b in sliced(batches):
            count, of_ids, of_text = [], [], []
            for x in b.column(1).to_pylist():
                ids = e.encode(x)
                count.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
