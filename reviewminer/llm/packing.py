"""Token sequences by power-of-two decomposition.

A document's ids and the closing id are cut into pieces of the longest length,
then into one piece for each binary digit of the rest. Every piece is a
sequence of its own, so no sequence crosses documents and none is padded;
pieces of equal length share a bucket. Null texts are empty and give the
closing id alone. Repeated and null doc_ids are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder_of, text_blocks, tokenizer_path
from .common import enough_tasks

LONGEST = 4096
CLOSING = 2


def cuts(count: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``count`` ids."""
    out, at, length = [], 0, longest
    while at < count:
        if length <= count - at:
            out.append((at, length))
            at += length
        else:
            length //= 2
    return out


def _cut(path: str | None, longest: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path or tokenizer_path())
        for doc_ids, texts in text_blocks(batches):
            rows = []
            for doc_id, found in zip(doc_ids.to_pylist(), encoder.encode(texts), strict=True):
                tokens = np.append(found, CLOSING).astype("<u4")
                rows += [(doc_id, s, n, tokens[s : s + n].tobytes(), len(tokens)) for s, n in cuts(len(tokens), longest)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return cut


def packed(docs: DataFrame, longest: int = LONGEST, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset); ids as little-endian 32-bit numbers.

    ``bucket`` is the sequence's length; readers batch by it.
    """
    rows = enough_tasks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    pieces = rows.mapInArrow(
        _cut(path, longest), "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"
    )
    return pieces.select(
        "*", F.col("length").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )


