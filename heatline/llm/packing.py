"""Packing by power-of-two decomposition: a document of n tokens is cut into pieces whose lengths are powers of two, at
most the sequence length; pieces of equal length share a bucket and each is a sequence of its own. No sequence crosses
documents, and as each has a power of two for its length, nothing is padded. A task gathers the pieces of each bucket
and passes them on together, FLUSH bytes at most, so every batch holds sequences of one length; to_buckets() writes a
folder for each length.

Token ids equal those of the byte-level BPE file read by `tokenizers` with its default settings (see bpe); added tokens
of the file that stand in a text keep their own ids.

Null and empty texts give the end id alone. Repeated rows are packed each on its own; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from heatline.llm import bpe

END_ID = 1
#: Bytes of ids that a task gathers in a bucket before it passes them on.
FLUSH = 4 << 20


def pieces(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens, largest first: whole sequences, then the binary digits of the rest."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 1, -1, -1) if (n % most) >> k & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, with_ids: bool = True, tokenizer: str = bpe.FILE) -> DataFrame:
    """One row per piece: start and length in its document, bucket (log2 of the length), sequence and offset, the crc32
    of its ids and, if asked for, the ids. most: a power of two, the longest sequence.

    A narrow map over the scan; sequence ids come from the partition and the place in it, as Spark's own ids do."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.codec(tokenizer).encode
        end = np.array([END_ID], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        ready: list[list[tuple]] = [[] for _ in range(most.bit_length())]
        for batch in batches:
            ids_type = batch.column(0).type
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n, start, key = len(ids) // 4, 0, batch.column(0)[row].as_py()
                for length in pieces(n, most):
                    part, bucket = ids[4 * start : 4 * (start + length)], length.bit_length() - 1
                    ready[bucket].append((key, start, length, zlib.crc32(part), n, sequence, 0, bucket, part))
                    start, sequence = start + length, sequence + 1
                    if len(ready[bucket]) * (4 * length + 64) > FLUSH:
                        yield emit(ready[bucket], ids_type)
                        ready[bucket] = []
        for gathered in ready:
            if gathered:
                yield emit(gathered, ids_type)

    def emit(rows: list[tuple], ids_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows))
        arrays = [pa.array(cols[0], ids_type), *(pa.array(c, pa.int64()) for c in cols[1:8])]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[8]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["ids"] * with_ids])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket long" + ", ids array<int>" * with_ids)


def to_buckets(pieces: DataFrame, path: str) -> None:
    """Writes pieces with a folder for each bucket, so that a reader draws batches of one sequence length."""
    pieces.write.partitionBy("bucket").parquet(path)
