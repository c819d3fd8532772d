"""Sequence packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the binary digits of n, with lengths over the longest
sequence cut into pieces of that length.  Each piece is a sequence by itself, so none crosses documents and
none is padded; equal lengths share a bucket, from which batches of one length are drawn.  The operator is a
map: nothing is shuffled, and a task's memory is bounded by one batch of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, table, texts
from .tokens import default_path, encoder, slices


def cut(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The document index and the length of every piece, longest first within a document."""
    top = longest.bit_length() - 1
    counts = np.concatenate([n[:, None] >> top, n[:, None] >> np.arange(top - 1, -1, -1) & 1], axis=1)
    lengths = np.broadcast_to(1 << np.arange(top, -1, -1), counts.shape)
    doc = np.broadcast_to(np.arange(len(n))[:, None], counts.shape)
    return np.repeat(doc.ravel(), counts.ravel()), np.repeat(lengths.ravel(), counts.ravel())


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids.

    *docs* has doc_id and text; other columns are ignored.  A null or empty text has the end id alone, so one
    piece, and texts of any length are packed whole.  ids are little-endian unsigned 32-bit.  bucket is the base-2
    logarithm of length.  sequence_id is the partition's number times 2^33 plus a counter: unique, and the same when a
    lost task runs again, but another where the table is split otherwise.  *longest* is a power of two.  Other columns,
    whatever their names, are not read.  Repeated rows are packed each time; an empty table gives no rows.
    """
    if longest < 1 or longest & longest - 1:
        raise ValueError("longest must be a power of two")
    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            all_texts, doc_ids = texts(batch), column(batch, "doc_id")
            for lo, hi in slices(all_texts):
                found = enc.encode(all_texts[lo:hi])
                n = np.fromiter(map(len, found), np.int64, len(found)) // enc.dtype.itemsize + 1
                ids = np.frombuffer(end.join([*found, b""]), enc.dtype).astype("<u4")
                doc, length = cut(n, longest)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(n) - n)[doc]
                offsets = np.concatenate([[0], ends * 4]).astype("<i4")
                body = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                sequence = next_id + np.arange(len(doc))
                next_id += len(doc)
                cols = [doc_ids.slice(lo, hi - lo).take(pa.array(doc)), start, length, n[doc], sequence, np.zeros(len(doc), np.int64), np.log2(length).astype(np.int32), body]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", "ids"])

    return map_batches(src, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary", run)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store the pieces in a folder for each length, so that batches of one length are read without the others."""
    pieces.write.partitionBy("bucket").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, packed."""
    return digests(pack(table(spark, sf_dir, "documents"), default_path()))
