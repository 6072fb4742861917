"""Concatenate and cut: documents' tokens in one long stream, cut into windows of a fixed length.

First pass: every task tokenises its documents once and writes, for each, its chunk (the task), the ids
before it in that chunk and the ids themselves. The chunk totals then give each chunk's place in the
stream (a prefix sum over one row for each task), and with that every document's. Second pass: each
document's ids are cut at multiples of the window; a document that crosses one yields a boundary record
on either side, so no id moves between tasks and no sequence is padded but the last.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ledgerlake.llm.bpe import encoder, forget
from ledgerlake.llm.shared import freed, written

WINDOW = 2048
END_ID = 1
_TOKENS = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
BATCH = 2048


def narrowed(texts: list[bytes]) -> tuple[int, list[int], list[bytes]]:
    """Texts' ids of four bytes in two where all fit: (bytes an id, ids of each text, data of each)."""
    counts = [len(x) // 4 for x in texts]
    values = np.frombuffer(b"".join(texts), dtype="<u4")
    if len(values) and values.max() >= 1 << 16:
        return 4, counts, texts
    data, ends = values.astype("<u2").tobytes(), [0, *(2 * np.cumsum(counts)).tolist()]
    return 2, counts, [data[i:j] for i, j in zip(ends, ends[1:])]


def widened(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if width == 2 else "<u4").astype("<u4")


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", remember: bool = False) -> DataFrame:
    """Rows (doc_id, chunk, before, n_tokens, width, ids), one per row of ``docs``; ids end with ``end_id``. With ``remember`` a worker keeps its encoder for its next task."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode, chunk, before = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                width, counts, data = narrowed([x + end for x in encode(part.column(1).to_pylist())])
                ends = before + np.cumsum(counts)
                columns = (part.column(0), [chunk] * len(counts), ends - counts, counts, [width] * len(counts), data)
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOKENS)], schema=_TOKENS)
        if not remember:
            forget()

    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(freed(run), "doc_id long, chunk int, before long, n_tokens long, width int, ids binary")


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): the pieces of all documents.

    Every row of ``docs`` is tokenised (a null text as an empty one) and gets ``end_id``; each id lies in
    exactly one piece. sequence_id counts windows of the whole stream from 0; offset is the piece's place
    in its sequence. ids are little-endian unsigned 32-bit integers. Rows with a repeated or null doc_id are
    packed like others. Documents keep the order in which Spark's tasks read them. No rows give no pieces.
    """
    tokens = written(tokenised(docs, tokenizer, end_id, id_col, text_col), "tokens")
    totals = tokens.groupBy("chunk").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("chunk", (F.sum("total").over(Window.orderBy("chunk")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(bases), "chunk")  # one row for each task of the first pass
    placed = placed.select("doc_id", (F.col("base") + F.col("before")).alias("place"), "width", "ids")

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                rows = []
                for doc, place, width, data in zip(*(c.to_pylist() for c in batch.slice(i, BATCH).columns)):
                    ids = widened(width, data)
                    at = 0
                    while at < len(ids):
                        offset = (place + at) % window
                        part = ids[at : at + window - offset].tobytes()
                        rows.append((doc, at, len(part) // 4, zlib.crc32(part), len(ids), (place + at) // window, offset, part))
                        at += len(part) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return placed.mapInArrow(freed(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(parts: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Rows (sequence_id, n_tokens, ids): the sequences that ``parts`` (of ``pieces``) make up, padded with ``pad_id``.

    A group holds ``window`` ids at most. A last sequence whose length is a power of two stays as it is.
    """
    grouped = parts.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    power = F.bit_count("n_tokens") == 1
    pad = F.lit(np.array([pad_id], dtype="<u4").tobytes())
    length = F.when(power, F.col("n_tokens")).otherwise(F.lit(window))
    padding = F.unhex(F.repeat(F.hex(pad), (length - F.col("n_tokens")).cast("int")))
    return grouped.select("sequence_id", "n_tokens", F.concat(joined, padding).alias("ids"))
