"""Binary token files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

The most frequent id of the corpus gets rank 0. A rank takes one to four data bytes; two control bits a
rank (four ranks a control byte) hold how many, less one. Control and data bytes stand apart, so numpy
decodes a document with one table lookup for all its lengths and one gather for each byte position.

A file (little-endian):

====================  ============================================================
4 bytes               ``VBT1``
u32, u64              documents in the file; ids of all documents before the file
documents x 21 bytes  u8 is-null, i64 doc_id, u32 ids, u64 data bytes
control bytes         each document's own, ceil(ids / 4)
data bytes            each document's own
``\\n``                end of file
====================  ============================================================

``ranks`` beside the files is one such folder with a single file: u32 ids by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.packing import tokenised, widened
from ledgerlake.llm.shared import freed, new_path, written

MAGIC = b"VBT1"
END_ID = 0
#: A shard is sorted by one task and makes files of its own: between these many ids, and no more shards than MOST_SHARDS below the upper bound.
LEAST_SHARD_IDS, SHARD_IDS, MOST_SHARDS = 4_000_000, 64_000_000, 10_000
FILE_BYTES = 64 << 20
#: Documents, and ids, that are coded or decoded at a time.
BATCH, SLICE_IDS = 256, 1 << 18
_ENTRY = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("n", "<u4"), ("bytes", "<u8")])
#: For each control byte, the data bytes of its four ranks.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def _slots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each document's slots, each rank's slot): a document starts at a new control byte, so at a multiple of four."""
    room = -(-counts // 4) * 4
    first = np.cumsum(room) - room
    kind = np.int32 if room.sum() < 1 << 31 else np.int64
    return first, np.repeat((first - (np.cumsum(counts) - counts)).astype(kind), counts) + np.arange(counts.sum(), dtype=kind)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(control bytes, data bytes) of each document; ``ranks`` (unsigned, 32 bits) are those of all, ``counts`` says how many each has."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    first, slot = _slots(counts)
    padded = np.zeros(int((-(-counts // 4) * 4).sum()), dtype=np.uint8)
    padded[slot] = extra
    four = padded.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
    spread = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = spread[np.arange(4, dtype=np.uint8) <= extra[:, None]].tobytes()
    data_ends = np.cumsum(np.r_[0, extra + np.int64(1)])[np.cumsum(np.r_[0, counts])].tolist()
    control_ends = [*(first // 4).tolist(), len(control)]
    cut = lambda x, ends: [x[i:j] for i, j in zip(ends, ends[1:])]
    return cut(control, control_ends), cut(data, data_ends)


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents that ``pack`` made the joined ``control`` and ``data`` (of bytes) from."""
    lengths = LENGTHS[control].reshape(-1)[_slots(counts)[1]]
    starts = np.cumsum(lengths, dtype=np.int32 if len(data) < 1 << 31 else np.int64) - lengths
    ranks = data[starts].astype("<u4")
    for k in range(1, 4):
        longer = np.nonzero(lengths > k)[0]
        if not len(longer):
            break
        ranks[longer] |= data[starts[longer] + k].astype("<u4") << np.uint32(8 * k)
    return ranks


def _write(contents: DataFrame, path: str, compression: str = "none") -> None:
    """One file for each row of ``contents`` (content: binary), in any file system of Spark; each ends with a line feed."""
    lines = contents.select(F.col("content").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def _joined(widths: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all documents, how many each has)."""
    widths = widths.to_numpy()
    if len(widths) and (widths == widths[0]).all():  # then the ids lie side by side
        ends = np.frombuffer(ids.buffers()[1], dtype="<i4")[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        return widened(int(widths[0]), ids.buffers()[2][int(ends[0]) : int(ends[-1])]), np.diff(ends) // int(widths[0])
    each = [widened(int(w), d.as_buffer()) for w, d in zip(widths, ids)]
    return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids by rank: all ids that ``tokens`` holds, by falling count, ties to the smaller id. As many as the vocabulary at most."""

    def count(batches):
        sums = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                found = np.bincount(_joined(*batch.slice(i, BATCH).columns)[0])
                if len(found) > len(sums):
                    found, sums = sums, found
                sums[: len(found)] += found
        ids = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums[ids], pa.int64())], ["id", "n"])

    counts = tokens.select("width", "ids").mapInArrow(freed(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return found["id"].to_numpy().astype("<u4")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all ``docs`` to files below ``path``, in ascending order of doc_id.

    A null text counts as empty; each document ends with ``end_id``. Null doc_ids come first; rows that
    repeat a doc_id follow one another by their ids' bytes. Every document is tokenised once.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer, end_id, id_col, text_col, remember=True), "tokens")
    ids = frequency_ranks(tokens)
    by_rank = spark.createDataFrame([(bytearray(ids.tobytes()),)], "content binary")
    _write(by_rank, f"{path}/ranks")
    ranks = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype="<u4")
    ranks[ids] = np.arange(len(ids), dtype="<u4")

    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // min(SHARD_IDS, max(LEAST_SHARD_IDS, total // MOST_SHARDS))))
    cuts = [i / shards for i in range(1, shards)]
    lowest = -(1 << 63)  # null ids come first
    found = tokens.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(lowest)), F.array(*map(F.lit, cuts)), F.lit(max(10_000, 20 * shards)))).first()[0] if cuts else []
    bounds = np.array(found or [], dtype=np.int64)

    def shard_of(docs: pa.Array, chunks: pa.Array, before: pa.Array) -> np.ndarray:
        """Shards by doc_id; the rows of one id that fills several shards are dealt to these by their place in the first pass."""
        ids = docs.fill_null(lowest).to_numpy()
        low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
        return (low + (chunks.to_numpy() + before.to_numpy()) % np.maximum(high - low, 1)).astype(np.int32)

    def sum_up(batches):
        sums = np.zeros(shards, dtype=np.int64)
        for batch in batches:
            np.add.at(sums, shard_of(*batch.columns[:3]), batch.column(3).to_numpy())
        held = np.nonzero(sums)[0].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["shard", "total"])

    totals = tokens.select("doc_id", "chunk", "before", "n_tokens").mapInArrow(freed(sum_up), "shard int, total long").groupBy("shard").agg(F.sum("total").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))

    def code(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                ids, counts = _joined(part.column(4), part.column(5))
                control, data = pack(ranks[ids], counts)
                columns = [pa.array(shard_of(*part.columns[:3])), part.column(0), part.column(3), pa.array(control, pa.binary()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "n_tokens", "control", "data"])

    coded = tokens.select("doc_id", "chunk", "before", "n_tokens", "width", "ids").mapInArrow(freed(code), "shard int, doc_id long, n_tokens long, control binary, data binary")
    ordered = coded.repartitionById(shards, F.col("shard")).join(F.broadcast(bases), "shard")  # one row for each shard
    ordered = ordered.select("doc_id", "n_tokens", "control", "data", "base").sortWithinPartitions("doc_id", "n_tokens", "data")

    def assemble(batches):
        entries, controls, datas, size, start, at = [], [], [], 0, None, None

        def file():
            table = np.array(entries, dtype=_ENTRY)
            head = MAGIC + len(entries).to_bytes(4, "little") + start.to_bytes(8, "little")
            return pa.RecordBatch.from_arrays([pa.array([head + table.tobytes() + b"".join(controls) + b"".join(datas)], pa.binary())], ["content"])

        for batch in batches:
            for doc, n, control, data, base in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None:
                    start = at = base
                entries.append((doc is None, doc or 0, n, len(data)))
                controls.append(control)
                datas.append(data)
                size, at = size + len(control) + len(data), at + n
                if size >= FILE_BYTES:
                    yield file()
                    entries, controls, datas, size, start = [], [], [], 0, at
        if entries:
            yield file()

    _write(ordered.mapInArrow(freed(assemble), "content binary"), f"{path}/files")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the files below ``path``; ids are little-endian unsigned 32-bit integers."""
    by_rank = np.frombuffer(_contents(spark, f"{path}/ranks").first()[0][:-1], dtype="<u4")

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = np.frombuffer(content.as_buffer(), dtype=np.uint8)
                if not len(raw):  # the one file that Spark writes for no rows
                    continue
                if raw[:4].tobytes() != MAGIC:
                    raise ValueError("not a token file")
                n_docs, start = int(raw[4:8].view("<u4")[0]), int(raw[8:16].view("<u8")[0])
                entries = raw[16 : 16 + n_docs * _ENTRY.itemsize].view(_ENTRY)
                counts = entries["n"].astype(np.int64)
                ends = np.cumsum(np.r_[0, counts])
                control_ends = 16 + entries.nbytes + np.cumsum(np.r_[0, -(-counts // 4)])
                data_ends = int(control_ends[-1]) + np.cumsum(np.r_[0, entries["bytes"].astype(np.int64)])
                i = 0
                while i < n_docs:  # some documents at a time, however many a file holds
                    j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_IDS, side="right")) - 1)
                    own = counts[i:j]
                    ids = by_rank[unpack(raw[control_ends[i] : control_ends[j]], raw[data_ends[i] : data_ends[j]], own)].tobytes()
                    places = (4 * (ends[i : j + 1] - ends[i])).tolist()
                    docs = pa.array(entries["doc_id"][i:j], pa.int64(), mask=entries["null"][i:j].astype(bool))
                    cut = pa.array([ids[x:y] for x, y in zip(places, places[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([docs, pa.array(start + ends[i:j]), pa.array(own), cut], ["doc_id", "start", "n_tokens", "ids"])
                    i = j

    return _contents(spark, f"{path}/files").mapInArrow(freed(parse), "doc_id long, start long, n_tokens long, ids binary")


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read`` with ids_crc32 (unsigned) in place of ids."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` to token files in the shared folder and reads them back; see ``write``, ``read`` and ``digests``."""
    path = new_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, path, end_id)
    return digests(read(docs.sparkSession, path))
