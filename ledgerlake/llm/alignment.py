"""Alignment of two tokenizers' tokens over the same bytes.

Token ends are bits of two packed bitsets, one bit a byte of text. Their AND holds the cuts that both share;
counting bits before a position (rank, by a running count of the words' bits) turns a byte into a token's
number, and listing the set bits (select) gives the cuts, so cuts become ranges of tokens of either side. A
token of the first side overlaps the second side's tokens between the ranks of its first and last byte, and
these ranges expand to links.

Corpus-wide counts of linked id pairs are joined by chunk: a chunk of documents keeps its different pairs
once, with the number of its documents that hold each, so what is shuffled is a dictionary a chunk instead of
every document's links, and the most common pair has one row a chunk. A chunk is bounded by CHUNK_LINKS and
one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import SPELT, Encoder, PieceEncoder
from ledgerlake.llm.shared import free_memory, written
from ledgerlake.llm.words import in_groups

#: Links of one chunk, but for its last document.
CHUNK_LINKS = 1 << 19


class Bits:
    """A packed bitset over the bytes of a text, with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        held = np.zeros(-(-(size + 1) // 64) * 64, dtype=bool)
        held[places] = True
        return cls(np.packbits(held, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@dataclass(frozen=True)
class Alignment:
    """The tokens of some texts side by side; a text that can't be aligned has none.

    a and b are ids, all texts' together; a_at, b_at and cut_at say how many tokens and groups stand before each
    text. Group g holds the tokens a_cut[g]:a_cut[g + 1] and b_cut[g]:b_cut[g + 1]. Token i of a is linked with
    the tokens first[i] to last[i] of b.
    """

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    cut_at: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers (of a, of b) of every link, in order of a."""
        held = self.last - self.first + 1
        of_a = np.repeat(np.arange(len(self.a)), held)
        within = np.arange(len(of_a)) - np.repeat(np.cumsum(held) - held, held)
        return of_a, np.repeat(self.first, held) + within


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many stand before each part)."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    return (np.concatenate(parts) if parts else np.zeros(0)).astype(np.int64), at


class Aligner:
    """Encodes texts by a byte-level BPE file (a, with a space before each text) and a piece model (b, which adds it), and aligns the tokens."""

    def __init__(self, byte_bpe: str, piece_model: str):
        byte_level, pieces = Encoder(byte_bpe, special=False, lead=" "), PieceEncoder(piece_model)
        self.encode_a, self.encode_b = byte_level.encode, pieces.encode
        entries = byte_level.tokenizer.get_vocab()
        printed = {chr(c): b for b, c in SPELT.items()}
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(printed[c] for c in entry) if all(c in printed for c in entry) else entry.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if pieces.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces.pieces)]
        self.width_a, self.width_b = (np.array([len(x) for x in held], dtype=np.int64) for held in (self.bytes_a, self.bytes_b))

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, Alignment]]:
        """(from, to, alignment) of some texts after others; null and empty ones, and those whose tokens don't spell a space and the text, have no tokens."""
        ids_a, ids_b = ([np.frombuffer(x, dtype="<u4") for x in encode(texts)] for encode in (self.encode_a, self.encode_b))
        for i, j in in_groups(texts):
            yield i, j, self._aligned(texts[i:j], ids_a[i:j], ids_b[i:j])

    def _aligned(self, texts: list[str | None], ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> Alignment:
        none = np.zeros(0, dtype=np.uint32)
        for n, text in enumerate(texts):
            said = b" " + (text or "").encode()
            if not text or any(b"".join(map(spelt.__getitem__, ids.tolist())) != said for spelt, ids in ((self.bytes_a, ids_a[n]), (self.bytes_b, ids_b[n]))):
                ids_a[n] = ids_b[n] = none
        (a, a_at), (b, b_at) = _joined(ids_a), _joined(ids_b)
        ends = np.cumsum(self.width_a[a])
        size = int(ends[-1]) if len(ends) else 0
        in_a, in_b = Bits.of(ends - 1, size), Bits.of(np.cumsum(self.width_b[b]) - 1, size)
        cuts = (in_a & in_b).select() + 1
        a_cut, b_cut = (np.concatenate(([0], held.rank(cuts))) for held in (in_a, in_b))
        first, last = in_b.rank(ends - self.width_a[a]), in_b.rank(ends - 1)
        return Alignment(a, b, a_at, b_at, np.searchsorted(a_cut, a_at), a_cut, b_cut, first, last)


class GroupLines:
    """Spells the groups of aligned texts: ``a1,a2|b1;a3|b2,b3``, ids in decimal."""

    def __init__(self, aligner: Aligner):
        self.base = 2 * len(aligner.bytes_a)
        self.spelt = [f"{i}{c}" for i in range(len(aligner.bytes_a)) for c in ",|"] + [f"{i}{c}" for i in range(len(aligner.bytes_b)) for c in ",;"]

    def of(self, found: Alignment) -> list[str]:
        a_last, b_last = np.zeros(len(found.a), dtype=np.int64), np.zeros(len(found.b), dtype=np.int64)
        a_last[found.a_cut[1:] - 1] = 1
        b_last[found.b_cut[1:] - 1] = 1
        order = np.empty(len(found.a) + len(found.b), dtype=np.int64)
        order[np.arange(len(found.a)) + np.repeat(found.b_cut[:-1], np.diff(found.a_cut))] = 2 * found.a + a_last
        order[np.arange(len(found.b)) + np.repeat(found.a_cut[1:], np.diff(found.b_cut))] = self.base + 2 * found.b + b_last
        parts = list(map(self.spelt.__getitem__, order.tolist()))
        at = (found.a_at + found.b_at).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip(at, at[1:])]


_aligners: dict[tuple[str, str], tuple[Aligner, GroupLines]] = {}


def _aligner(byte_bpe: str, piece_model: str) -> tuple[Aligner, GroupLines]:
    """Made once in each task of a Python worker."""
    if (byte_bpe, piece_model) not in _aligners:
        held = Aligner(byte_bpe, piece_model)
        _aligners[byte_bpe, piece_model] = held, GroupLines(held)
    return _aligners[byte_bpe, piece_model]


def _aligned(batches: Iterator[pa.RecordBatch], byte_bpe: str, piece_model: str) -> Iterator[tuple[list, Alignment, GroupLines]]:
    """(ids, alignment of their texts) of some documents after others; a long text comes alone. Memory goes back at the end."""
    aligner, lines = _aligner(byte_bpe, piece_model)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j, found in aligner.align(texts):
            yield ids[i:j], found, lines
    _aligners.clear()
    free_memory()


def align(docs: DataFrame, byte_bpe: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, a, b, a_cuts, b_cuts, first_b, last_b), one per row of ``docs``.

    a and b are the ids of a space and the text by the two tokenizers; groups end after a_cuts tokens of a and
    b_cuts of b, and token i of a overlaps the tokens first_b[i] to last_b[i] of b (from 0). All are empty where
    the text is null or empty or either side's tokens don't spell it. Strings of special tokens are plain text,
    repeated rows stay, null ids stay null, long texts are whole, other columns are ignored, no rows give none.
    """

    def run(batches):
        for ids, found, _ in _aligned(batches, byte_bpe, piece_model):
            of = lambda x, at, less=None: pa.array([(x[i:j] - (less[n] if less is not None else 0)).astype(np.int32) for n, (i, j) in enumerate(zip(at, at[1:]))], pa.list_(pa.int32()))
            columns = [pa.array(ids, pa.int64()), of(found.a, found.a_at), of(found.b, found.b_at), of(found.a_cut[1:], found.cut_at, found.a_at), of(found.b_cut[1:], found.cut_at, found.b_at), of(found.first, found.a_at, found.b_at), of(found.last, found.a_at, found.b_at)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "a_cuts", "b_cuts", "first_b", "last_b"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>, first_b array<int>, last_b array<int>")


DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long"
CHUNKS = f"chunk long, docs array<struct<{', '.join(f'{name}:{kind}' for name, kind in map(str.split, DIGESTS.split(', ')))}>>, pairs array<long>, docs_with array<long>, held binary, times binary"


def _chunk(number: int, rows: list[dict], keys: list[np.ndarray]) -> dict:
    """One row of CHUNKS: held and times are, document by document, its pairs' numbers in ``pairs`` and how many links each has."""
    counts = [r["n_links"] for r in rows]
    pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
    width = max(len(pairs), 1)
    held, times = np.unique(np.repeat(np.arange(len(rows)), counts) * width + place.ravel(), return_counts=True)
    for r, n in zip(rows, np.bincount(held // width, minlength=len(rows)).tolist()):
        r["n_pairs"] = n
    held %= width
    return {"chunk": number, "docs": rows, "pairs": pairs, "docs_with": np.bincount(held, minlength=len(pairs)), "held": held.astype("<u4").tobytes(), "times": times.astype("<u4").tobytes()}


def chunks_of_links(docs: DataFrame, byte_bpe: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows CHUNKS: the documents' alignments in numbers, with the different id pairs that are linked in the chunk."""
    most = CHUNK_LINKS
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.struct([(n, pa.string() if k == "string" else pa.int64()) for n, k in map(str.split, DIGESTS.split(", "))]))), ("pairs", pa.list_(pa.int64())), ("docs_with", pa.list_(pa.int64())), ("held", pa.binary()), ("times", pa.binary())])

    def run(batches):
        number, rows, keys, links = TaskContext.get().partitionId() << 32, [], [], 0
        for ids, found, lines in _aligned(batches, byte_bpe, piece_model):
            of_a, of_b = found.links()
            key = found.a[of_a] << 32 | found.b[of_b]
            ends = np.concatenate(([0], np.cumsum(found.last - found.first + 1)))[found.a_at].tolist()
            sizes = zip(np.diff(found.a_at).tolist(), np.diff(found.b_at).tolist(), np.diff(found.cut_at).tolist())
            for n, (doc, line, (n_a, n_b, n_groups)) in enumerate(zip(ids, lines.of(found), sizes)):
                said = hashlib.sha256(line.encode()).hexdigest() if n_a else ""
                rows.append({"doc_id": doc, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": ends[n + 1] - ends[n], "groups_sha256": said})
                keys.append(key[ends[n] : ends[n + 1]])
                links += len(keys[-1])
                if links >= most:
                    yield pa.RecordBatch.from_pylist([_chunk(number, rows, keys)], schema)
                    number, rows, keys, links = number + 1, [], [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([_chunk(number, rows, keys)], schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Rows (pair, a, count, best) of CHUNKS: in how many documents each pair is linked, and whether no pair of its a has more; a pair is a's id above b's 32 bits."""
    pairs = chunks.select(F.explode(F.arrays_zip("pairs", "docs_with")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs_with").alias("count"))
    counts = written(pairs.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "a", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_statistics(docs: DataFrame, byte_bpe: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per row of ``docs``.

    A pair's count is the number of rows of ``docs`` in which the two ids are linked. n_best counts the links
    whose pair has the highest count of its a (ties included), count_sum adds up the links' counts. Rows without
    an alignment (see ``align``) have zeros and an empty groups_sha256; other cases are as there.
    """
    chunks = written(chunks_of_links(docs, byte_bpe, piece_model, id_col, text_col), "aligned-chunks")
    counted = written(pair_counts(chunks), "pair-ranks").select("pair", "count", "best")
    places = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair")).join(counted, "pair")
    known = places.groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))  # one for each pair of a chunk
    known = known.select("chunk", "known.place", "known.count", "known.best")
    rows = chunks.select("chunk", "docs", "held", "times").join(known, "chunk", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in ("docs", "held", "times", "place", "count", "best")}
                found = pa.RecordBatch.from_struct_array(row["docs"].values)
                ends = np.concatenate(([0], np.cumsum(found.column("n_pairs").to_numpy())))
                sums = np.zeros((2, len(ends)), dtype=np.int64)
                if ends[-1]:
                    place = row["place"].values.to_numpy()
                    counts, best = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
                    counts[place], best[place] = row["count"].values.to_numpy(), row["best"].values.to_numpy(zero_copy_only=False)
                    held, times = (np.frombuffer(row[c].as_py(), dtype="<u4").astype(np.int64) for c in ("held", "times"))
                    for i, each in enumerate((best, counts)):
                        sums[i] = np.concatenate(([0], np.cumsum(times * each[held])))[ends]
                n_best, count_sum = (pa.array(np.diff(x)) for x in sums)
                columns = {"n_best": n_best, "count_sum": count_sum}
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else found.column(c) for c in names], names)
        free_memory()

    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names))
