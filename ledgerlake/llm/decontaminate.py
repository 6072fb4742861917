"""Benchmark decontamination by latent semantic retrieval, with an exact way for what it can't see.

Only words of the benchmark can make a passage like a benchmark item, so every document becomes a sequence of
numbers of the benchmark's words (-1 for other words), once. Document frequencies and the randomised SVD of the
TF-IDF passages cover all documents: with Gaussian test vectors O the sum of a (a O) over passages a is one
distributed pass, and the leading directions follow from that and O alone (Nystroem). Every window of every
document is compared with every item by cosine in that latent space; a window near an item is a candidate.

A cosine can hide a passage that the check would accept: other heavy words beside a copy turn the window away
from it. So windows are also nominated by an exact bound. A passage that holds PARAPHRASE of an item's words
misses at most the rest, so of any so many words plus m it holds m: with the item's rarest words as anchors few
windows do. No passage that the check accepts is without its anchors. The check itself decides for candidates
of either kind: the longest common subsequence of words, and the item's answer (its last sentence) where
the wording was changed.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.shared import freed, written
from ledgerlake.llm.words import in_groups, word_hashes

RANK = 48
#: Words in a larger share of the documents say nothing about a passage in the latent space.
COMMON = 0.1
PASSAGE = 32
#: Windows start at multiples of so many words.
STRIDE = 8
#: A copy or paraphrase may spread over so many times the item's words.
SPREAD = 1.5
COSINE = 0.8
SIMILARITY = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8
#: One anchor for so many words that a passage must hold.
ANCHOR_WORDS = 4
#: Documents are compared together until they have so many words.
BATCH_WORDS = 1 << 16
#: Benchmark items are searched in groups of this size, so that what a task holds of them is bounded.
ITEM_GROUP = 5_000
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")


@dataclass(frozen=True)
class Items:
    """Benchmark items as word numbers: ids, their words and their answers' words; hashes[i] is the word numbered i, rising."""

    hashes: np.ndarray
    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]


def read_items(rows: list[tuple[int, str | None]]) -> Items:
    """Items with at least one word; the answer is the last sentence that has a word."""
    ids, words, answers = [], [], []
    for item, text in rows:
        own = word_hashes([text])[0]
        if len(own):
            ids.append(item)
            words.append(own)
            answers.append(next(s for s in (word_hashes([s])[0] for s in reversed(_SENTENCE.split(text))) if len(s)))
    hashes = np.unique(np.concatenate(words)) if words else np.zeros(0, dtype=np.uint64)
    number = lambda x: np.searchsorted(hashes, x).astype(np.int32)
    return Items(hashes, ids, [number(w) for w in words], [number(a) for a in answers])


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, by bit-parallel rows over ``a``."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def numbered(docs: DataFrame, hashes: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, words: int32 numbers as binary) for documents that hold a word of ``hashes`` (rising)."""
    kind = np.dtype(np.int16 if len(hashes) < 1 << 15 else np.int32)

    def run(batches):
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in in_groups(texts):
                found, counts = word_hashes(texts[i:j])
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                numbers = np.where(hashes[at] == found, at, -1).astype(kind)
                ends = np.cumsum(counts)
                held = np.concatenate(([0], np.cumsum(numbers >= 0)))[ends]
                kept = np.nonzero(np.diff(held, prepend=0))[0]
                data = [numbers[e - n : e].tobytes() for e, n in zip(ends[kept].tolist(), counts[kept].tolist())]
                yield pa.RecordBatch.from_arrays([docs.slice(i, j - i).take(pa.array(kept)), pa.array(data, pa.binary()), pa.array([kind.itemsize] * len(kept), pa.int32())], ["doc_id", "words", "width"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, words binary, width int")


def _arrays(batch) -> list[np.ndarray]:
    column, width = batch.column(batch.schema.get_field_index("words")), batch.column(batch.schema.get_field_index("width"))
    return [np.frombuffer(x.as_buffer(), dtype=np.int16 if w == 2 else np.int32) for x, w in zip(column, width.to_pylist())]


def _in_batches(arrays: list[np.ndarray], spare: int = 0):
    """(from, to) of consecutive documents of about BATCH_WORDS words together, ``spare`` for each document counted."""
    start, held = 0, 0
    for i, a in enumerate(arrays):
        if held and held + len(a) + spare > BATCH_WORDS:
            yield start, i
            start, held = i, 0
        held += len(a) + spare
    if start < len(arrays):
        yield start, len(arrays)


def document_frequencies(sequences: DataFrame, size: int) -> np.ndarray:
    """How many of all documents hold each word number."""

    def run(batches):
        found = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for words in _arrays(batch):
                seen = np.zeros(size + 1, dtype=bool)
                seen[words] = True  # -1 marks the last place
                found += seen[:-1]
        at = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], ["word", "n"])

    counts = sequences.select("words", "width").mapInArrow(freed(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()  # words of one group of items
    n = np.zeros(size, dtype=np.int64)
    n[counts["word"].to_numpy(dtype=int)] = counts["n"]
    return n


def inverse_frequencies(n: np.ndarray, documents: int) -> np.ndarray:
    """log((1 + documents) / (1 + n)); 0 for common words."""
    return np.where(n > COMMON * documents, 0.0, np.log((1 + documents) / (1 + n))).astype(np.float32)


def _sums(words: np.ndarray, rows: np.ndarray, n_rows: int, table: np.ndarray) -> np.ndarray:
    """For each row the sum of ``table[word]`` over its words (rows rising)."""
    out = np.zeros((n_rows, table.shape[1]), dtype=np.float32)
    if len(words):
        starts = np.nonzero(np.r_[True, rows[1:] != rows[:-1]])[0]
        out[rows[starts]] = np.add.reduceat(table[words], starts, axis=0)
    return out


def latent_directions(sequences: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The leading directions [word, rank] of the TF-IDF passages (PASSAGE words each) of all documents."""
    size = len(idf)
    rank = min(rank, size)
    test = np.random.default_rng(seed).standard_normal((size, rank)).astype(np.float32)
    table = idf[:, None] * test

    def run(batches):
        total = np.zeros((size, rank), dtype=np.float64)
        for batch in batches:
            arrays = _arrays(batch)
            for i, j in _in_batches(arrays):
                part = arrays[i:j]
                first = np.cumsum([0, *(-(-len(a) // PASSAGE) for a in part)])
                words = np.concatenate(part)
                starts = np.cumsum([0, *map(len, part)])
                known = np.nonzero((words >= 0) & (idf[words] > 0))[0]
                doc = np.searchsorted(starts, known, side="right") - 1
                rows, words = (known - starts[doc]) // PASSAGE + first[doc], words[known]
                projected = _sums(words, rows, int(first[-1]), table)
                order = np.argsort(words, kind="stable")
                words, rows = words[order], rows[order]
                if len(words):
                    starts = np.nonzero(np.r_[True, words[1:] != words[:-1]])[0]
                    total[words[starts]] += np.add.reduceat(projected[rows], starts, axis=0) * idf[words[starts], None]
        at = np.nonzero(np.abs(total).sum(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["word", "row"])

    parts = sequences.select("words", "width").mapInArrow(freed(run), "word long, row array<double>")
    sums = parts.groupBy("word").agg(F.array(*(F.sum(F.col("row")[i]) for i in range(rank))).alias("row")).toPandas()  # words of one group of items
    y = np.zeros((size, rank))
    for word, row in zip(sums["word"], sums["row"]):
        y[word] = row
    values, vectors = np.linalg.eigh((test.T @ y + y.T @ test) / 2)
    kept = values > max(values.max(initial=0.0), 1e-12) * 1e-9
    half = y @ (vectors[:, kept] / np.sqrt(values[kept]))
    left = np.linalg.svd(half, full_matrices=False)[0] if kept.any() else y[:, :0]
    return left.astype(np.float32)


@dataclass(frozen=True)
class Anchors:
    """The anchors' postings by word number (items[first[w]:first[w + 1]]), how many anchors each item's window must hold, and its window in blocks."""

    first: np.ndarray
    items: np.ndarray
    least: np.ndarray
    blocks: np.ndarray


def choose_anchors(items: Items, frequency: np.ndarray) -> Anchors:
    """An item's rarest words: as many as a passage may miss, and one more for each ANCHOR_WORDS words it must hold."""
    need = [math.ceil(PARAPHRASE * len(w) - 1e-9) for w in items.words]
    least = np.array([max(1, n // ANCHOR_WORDS) for n in need], dtype=np.int64)
    chosen = [np.unique(w[np.lexsort((w, frequency[w]))[: len(w) - n + m]]) for w, n, m in zip(items.words, need, least.tolist())]
    words, owner = np.concatenate(chosen), np.repeat(np.arange(len(chosen)), list(map(len, chosen)))
    order = np.argsort(words, kind="stable")
    first = np.searchsorted(words[order], np.arange(len(items.hashes) + 1))
    blocks = np.array([-(-math.ceil(SPREAD * len(w)) // STRIDE) + 1 for w in items.words], dtype=np.int64)  # holds such a passage wherever it starts
    return Anchors(first, owner[order], least, blocks)


def anchored(words: np.ndarray, places: np.ndarray, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """(first block, item) of windows that hold the anchors they must; ``places`` of ``words`` rise."""
    known = words >= 0
    words, places = words[known], places[known]
    n = anchors.first[words + 1] - anchors.first[words]
    ends = np.cumsum(n)
    if not len(n) or not ends[-1]:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    item = anchors.items[np.repeat(anchors.first[words] - (ends - n), n) + np.arange(ends[-1])]
    at = np.repeat(places, n)
    order = np.argsort(item, kind="stable")  # by item, then by place
    item, at = item[order], at[order]
    last = np.arange(len(item)) + anchors.least[item] - 1
    inside = last < len(item)
    begin = np.nonzero(inside)[0]
    last = last[begin]
    same = (item[last] == item[begin]) & (at[last] // STRIDE - at[begin] // STRIDE < anchors.blocks[item[begin]])
    begin, last = begin[same], last[same]
    low = np.maximum(at[last] // STRIDE - anchors.blocks[item[begin]] + 1, 0)  # the windows that hold both ends of the run
    n = at[begin] // STRIDE - low + 1
    ends = np.cumsum(n)
    if not len(n):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    block = np.repeat(low - (ends - n), n) + np.arange(ends[-1])
    pairs = np.unique(block * len(anchors.least) + np.repeat(item[begin], n))
    return pairs // len(anchors.least), pairs % len(anchors.least)


def _verified(item: np.ndarray, answer: np.ndarray, text: np.ndarray) -> float:
    """The share of the item's words in a common subsequence with ``text``; 0 if it's no copy or paraphrase."""
    share = lcs_length(item, text) / len(item)
    if share >= SIMILARITY:
        return share
    if share >= PARAPHRASE and lcs_length(answer, text) / len(answer) >= ANSWER:
        return share
    return 0.0


def search(sequences: DataFrame, items: Items, idf: np.ndarray, directions: np.ndarray, frequency: np.ndarray) -> DataFrame:
    """Rows (doc_id, item_id, similarity) of verified pairs: every window of every document against every item."""
    table = idf[:, None] * directions
    anchors = choose_anchors(items, frequency)
    latent = np.stack([table[w].sum(axis=0) for w in items.words])
    norms = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = latent / np.where(norms > 1e-6, norms, 1)
    sought = {int(b): np.nonzero(anchors.blocks == b)[0] for b in np.unique(anchors.blocks)}
    widest = int(anchors.blocks.max())
    sets = [frozenset(w.tolist()) for w in items.words]

    def near(words: np.ndarray, places: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(first block, item) of windows whose latent vector is near an item's."""
        known = np.nonzero(words >= 0)[0]
        known = known[idf[words[known]] > 0]
        by_block = _sums(words[known], places[known] // STRIDE, n_blocks, table)
        rolled = np.concatenate((np.zeros((1, by_block.shape[1]), np.float32), np.cumsum(by_block, axis=0)))
        at, of = [], []
        for wide, members in sought.items():
            window = rolled[wide:] - rolled[:-wide]
            length = np.sqrt(np.einsum("ij,ij->i", window, window))
            window /= np.maximum(length, 1e-3)[:, None]
            for i in range(0, len(members), 512):
                block, member = np.nonzero(window @ latent[members[i : i + 512]].T >= COSINE)
                at.append(block)
                of.append(members[i : i + 512][member])
        return np.concatenate(at), np.concatenate(of)

    def pairs_of(texts: list[np.ndarray]) -> dict[tuple[int, int], float]:
        """(document, item) to similarity. Documents stand in one row of blocks, with empty ones between that no window can span."""
        first = np.cumsum([0, *(-(-len(t) // STRIDE) + widest for t in texts)])
        starts = np.cumsum([0, *map(len, texts)])
        words = np.concatenate(texts).astype(np.int32)
        places = np.arange(len(words)) + np.repeat(first[:-1] * STRIDE - starts[:-1], np.diff(starts))
        found = [anchored(words, places, anchors), near(words, places, int(first[-1]))]
        pairs = np.unique(np.concatenate([b * len(sets) + i for b, i in found]))
        best: dict[tuple[int, int], float] = {}
        in_doc = np.searchsorted(first, pairs // len(sets), side="right") - 1
        for block, item, doc in zip((pairs // len(sets)).tolist(), (pairs % len(sets)).tolist(), in_doc.tolist()):
            at = (block - int(first[doc])) * STRIDE
            text = texts[doc][at : at + int(anchors.blocks[item]) * STRIDE]
            if len(sets[item].intersection(text.tolist())) >= len(sets[item]) - (1 - PARAPHRASE) * len(items.words[item]) - 1e-9:
                share = _verified(items.words[item], items.answers[item], text)
                if share > best.get((doc, item), 0.0):
                    best[doc, item] = share
        return best

    def run(batches):
        for batch in batches:
            ids, arrays = batch.column(0).to_pylist(), _arrays(batch)
            docs, found_items, shares = [], [], []
            for i, j in _in_batches(arrays, widest * STRIDE):
                for (d, item), share in pairs_of(arrays[i:j]).items():
                    docs.append(ids[i + d])
                    found_items.append(items.ids[item])
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found_items, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "item_id", "similarity"])

    return sequences.select("doc_id", "words", "width").mapInArrow(freed(run), "doc_id long, item_id long, similarity double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, similarity): documents that hold a benchmark item, or a close paraphrase of one.

    similarity is the share of the item's words in order in a passage of the document of up to SPREAD times its
    words: SIMILARITY or more, or PARAPHRASE or more if the passage also holds ANSWER of the item's last sentence.
    Every such pair is found. Letter case, punctuation and white space don't count. Items and documents that are
    null or without words match nothing; repeated rows of either are compared like others, null ids included;
    an item's pair comes once for each row of the document. Other columns are ignored. No rows give no pairs.
    """
    spark = docs.sparkSession
    asked = written(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")), "items")
    groups = max(1, -(-asked.count() // ITEM_GROUP))
    documents = docs.count()
    found = None
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).orderBy("item_id", "text").collect()
        items = read_items([(r["item_id"], r["text"]) for r in rows])
        if not items.ids:
            continue
        sequences = written(numbered(docs, items.hashes, id_col, text_col), "sequences")
        frequency = document_frequencies(sequences, len(items.hashes))
        idf = inverse_frequencies(frequency, documents)
        part = search(sequences, items, idf, latent_directions(sequences, idf), frequency)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, similarity double")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (with a column text) without the rows whose text ``contaminated`` finds, whole.

    Texts are told apart by their 64-bit hash, so rows with null or repeated doc_ids are judged by their own text.
    Rows with a null text stay.
    """
    texts = docs.select(F.xxhash64("text").alias("key"), "text").where("text is not null")
    found = written(contaminated(texts, benchmark, id_col="key").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return docs.join(found, F.xxhash64(docs["text"]) == found["key"], "left_anti")
