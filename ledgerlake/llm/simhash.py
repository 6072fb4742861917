"""SimHash near-duplicates, found through deletion-variant signatures.

A fingerprint has 64 bits. Of three segments (22, 21 and 21 bits) at least one differs by at most one bit
when two fingerprints differ in at most five (REACH), since six differences are needed to put two into each.
The index holds, for each fingerprint and each of its 64 bits, the bit's segment with that bit left out:
two segments that differ by at most one bit share such a variant. An equality join on variants therefore
proposes every pair within reach, and the exact distance decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm import jaccard
from ledgerlake.llm.graph import components, meeting, meeting_pairs
from ledgerlake.llm.shared import freed, whole_row, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
#: So many differing bits leave a segment with one of them at most.
REACH = 2 * len(SEGMENTS) - 1
#: Fingerprints of sets at a similarity of 0.8 differ in about so many bits.
SIMILAR_BITS = 10
SEED = 42


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of unsigned 64-bit hashes: a bit is 1 if set in over half of them; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The signed 64-bit SimHash of a UTF-8 text; 0 without words."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (doc_id, fp), one per row of ``docs``; a null text has fingerprint zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(freed(run), "doc_id long, fp long")


def _mask(start: int, length: int) -> int:
    value = ((1 << length) - 1) << start
    return value - (1 << 64) if value >> 63 else value


def _distance(a: str, b: str, mask: int = -1) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(mask)))


def _segments(fp: str = "fp") -> Column:
    """The three whole segments of a fingerprint as keys."""
    return F.array(*(F.col(fp).bitwiseAND(F.lit(_mask(i, n))) for i, n in SEGMENTS))


def _variants(rows: DataFrame) -> DataFrame:
    """``rows`` 64 times, with (bit, key): the segment of that bit with the bit left out, and the bit's number above it."""
    start = F.array(*(F.lit(i) for i, n in SEGMENTS for _ in range(n)))
    kept = []
    for i, n in SEGMENTS:
        for b in range(i, i + n):
            left = _mask(i, n) & ((1 << 64) - 1) & ~(1 << b)
            kept.append(F.lit(left - (1 << 64) if left >> 63 else left))
    spread = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    value = F.expr("shiftrightunsigned(part, start)")
    spread = spread.withColumn("part", F.col("fp").bitwiseAND(F.element_at(F.array(*kept), F.col("bit") + 1))).withColumn("start", F.element_at(start, F.col("bit") + 1))
    return spread.withColumn("key", value.bitwiseOR(F.shiftleft(F.col("bit").cast("long"), 32))).drop("part", "start")


def _first_shared_variant() -> Column:
    """Whether ``bit`` names the first variant that fp and fp_b share; each pair then comes once from all its variants."""
    first = F.lit(False)
    earlier = F.lit(True)
    for i, n in SEGMENTS:
        differ = _distance("fp", "fp_b", _mask(i, n))
        here = F.col("bit").between(i, i + n - 1)
        first = first | (here & earlier & ((differ == 1) | (F.col("bit") == i)))
        earlier = earlier & (differ >= 2)
    return first


def star_pairs(rows: DataFrame, max_bits: int = SIMILAR_BITS) -> DataFrame:
    """Pairs of ``rows`` (node, root, fp) within ``max_bits``: each row with the smallest node of its whole segments, where that has another root.

    Columns come as they are and with _b. At most three pairs a row, so dense groups are contracted in linear work.
    """
    whole = rows.select("*", F.posexplode(_segments()).alias("segment", "key"))
    pivots = whole.groupBy("segment", "key").agg(F.min(F.struct("node", "root", "fp")).alias("least"), F.count("*").alias("n")).where("n > 1")
    pivots = pivots.select("segment", "key", *(F.col(f"least.{c}").alias(f"{c}_b") for c in ("node", "root", "fp")))
    return whole.join(pivots, ["segment", "key"]).where((F.col("root") != F.col("root_b")) & (_distance("fp", "fp_b") <= max_bits))


def variant_pairs(rows: DataFrame, max_bits: int = SIMILAR_BITS) -> DataFrame:
    """Pairs of ``rows`` (root, fp and others) within ``max_bits`` that share a variant, under different roots, each once.

    Up to REACH that is every pair. Columns come as they are and with _b. Variants under one root only are left
    out of the join, and those of many rows meet block by block.
    """
    shared = written(meeting(_variants(rows)), "variants")
    payload = [c for c in rows.columns if c != "root"]
    return meeting_pairs(shared, (_distance("fp", "fp_b") <= max_bits) & _first_shared_variant(), [*payload, "bit"])  # only verified pairs leave the join


def linked_classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (fp, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp).

    Equal fingerprints form a class first, so copies never meet in a join. Before pairs are sought, each
    class is compared with the smallest class that shares a whole segment: that contracts dense groups in
    linear work. Pairs are then sought between different components only, so a dense group isn't spelt out
    pair by pair; every pair within reach that isn't already connected is found, once.
    """
    if max_bits > REACH:
        raise ValueError(f"{len(SEGMENTS)} segments prove pairs of up to {REACH} bits only")
    classes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    stars = star_pairs(classes.select(F.col("rep").alias("node"), F.col("rep").alias("root"), "fp"), max_bits)
    roots = components(stars.select(F.col("root").alias("a"), F.col("root_b").alias("b")))
    contracted = written(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("root")), "contracted")
    pairs = variant_pairs(contracted, max_bits)
    merged = components(pairs.select(F.col("root").alias("a"), F.col("root_b").alias("b")))
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return contracted.join(merged, "root", "left").select("fp", F.coalesce("top", "root").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` bits. A null or empty
    text has fingerprint zero and links like any other. A row whose doc_id is null gets the component of
    its fingerprint but joins nothing itself. Repeated rows stay; other columns of ``docs`` are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(linked_classes(prints, max_bits), "fp-components")
    joined = prints.join(classes, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = jaccard.SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text) without near-duplicates: of each component the row with the smallest doc_id stays, whole.

    Texts are linked by the Jaccard similarity of their word shingles, every pair of ``similarity`` or more. The
    fingerprints of all sets of shingles are indexed by deletion variants: stars over whole segments contract
    dense groups, then the join on variants proposes every pair within REACH and, up to SIMILAR_BITS, those that
    share a variant; whole sets decide. Fingerprints can't see every similar pair, so the rest is sought among
    the sets that they have left apart (``jaccard``).
    Of rows that repeat that doc_id the one with the smallest text stays (null first). Rows with a null doc_id
    stay. Columns of any name stay as they are. No rows give none.
    """
    found = jaccard.similar_documents(docs, majority, (star_pairs, variant_pairs), shingle, similarity)
    best = written(found.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct(), "kept")
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("words"), whole_row(docs))
    kept = rows.join(best, rows["id"] == best["kept"], "left_semi")
    first = kept.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("words"))).where("at = 1")
    return first.select("row").unionByName(rows.where("id is null").select("row")).select("row.*")
