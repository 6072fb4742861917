"""Near-duplicates by Jaccard similarity of word shingles.

Pairs that an index of fingerprints proposes (``simhash``) are decided by their whole sets first. This module
finds those that fingerprints can't see, among sets that are still apart. The keys of a set of shingles depend on its size, so that there are few of either kind:

- below LONG shingles, the set's prefix. All shingles stand in one order, the same for every document; two sets
  whose similarity is t or more share a shingle among the first n - ceil(t n) + 1 of each. No pair is lost.
- from t LONG shingles on, BANDS hashes of ROWS minima each. Two sets of similarity t have a minimum in common
  with probability t, so at t = 0.8 no band in common with (1 - 0.8^4)^35 < 1e-8, which is nearer to what
  a 64-bit hash may confuse than to a loss; a more similar pair is missed more rarely still.

Sets of similarity t have sizes within t of each other, so two sets have keys of one kind in common at least.
An equality join on keys proposes pairs and the whole sets decide. Two guards keep what many texts share from
proposing all pairs of them. Behind the first shingle that two prefixes share there must be room for enough
others, so a passage at the end of the order proposes nothing. And a band that more than HOT sets hold is
replaced by the prefixes of these sets: those of them that are similar share a shingle there as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.graph import components, meeting, meeting_pairs
from ledgerlake.llm.shared import freed, written
from ledgerlake.llm.words import in_groups, mixed, token_hashes

SIMILARITY = 0.8
SEED = 42
LONG, ROWS, BANDS = 160, 4, 35
#: The order of prefixes is taken from about so many documents, and from so many shingles that several of them hold.
ORDER_DOCS, ORDER_SHINGLES, SEVERAL = 4_000, 100_000, 3
#: Rounds in which dense groups are contracted before pairs are sought: pivots of a key, and how many pivots a set is compared with.
ROUNDS = ((1, 1), (1, 6), (2, 12))
PIECE = 1_024
#: Sets of one band that meet one another directly.
HOT = 8
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, ROWS * BANDS, 1), dtype=np.uint32) | np.uint32(1)
_SPREAD = [np.uint64(x) for x in np.random.default_rng(SEED + 1).integers(0, 1 << 63, 64).tolist()]


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """The different hashes of each UTF-8 text's word shingles, rising (unsigned, 64 bits).

    Words stand between ASCII white space, A to Z as lower case. A text of fewer words is one shingle, one without words has none.
    """
    hashes, counts = token_hashes(texts)
    weight = [_SPREAD[i % 64] | np.uint64(1) for i in range(shingle)]
    n = max(0, len(hashes) - shingle + 1)
    joined = np.zeros(n, dtype=np.uint64)
    for i, w in enumerate(weight):
        joined += hashes[i : i + n] * w
    joined = mixed(joined)
    out, at = [], 0
    for count in counts.tolist():
        if count >= shingle:
            out.append(np.unique(joined[at : at + count - shingle + 1]))
        else:
            short = hashes[at : at + count] * np.array(weight[:count], dtype=np.uint64)
            out.append(mixed(short.sum(keepdims=True) + np.uint64(count)) if count else np.zeros(0, dtype=np.uint64))
        at += count
    return out


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of ROWS * BANDS hash functions."""
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    room = np.empty((2, ROWS * BANDS, min(PIECE, len(found))), dtype=np.uint32)
    for i in range(0, len(found), PIECE):
        n = min(PIECE, len(found) - i)
        one, two = room[0, :, :n], room[1, :, :n]
        np.multiply(low[i : i + n], _DRAWN[0], out=one)
        np.multiply(high[i : i + n], _DRAWN[1], out=two)
        np.minimum(best, np.add(one, two, out=one).min(axis=1), out=best)
    return best


def frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rising; their counts) of shingles that several documents of a sample hold. They set the order of work only."""
    parts = max(1, texts.count() // ORDER_DOCS)

    def run(batches):
        for batch in batches:
            held = batch.column(0).cast(pa.binary()).to_pylist()
            for i, j in in_groups(held):
                sets = shingle_sets(held[i:j], shingle)
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64), pa.int64())], ["key"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).select("text")
    counts = some.mapInArrow(freed(run), "key long").groupBy("key").count().where(F.col("count") >= SEVERAL)
    rows = counts.orderBy(F.col("count").desc(), "key").limit(ORDER_SHINGLES).toPandas()
    keys = rows["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["count"].to_numpy(dtype=np.int64)[order]


def prefix(found: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, in order, of which a similar set must hold one."""
    keys, counts = order
    n = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
    if not len(keys):
        return found[:n]
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return found[np.lexsort((found, np.where(keys[at] == found, counts[at], 0)))[:n]]


def keys_of(found: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(the keys of a set by which a similar one must be found, their places in its prefix from 1 on or 0 for bands)."""
    first = prefix(found, order, similarity) if len(found) < LONG else found[:0]
    places, parts = np.arange(1, len(first) + 1, dtype=np.int32), [first]
    if len(found) >= math.floor(similarity * LONG):
        bands = minima(found).reshape(BANDS, ROWS).astype(np.uint64)
        parts.append(mixed(sum(bands[:, i] * _SPREAD[8 + i] for i in range(ROWS)) + np.arange(1, BANDS + 1, dtype=np.uint64) * _SPREAD[20]))
        places = np.concatenate((places, np.zeros(BANDS, dtype=np.int32)))
    return np.concatenate(parts).view(np.int64), places


def _node(found: np.ndarray) -> int:
    """The number of a set of shingles."""
    return xxhash.xxh3_64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (node, node_b, root, root_b) whose whole sets are similar, as links (a, b) of roots."""

    def run(batches):
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(i)] for i in (2, 3)]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)], dtype=np.int64)
            sums = np.array([len(x) + len(y) for x, y in zip(*sides)], dtype=np.int64)
            near = pa.array(both >= similarity * (sums - both) - 1e-9, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    pairs = written(pairs, "pairs")
    asked = pairs.select("node").union(pairs.select("node_b")).distinct()
    needed = sets.join(asked, "node", "left_semi").select("node", "found")
    joined = pairs.join(needed, "node").join(needed.select(F.col("node").alias("node_b"), F.col("found").alias("found_b")), "node_b")
    return joined.select("root", "root_b", "found", "found_b").mapInArrow(freed(run), "a long, b long")


def _moved(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``root`` replaced by its component's smallest root over ``links``."""
    tops = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = rows.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root"))
    return written(moved.select(*rows.columns), "moved")


def _tries(shared: DataFrame, turn: int, pivots: int, tries: int, near: Column) -> DataFrame:
    """Pairs (node, node_b, root, root_b): each node of ``shared`` with at most ``tries`` of its keys' pivots under other roots.

    In the first round a key's pivot is the node whose keys most others hold, which is near the middle of a
    dense group; later ones are drawn for each key and slot anew. Rows stay in proportion to the index.
    """
    if turn == 0:
        held = shared.groupBy("key").agg(F.count("*").alias("held"))
        known = shared.join(held, "key").groupBy("node").agg((-F.sum("held")).alias("chance"))
        rows = shared.join(known, "node")
    else:
        rows = shared.withColumn("chance", F.xxhash64(F.lit(turn), "key", "node"))
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(pivots))
    first = rows.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("chance", "node", "root", "n", "place")).alias("p"))
    first = first.select("key", F.col("p.chance").alias("chance"), *(F.col(f"p.{c}").alias(f"{c}_b") for c in ("node", "root", "n", "place")))
    met = shared.join(first, "key").where((F.col("root") != F.col("root_b")) & near)
    near = met.groupBy("node", "root").agg(F.slice(F.array_sort(F.collect_set(F.struct("chance", "node_b", "root_b"))), 1, tries).alias("near"))  # as many as a set has keys, times pivots
    return near.select("node", "root", F.explode("near").alias("p")).select("node", "p.node_b", "root", "p.root_b")


def similar_documents(docs: DataFrame, sketch: Callable[[np.ndarray], int], proposals: Sequence[Callable[[DataFrame], DataFrame]], shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, component_id), one per row of ``docs`` (doc_id, text) with a doc_id.

    component_id is the smallest doc_id reachable over pairs of texts whose sets of word shingles have a
    Jaccard similarity of ``similarity`` (SIMILARITY at least, for which BANDS are set) or more; texts without
    words link to each other. Equal sets form one node first, with the fingerprint ``sketch`` of the set. Each of
    ``proposals`` in turn gets all nodes (node, root, fp) and gives pairs of them (the same columns, and with _b);
    those whose whole sets are similar come under one root. Then in ROUNDS a node is compared with a few of those
    that share a key, which contracts dense groups in linear work; then every pair that shares one and
    isn't connected yet. Repeated rows come like others; no rows give none.
    """
    if similarity < SIMILARITY:
        raise ValueError("bands reach pairs from SIMILARITY on only")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = texts.sparkSession.sparkContext.broadcast(frequent(texts, shingle))

    def run(batches):
        for batch in batches:
            held = batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in in_groups(held):
                found = shingle_sets(held[i:j], shingle)
                keys, places = zip(*(keys_of(x, order.value, similarity) for x in found))
                columns = [batch.column(0).slice(i, j - i), pa.array([_node(x) for x in found], pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(map(sketch, found), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "fp", "key", "place"])

    def whole(batches):
        for batch in batches:
            held = batch.column(0).cast(pa.binary()).to_pylist()
            for i, j in in_groups(held):
                found = shingle_sets(held[i:j], shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "found"])

    def prefixes(batches):
        for batch in batches:
            first = [prefix(np.frombuffer(x.as_buffer(), dtype=np.uint64), order.value, similarity) for x in batch.column(3)]
            counts = [len(x) for x in first]
            spread = lambda column: pa.array(np.repeat(column.to_numpy(), counts))
            places = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in [0, *counts]])
            keys = np.concatenate([np.zeros(0, dtype=np.uint64), *first]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(spread, batch.columns[:3]), pa.array(keys), pa.array(places)], ["node", "n", "root", "key", "place"])

    rows = written(texts.mapInArrow(freed(run), "doc_id long, node long, n long, fp long, key array<long>, place array<int>"), "keys")
    # equal sets are one node, so that no copy is indexed or compared
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value(F.arrays_zip("key", "place")).alias("keys")), "nodes")
    ids = nodes.select("node", "rep")
    shared = written(meeting(nodes.select("node", "n", F.col("node").alias("root"), F.inline("keys"))), "shared")
    # whole sets are kept only of nodes that meet another, as any similar pair does; by one row each; another row with its doc_id may come along
    asked = ids.join(shared.select("node").distinct(), "node", "left_semi")
    asked = texts.join(asked.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("text").mapInArrow(freed(whole), "node long, found binary")
    sets = written(asked.dropDuplicates(["node"]), "sets")
    apart = nodes.select("node", F.col("node").alias("root"), "fp")
    links = None
    roots = apart
    for propose in proposals:
        pairs = propose(roots).select("node", "node_b", "root", "root_b").distinct()
        found = written(_verified(pairs, sets, similarity), "links")
        links = found if links is None else links.unionByName(found)
        roots = _moved(apart, links)
    roots = roots.drop("fp")
    if links is not None:
        shared = written(meeting(_moved(shared, links).drop("blocks")), "shared")
    sizes = (F.col("n") >= similarity * F.col("n_b") - 1e-9) & (F.col("n_b") >= similarity * F.col("n") - 1e-9)
    # what two sets can share from their first shingle in common on
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    enough = (F.col("place") == 0) | (F.col("place_b") == 0) | (room >= similarity / (1 + similarity) * (F.col("n") + F.col("n_b")) - 1e-9)
    near = sizes & enough
    for turn, (pivots, tries) in enumerate(ROUNDS):
        links = written(_verified(_tries(shared, turn, pivots, tries, near), sets, similarity), "links")
        roots = _moved(roots, links)
        shared = written(meeting(_moved(shared, links).drop("blocks")), "shared")
    crowded = shared.where("place = 0").groupBy("key").count().where(F.col("count") > HOT).select("key")
    crowd = shared.join(crowded, "key", "left_semi").select("node", "n", "root").distinct()
    finer = crowd.join(sets, "node").mapInArrow(freed(prefixes), "node long, n long, root long, key long, place int")
    shared = written(meeting(shared.join(crowded, "key", "left_anti").select(*finer.columns).unionByName(finer)), "shared")
    pairs = meeting_pairs(shared, near, ["node", "n", "place"]).select("node", "node_b", "root", "root_b").distinct()
    roots = _moved(roots, written(_verified(pairs, sets, similarity), "links"))
    least = roots.join(ids, "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "node").join(roots, "node").join(least, "root").select("doc_id", "component_id")
