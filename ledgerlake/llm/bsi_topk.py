"""Exact top-k inner-product search over a bit-sliced index.

Rows are cut into blocks. In a block each dimension is shifted to start at 0; bit j of a dimension over the
block's rows is one bitmap (a slice). A query's weights are written in signed digits of which no two neighbours
are other than 0, so a third of them count; a slice of a negative digit is taken inverted, which changes all
sums alike. Slices of equal weight are added with bitmap full adders (carry-save, three slices to a sum and a
carry, many at once), which leaves the score of every row as slices. From the most significant slice
downward the k-th largest score is found by bitmap intersection and count. Rows above it are in; those equal to
it are the boundary, which the smaller id decides. Scores themselves are worked out for these rows only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.shared import written

SCALE = 1024
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
#: Sums must stay below this, so that none leaves 64 bits on its way.
SUM_BOUND = 1 << 62


def build_slices(values: np.ndarray) -> np.ndarray:
    """Slices [level, dim, bytes], from the least significant level, of integers [row, dim] less each dimension's minimum."""
    raised = values - values.min(axis=0)
    levels = max(1, int(raised.max()).bit_length())
    return np.stack([np.packbits((raised >> j & 1).astype(np.uint8).T, axis=1, bitorder="little") for j in range(levels)])


def signed_digits(weights: np.ndarray) -> np.ndarray:
    """Digits [place, weight] of -1, 0 or 1 that stand for integers, no two neighbours other than 0."""
    size = np.abs(weights)
    three = 3 * size
    up, down = (three & ~size) >> 1, (size & ~three) >> 1
    places = np.arange(max(1, int(three.max(initial=0)).bit_length()))[:, None]
    return ((up >> places & 1) - (down >> places & 1)) * np.sign(weights)


def add_slices(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sums bitmaps by weight: ``columns[w]`` [any, bytes] holds those that count 2^w each; returns the sum's slices, least significant first."""
    out, columns = [], list(columns)
    for weight, held in enumerate(columns):  # grows while carries are left
        while len(held) > 1:
            third = len(held) // 3
            if third:
                a, b, c = held[:third], held[third : 2 * third], held[2 * third : 3 * third]
                half = a ^ b
                carry = (a & b) | (half & c)
                held = np.concatenate((half ^ c, held[3 * third :]))
            else:
                carry, held = held[:1] & held[1:], held[:1] ^ held[1:]
            if weight + 1 == len(columns):
                columns.append(carry)
            else:
                columns[weight + 1] = np.concatenate((columns[weight + 1], carry))
        out.append(held[0] if len(held) else np.zeros(held.shape[1], dtype=np.uint8))
    return out


def kth_largest(sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``rows`` (a bitmap of at least k), from the most significant slice downward."""
    value, equal = 0, rows
    for i in range(len(sums) - 1, -1, -1):
        ones = equal & sums[i]
        n = int(np.bitwise_count(ones).sum())
        if n >= k:
            value, equal = value | 1 << i, ones
        else:
            k -= n
            equal = equal & ~sums[i]
    return value


def at_least(sums: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """The bitmap of those ``rows`` whose sum is ``bound`` or more."""
    if bound <= 0:
        return rows
    if bound >> len(sums):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for i in range(len(sums) - 1, -1, -1):
        if bound >> i & 1:
            equal = equal & sums[i]
        else:
            above = above | (equal & sums[i])
            equal = equal & ~sums[i]
    return above | equal


def best_rows(slices: np.ndarray, every: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """The bitmap of those rows (of ``every``, at least k) whose inner product with ``query`` is the k-th largest or more."""
    digits = signed_digits(query)
    columns = [np.zeros((0, slices.shape[2]), dtype=np.uint8)] * (len(digits) + len(slices) - 1)
    for place, row in enumerate(digits):
        plus, minus = np.nonzero(row > 0)[0], np.nonzero(row < 0)[0]
        for level, own in enumerate(slices):
            columns[place + level] = np.concatenate((columns[place + level], own[plus], ~own[minus]))
    sums = add_slices(columns)
    return at_least(sums, every, kth_largest(sums, every, k))


def block_top(values: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of each query's best k rows of one block, own rows left out; ties to the smaller id."""
    n = len(values)
    slices = build_slices(values)
    every = np.packbits(np.ones(n, dtype=np.uint8), bitorder="little")
    out = []
    own = pd.Series(ids).groupby(ids).size().to_dict()
    for query, query_id in zip(queries, query_ids):
        wanted = k + own.get(query_id, 0)
        near = np.arange(n) if wanted >= n else np.nonzero(np.unpackbits(best_rows(slices, every, query, wanted), count=n, bitorder="little"))[0]
        scores = values[near] @ query
        others = ids[near] != query_id
        near, scores = near[others], scores[others]
        best = np.lexsort((ids[near], -scores))[:k]
        out += [(int(query_id), int(ids[near[b]]), int(scores[b])) for b in best]
    return out


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, values: array<long>) of floor(1024 x); those with a null id, vector or component or a non-finite one left out."""
    x = F.col(vector_col)
    whole = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("values"))


def top_k(vectors: DataFrame, k: int = 10, query_step: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose id is divisible by ``query_step``, the best k other rows.

    Scores are integer inner products of floor(1024 x); ties go to the smaller vec_id; a query gets fewer
    rows if fewer there are. Rows with a null id, vector or component, or a component that isn't finite,
    take no part; vectors of another length than the query's don't either. A repeated vec_id: all its rows
    are candidates of other ids' queries, and its first row (by values) is the query.

    Blocks of at most BLOCK_ROWS rows, dealt by a hash of the id, each meet all queries, in groups of
    QUERY_ROWS: a group is one block with its queries, whatever the table's size. So every row is sent once
    for each QUERY_ROWS queries, and each query once for each block; a stated query set keeps both in bounds.
    No rows give none; extra columns are ignored. Finite components so large that a score could leave 64 bits
    raise ValueError.
    """
    rows = quantised(vectors, id_col, vector_col)
    rows = written(rows.withColumn("dims", F.size("values")), "quantised")
    size = F.aggregate("values", F.lit(0).cast("long"), lambda a, x: F.greatest(a, x, -1 - x))  # the least long has no opposite
    n, largest, dims = rows.agg(F.count("*"), F.max(size), F.max("dims")).first()
    if n and dims * (largest + 1) ** 2 >= SUM_BOUND:
        raise ValueError(f"components of up to {largest + 1} in {dims} dimensions give scores beyond 64 bits")
    blocks = max(1, -(-n // (BLOCK_ROWS * 3 // 4)))  # hashing leaves them uneven
    asked = rows.where(F.pmod("vec_id", F.lit(query_step)) == 0).groupBy("vec_id").agg(F.min("values").alias("values"))
    groups = max(1, -(-asked.count() // (QUERY_ROWS * 3 // 4)))
    dealt = rows.select("dims", "vec_id", "values", F.pmod(F.xxhash64("vec_id", "values"), F.lit(blocks)).alias("block"))
    dealt = dealt.withColumn("query_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = asked.select(F.size("values").alias("dims"), "vec_id", "values", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("query_group"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    keys = ["block", "query_group", "dims"]

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(block) and len(asked) and len(block["values"].iloc[0]):
            values, ids = np.array(block["values"].tolist(), dtype=np.int64), block["vec_id"].to_numpy()
            for i in range(0, len(block), BLOCK_ROWS):
                found += block_top(values[i : i + BLOCK_ROWS], ids[i : i + BLOCK_ROWS], np.array(asked["values"].tolist(), dtype=np.int64), asked["vec_id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = dealt.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
