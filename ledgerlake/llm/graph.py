"""Pairs of rows that share a key, and connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.shared import written

#: Rows of one key that one task compares with one another.
BLOCK = 4_000


def meeting(index: DataFrame, key: str = "key", root: str = "root") -> DataFrame:
    """The rows of ``index`` whose key is held under at least two roots, with ``blocks``: how many blocks of BLOCK rows the key fills.

    The index is shuffled once; keys under one root (copies, or what is linked already) end here.
    """
    held = Window.partitionBy(key)
    counted = index.withColumns({"_low": F.min(root).over(held), "_high": F.max(root).over(held), "_held": F.count("*").over(held)})
    return counted.where("_low <> _high").withColumn("blocks", F.ceil(F.col("_held") / BLOCK).cast("int")).drop("_low", "_high", "_held")


def meeting_pairs(rows: DataFrame, near: Column, payload: list[str], key: str = "key", root: str = "root") -> DataFrame:
    """Pairs of ``rows`` (of ``meeting``) of one key with root < root_b for which ``near`` holds; ``payload`` columns come as they are and with _b.

    A key of many rows is cut into blocks that meet two by two, each in a cell of its own: no task compares
    more than BLOCK rows with BLOCK others, and every pair meets in exactly one cell.
    """
    columns = [key, root, *payload]
    other = lambda df: df.select(*(F.col(c).alias(f"{c}_b") for c in df.columns))
    few = rows.where("blocks = 1").select(*columns)
    same = (F.col(key) == F.col(f"{key}_b")) & (F.col(root) < F.col(f"{root}_b")) & near
    pairs = few.join(other(few), same)
    own = F.pmod(F.xxhash64(*payload), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(own, x).alias("low"), F.greatest(own, x).alias("high")))
    many = rows.where("blocks > 1").select(*columns, own.alias("block"), F.explode(cells).alias("cell"))
    # in a cell of two blocks, rows of one block don't meet: they do in their block's own cell
    apart = (F.col("block") != F.col("block_b")) | (F.col("cell.low") == F.col("cell.high"))
    return pairs.unionByName(many.join(other(many), same & (F.col("cell") == F.col("cell_b")) & apart).select(*pairs.columns))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b: long); root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks two steps, and relabels the
    links; a round leaves at most a part of the nodes, so rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder. Links from a node to itself and links with a null
    end are ignored; repeated links count once; no links give no rows.
    """
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(ordered.distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        hooks = written(hooks.select("node", F.least("node", "near").alias("up")), "hooks")
        for _ in range(2):
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(above, "up").select("node", F.col("top").alias("up"))
        hooks = written(hooks, "hooks")
        ends = [hooks.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")) for end in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("a_up <> b_up")
        edges = written(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
        if roots is None:
            roots = hooks.select("node", F.col("up").alias("root"))
        else:
            now = hooks.select(F.col("node").alias("root"), F.col("up").alias("top"))
            roots = roots.join(now, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = written(roots, "roots")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
