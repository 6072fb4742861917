"""Best-first pairing in rounds of joins, for rules that are told as a walk over sorted candidates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def new_folder(spark: SparkSession) -> str:
    """A path that no other run uses, in the folder that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/ledgerlake/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new folder: lineage ends there, and with it what the planner infers from round to round."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one closed set that a task walks through; larger sets are decided in rounds until they have fallen apart.
WALK_ROWS = 50_000
#: Rounds after which what is left of large sets is split into connected components.
SPLIT_AFTER = 3


def _walked(rows: DataFrame, within: list[str], order: list[str], walk: Callable[[Iterator[tuple], dict[str, int]], Iterator[tuple]]) -> DataFrame:
    """The rows that ``walk`` takes of each set of equal ``within``: it gets the rows of one set after another in ``order``, and their columns' places.

    Spark deals the sets out and sorts them; a task holds one batch of rows and what the walk keeps.
    """
    columns, kinds = rows.columns, rows.schema
    place = {c: n for n, c in enumerate(columns)}
    key = itemgetter(*(place[c] for c in within))

    def run(batches):
        stream = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in columns)) for b in batches)
        found = []
        for _, members in groupby(stream, key):
            found += walk(members, place)
            if len(found) >= 10_000:
                yield from _as_batches(found, kinds)
                found = []
        yield from _as_batches(found, kinds)

    dealt = rows.repartition(*within).sortWithinPartitions(*within, *order)
    return dealt.mapInArrow(run, kinds)


def _as_batches(rows: list[tuple], kinds: StructType) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(kinds)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _best_walk(left: list[str], right: list[str], evidence: list[str], refuse_ties: bool) -> Callable:
    """The walk of ``best_first``: rows come by (evidence, left, right)."""

    def walk(members, place):
        of = lambda columns: [place[c] for c in columns]
        pick = lambda row, where: tuple(row[n] for n in where)
        at_left, at_right, known = of(left), of(right), of(evidence)
        gone: tuple[set, set] = (set(), set())
        free = lambda a, b: a not in gone[0] and b not in gone[1]
        for _, equals in groupby(members, lambda row: pick(row, known)):
            rows = [(row, pick(row, at_left), pick(row, at_right)) for row in equals]
            by_side: dict[tuple, list[int]] = {}
            if refuse_ties:
                for n, (_, a, b) in enumerate(rows):
                    by_side.setdefault(("l", a), []).append(n)
                    by_side.setdefault(("r", b), []).append(n)
            for n, (row, a, b) in enumerate(rows):
                if not free(a, b):
                    continue
                tied = refuse_ties and any(m > n and free(*rows[m][1:]) for m in chain(by_side["l", a], by_side["r", b]))
                gone[0].add(a)
                gone[1].add(b)
                if not tied:
                    yield row

    return walk


def _split(rows: DataFrame, within: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(rows of sets that a task may walk through, all others)."""
    large = rows.groupBy(*within).agg(F.count("*").alias("_n")).where(F.col("_n") > WALK_ROWS).select(*within)
    large = settled(large)
    return rows.join(large, within, "left_anti").select(*rows.columns), rows.join(large, within, "left_semi").select(*rows.columns)


def best_first(candidates: DataFrame, left: list[str], right: list[str], evidence: list[str], refuse_ties: bool = False, within: list[str] | None = None) -> DataFrame:
    """The rows of ``candidates`` that a walk by (evidence, left, right) takes, each side once.

    With ``refuse_ties`` a row is refused, and both of its sides sit out, if another of equal evidence shares a
    side that is still free. Sides never meet across ``within`` (columns of the candidates), so sets of up to
    WALK_ROWS candidates are walked through, one task many sets. Larger sets, and candidates without
    ``within``, are decided in rounds: a round decides every row that is first on both of its sides, once no
    tied neighbour can still lose its other side to a better row; the first row of all always is such a one.
    After SPLIT_AFTER rounds what is left is split into connected components, which are sets that can be walked
    through again. Only a component that stays larger needs a round for each link of its longest chain.
    """
    order = F.struct(*(F.col(c) for c in [*evidence, *left, *right]))
    known = F.struct(*(F.col(c) for c in evidence))
    walk, by = _best_walk(left, right, evidence, refuse_ties), [*evidence, *left, *right]
    sides = {"l": left, "r": right}
    rows = settled(candidates)
    taken = None
    if within:
        small, rows = _split(rows, within)
        taken, rows = settled(_walked(small, within, by, walk)), settled(rows)
    number = 0
    while not rows.isEmpty():
        number += 1
        now = rows.withColumn("_order", order).withColumn("_known", known)
        for side, keys in sides.items():
            now = now.withColumn(f"_{side}", F.min("_order").over(Window.partitionBy(*keys)))
        decided = (F.col("_order") == F.col("_l")) & (F.col("_order") == F.col("_r"))
        refused = F.lit(False)
        if refuse_ties:
            for side, keys in sides.items():
                first, other = F.col(f"_{side}"), F.col("_r" if side == "l" else "_l")
                tied = (F.col("_order") != first) & (F.col("_known") == F.struct(*(first[c].alias(c) for c in evidence)))
                group = Window.partitionBy(*keys)
                now = now.withColumn(f"_tied_{side}", F.max(tied).over(group)).withColumn(f"_open_{side}", F.max(tied & (other < first)).over(group))
                decided = decided & ~F.col(f"_open_{side}")
                refused = refused | F.col(f"_tied_{side}")
        now = settled(now.withColumn("_decided", decided).withColumn("_refused", refused))
        done = now.where("_decided")
        won = done.where("not _refused").select(*candidates.columns)
        taken = won if taken is None else taken.unionByName(won)
        rest = now.where("not _decided").select(*candidates.columns)
        for keys in sides.values():
            rest = rest.join(done.select(*keys).distinct(), keys, "left_anti").select(*candidates.columns)
        rows = settled(rest)
        if number % SPLIT_AFTER == 0:
            placed = _in_components(rows, left, right)
            small, rows = _split(placed, ["_component"])
            taken = taken.unionByName(settled(_walked(small, ["_component"], by, walk)).select(*candidates.columns))
            taken, rows = settled(taken), settled(rows.select(*candidates.columns))
    return candidates.limit(0) if taken is None else taken


def _in_components(rows: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """``rows`` with _component, the same for all rows that share sides over any number of steps."""
    node = lambda side, columns: F.concat_ws("\u0001", F.lit(side), *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns))
    named = settled(rows.withColumns({"_a": node("l", left), "_b": node("r", right)}))
    return named.join(components(named.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("_a"), F.col("root").alias("_component")), "_a").drop("_a", "_b")


def _whole_walk(rank: list[str], item: str) -> Callable:
    """The walk of ``first_come``: rows come by rank."""

    def walk(members, place):
        at, where = [place[c] for c in rank], place[item]
        gone = set()
        for _, part in groupby(members, lambda row: [row[n] for n in at]):
            rows = list(part)
            if not any(row[where] in gone for row in rows):
                gone.update(row[where] for row in rows)
                yield from rows

    return walk


def first_come(members: DataFrame, rank: list[str], item: str, within: list[str] | None = None) -> DataFrame:
    """The rows of ``members`` (rank..., item) of those sets that a walk by ``rank`` takes: a set is taken whole, if no item of it is gone.

    Items never meet across ``within`` (columns of ``members``): up to WALK_ROWS rows of equal ``within`` are
    walked through. Of others a round takes every set that is first on all of its items, and drops the sets that
    share an item with one.
    """
    order = F.struct(*(F.col(c) for c in rank))
    rows = settled(members.select(*dict.fromkeys([*(within or []), *rank, item])).distinct())
    taken = rows.limit(0).select(*rank, item)
    if within:
        small, rows = _split(rows, within)
        taken, rows = settled(_walked(small, within, rank, _whole_walk(rank, item)).select(*rank, item)), settled(rows)
    while not rows.isEmpty():
        first = rows.withColumn("_order", order).withColumn("_first", F.min("_order").over(Window.partitionBy(item)))
        judged = settled(first.withColumn("_won", F.min(F.col("_order") == F.col("_first")).over(Window.partitionBy(*rank))))
        won = judged.where("_won").select(*rank, item)
        taken = taken.unionByName(won)
        lost = judged.where("not _won").join(won.select(item).distinct(), item, "left_semi").select(*rank).distinct()
        rows = settled(judged.where("not _won").select(*rank, item).join(lost, rank, "left_anti").select(*rank, item))
    return taken


def _turn_walk(first: list[str], item: list[str], kind: list[str]) -> Callable:
    """The walk of ``taken_in_turn``: rows come by (first, item)."""

    def walk(members, place):
        plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x  # noqa: E731  a struct
        of = lambda row, columns: tuple(plain(row[place[c]]) for c in columns)
        gone = set()
        for _, part in groupby(members, lambda row: of(row, first)):
            held = {}
            for row in part:
                if of(row, kind) not in held and of(row, item) not in gone:
                    held[of(row, kind)] = row
            gone.update(of(row, item) for row in held.values())
            yield from held.values()

    return walk


def taken_in_turn(wanted: DataFrame, first: list[str], item: list[str], kind: list[str], within: list[str]) -> DataFrame:
    """The rows of ``wanted`` that are taken when each ``first``, in order, takes the first free ``item`` of each ``kind``.

    Items never meet across ``within``: up to WALK_ROWS rows of equal ``within`` are walked through. Of others a
    round decides those that are the first to want every item that they would take.
    """
    rows = settled(wanted)
    small, rows = _split(rows, within)
    taken, rows = settled(_walked(small, within, [*first, *item], _turn_walk(first, item, kind))), settled(rows)
    while not rows.isEmpty():
        asked = rows.withColumns({"_first": F.struct(*first), "_item": F.struct(*item)}).withColumn("_wanted", F.min("_first").over(Window.partitionBy(*item)))
        best = asked.withColumn("_nth", F.row_number().over(Window.partitionBy(*first, *kind).orderBy(*item))).where("_nth = 1")
        mine = best.withColumn("_mine", F.min(F.col("_wanted") == F.col("_first")).over(Window.partitionBy(*first)))
        done = settled(mine.where("_mine").select(*wanted.columns))
        taken = taken.unionByName(done)
        rest = rows.join(done.select(*first).distinct(), first, "left_anti").select(*wanted.columns)
        rows = settled(rest.join(done.select(*item).distinct(), item, "left_anti").select(*wanted.columns))
    return taken


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b): root is the smallest node it is linked to, over any number of links."""
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = settled(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(roots.withColumnsRenamed({"node": "b", "root": "near"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = roots.withColumnsRenamed({"node": "low", "root": "lower"})  # what the smaller node has been led to itself
        moved = settled(hooked.join(jump, "low").select("node", "root", F.least("low", "lower").alias("now")))
        if moved.where("now <> root").isEmpty():
            return roots
        roots = moved.select("node", F.col("now").alias("root"))
