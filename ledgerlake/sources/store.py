"""Several tables that change together: a manifest names one version of each, and a new manifest swaps them all at once.

Tables are Parquet folders below a root that driver and executors share, dealt into buckets by a key. A reader
takes the last manifest, so it sees all of a commit or nothing; a writer whose manifest exists already has lost
to another and must start again from the new state. A commit of deltas writes the buckets that they touch and
names the others as they were. Folders of commits that never got a manifest are never read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.changes import Delta, applied


class Conflict(RuntimeError):
    """Another commit was made since the state was read."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest-{version:012d}.json"

    def version(self) -> int:
        """The last commit's number; 0 before any."""
        folder = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=0)

    def paths(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """Each table's folders by bucket; a table without buckets has one under an empty name."""
        at = self.version() if version is None else version
        if not at:
            return {}
        stream = self._fs.open(self._path(self._manifest(at)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*self.paths(version)[name].values())

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _written(self, name: str, rows: DataFrame, key: str | None) -> dict[str, str]:
        folder = f"{self.root}/{name}-{uuid.uuid4().hex}"
        if key is None:
            rows.write.parquet(folder)
            return {"": folder}
        rows.withColumn("_bucket", self._bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        held = {n.partition("=")[2]: f"{folder}/{n}" for n in found if n.startswith("_bucket=")}
        if not held:  # no rows: the form is kept all the same
            rows.limit(0).coalesce(1).write.parquet(f"{folder}/none")
            held["none"] = f"{folder}/none"
        return held

    def commit(self, tables: dict[str, DataFrame], since: int, keys: dict[str, str] | None = None, deltas: dict[str, Delta] | None = None) -> int:
        """Writes ``tables``, dealt by ``keys`` where it names them, and applies ``deltas`` to tables that were dealt by the same keys.

        Other tables, and buckets without a change, stay as of version ``since``. Returns the new version, or
        ``since`` if there is nothing to write; raises Conflict if another commit was made since.
        """
        paths, keys, made = self.paths(since), keys or {}, False
        for name, rows in tables.items():
            paths[name], made = self._written(name, rows, keys.get(name)), True
        for name, delta in (deltas or {}).items():
            held, key = paths[name], keys[name]
            hit = delta.removed.select(self._bucket(key).alias("b")).union(delta.added.select(self._bucket(key).alias("b"))).distinct()
            touched = {str(r["b"]) for r in hit.collect()}  # at most one row for each bucket
            if not touched:
                continue
            old = [held[b] for b in touched if b in held]
            columns = delta.added.columns
            before = self.spark.read.parquet(*old).select(*columns) if old else delta.added.limit(0)
            fresh = self._written(name, applied(before, delta), key)
            paths[name], made = {b: p for b, p in held.items() if b not in touched} | {b: p for b, p in fresh.items() if b != "none" or len(held) == len(old)}, True
            paths[name] = paths[name] or fresh
        if not made:
            return since
        self._fs.mkdirs(self._path(self.root))
        target, draft = self._path(self._manifest(since + 1)), self._path(f"{self.root}/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(paths).encode()))
        stream.close()
        # a rename onto a name that is taken fails on a distributed file system; a local one would replace it, so it is asked first
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {since + 1} exists")
        return since + 1
