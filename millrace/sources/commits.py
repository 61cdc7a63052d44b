"""Tables under one folder that change together: a commit is one manifest, and a reader stays at the commit it opened.

A table is dealt by a hash of its key columns into a fixed number of buckets. A change writes new folders beside the old
ones and touches only the buckets that its keys lie in; the manifest of a commit names the folders of every bucket of
every table, and appears under its number in one rename. A writer that ends before that leaves folders that no manifest
names: readers never see them and ``vacuum`` deletes them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
EMPTY: dict = {"version": 0, "tables": {}, "jobs": {}}


class ConflictError(Exception):
    """Another writer has made the commit of this number."""


class Snapshot:
    """The tables as one commit left them."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest
        self.version: int = manifest["version"]

    def names(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def read(self, name: str) -> DataFrame:
        """A table; KeyError for a name that this commit does not have."""
        return self._buckets(name, None)

    def done(self, job: str) -> int:
        """The last batch of a job that this commit holds; -1 where it holds none."""
        return self.manifest["jobs"].get(job, -1)

    def _buckets(self, name: str, only: list[int] | None) -> DataFrame:
        held = self.manifest["tables"][name]
        wanted = held["folders"] if only is None else {str(b): held["folders"].get(str(b), []) for b in only}
        paths = [f"{self.store.root}/data/{f}/{BUCKET}={b}" for b, folders in wanted.items() for f in folders]
        schema = StructType.fromJson(held["schema"])
        return self.store.spark.read.schema(schema).parquet(*paths) if paths else self.store.spark.createDataFrame([], schema)


class Change(Snapshot):
    """A snapshot with changes to it that only its own reads see until ``commit``."""

    def __init__(self, store: Store, manifest: dict):
        super().__init__(store, json.loads(json.dumps(manifest)))
        self.version += 1
        self.manifest["version"] = self.version

    def put(self, name: str, rows: DataFrame, key: list[str], gone: DataFrame | None = None) -> None:
        """Adds ``rows`` in place of all rows that share a key with them, or with ``gone``, if that is given.

        Rows of one key belong together (the chunks of a document), so repeats in ``rows`` all stay; a null in a key
        equals null here. ``rows`` are evaluated once. A table's key and columns are those of its first ``put``.
        """
        rows = self._checked(name, rows, key)
        folder, dealt = self._written(name, rows, key)
        if gone is None:
            old = self._at(folder, dealt, rows.schema).select(*key) if dealt else rows.select(*key).limit(0)
            touched = dealt
        else:
            old = gone.select(*key)
            touched = sorted({r[0] for r in old.select(self._bucket(name, key)).distinct().collect()})  # at most one row a bucket
        self._cut(name, old, key, touched, True)
        folders = self.manifest["tables"][name]["folders"]
        for b in dealt:
            folders.setdefault(str(b), []).append(folder)

    def delete(self, name: str, gone: DataFrame, columns: list[str]) -> None:
        """Takes out the rows of which any of ``columns`` is in the first column of ``gone``; nulls are in nothing.

        One pass over each column alone finds the buckets that hold such rows; only these are written anew.
        """
        ids = gone.select(F.col(gone.columns[0]).alias("_gone")).where("_gone is not null").distinct()
        for column in columns:
            bucket = F.regexp_extract(F.input_file_name(), f"/{BUCKET}=([0-9]+)/", 1).cast("int")
            ends = self.read(name).select(F.col(f"`{column}`").alias("_end"), bucket.alias("_at"))
            found = ends.join(ids, F.col("_end") == F.col("_gone"), "left_semi").select("_at").distinct()
            touched = sorted(r[0] for r in found.collect())  # at most one row a bucket
            self._cut(name, ids.withColumnRenamed("_gone", column), [column], touched, False)

    def record(self, job: str, batch: int) -> None:
        """Notes in this commit that a job's batch is done; batches of a job are numbered upwards."""
        self.manifest["jobs"][job] = batch

    def commit(self) -> Snapshot:
        """Makes the changes the store's next commit, all or nothing; ConflictError where another writer was first."""
        self.store._publish(self.manifest)
        return Snapshot(self.store, self.manifest)

    def _checked(self, name: str, rows: DataFrame, key: list[str]) -> DataFrame:
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} is the store's own column")
        held = self.manifest["tables"].get(name)
        if held is None:
            plain = StructType.fromJson(rows.schema.jsonValue())
            for f in plain.fields:
                f.nullable = True
            self.manifest["tables"][name] = {"key": key, "schema": plain.jsonValue(), "folders": {}}
            return rows
        if held["key"] != key:
            raise ValueError(f"{name} is dealt by {held['key']}, not by {key}")
        schema = StructType.fromJson(held["schema"])
        if sorted(rows.columns) != sorted(schema.names):
            raise ValueError(f"{name} has the columns {schema.names}, not {rows.columns}")
        return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))

    def _bucket(self, name: str, key: list[str]) -> Column:
        types = {f.name: f.dataType for f in StructType.fromJson(self.manifest["tables"][name]["schema"]).fields}
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`").cast(types[k]) for k in key)), F.lit(self.store.buckets)).cast("int").alias(BUCKET)

    def _written(self, name: str, rows: DataFrame, key: list[str]) -> tuple[str, list[int]]:
        """Writes rows by bucket; the hint lets the runtime split a bucket that is large and merge small ones."""
        folder = f"{name}-{uuid.uuid4().hex}"
        path = f"{self.store.root}/data/{folder}"
        rows.select("*", self._bucket(name, key)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
        return folder, sorted(int(n.split("=")[1]) for n in self.store._list(path) if n.startswith(f"{BUCKET}="))

    def _at(self, folder: str, dealt: list[int], schema: StructType) -> DataFrame:
        return self.store.spark.read.schema(schema).parquet(*(f"{self.store.root}/data/{folder}/{BUCKET}={b}" for b in dealt))

    def _cut(self, name: str, gone: DataFrame, on: list[str], touched: list[int], nulls: bool) -> None:
        """Writes what stays of the touched buckets in place of their folders."""
        held = self.manifest["tables"][name]
        touched = [b for b in touched if held["folders"].get(str(b))]
        if not touched:
            return
        names = {c: f"_gone{i}" for i, c in enumerate(on)}
        out = gone.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).distinct()
        same = [F.col(f"`{c}`").eqNullSafe(F.col(n)) if nulls else F.col(f"`{c}`") == F.col(n) for c, n in names.items()]
        folder, dealt = self._written(name, self._buckets(name, touched).join(out, reduce(and_, same), "left_anti"), held["key"])
        for b in touched:
            held["folders"].pop(str(b))
        for b in dealt:
            held["folders"][str(b)] = [folder]


class Store:
    """Tables under ``root``, a folder that driver and executors share. ``buckets`` is fixed with the first commit; it
    bounds how finely a change touches a table and how many names a manifest holds.

    Two writers of one number: the rename that comes second fails on HDFS and local folders. A store of objects whose
    rename replaces needs one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        latest = self._versions()
        self.buckets = self._manifest(latest[-1]).get("buckets", buckets) if latest else buckets

    def latest(self) -> Snapshot:
        """The last commit; of a new store one without tables."""
        found = self._versions()
        return self.at(found[-1]) if found else Snapshot(self, EMPTY)

    def at(self, version: int) -> Snapshot:
        return Snapshot(self, self._manifest(version))

    def change(self) -> Change:
        return Change(self, self.latest().manifest)

    def update(self, make: Callable[[Change], None], job: str | None = None, batch: int | None = None, tries: int = 5) -> Snapshot:
        """Commits what ``make`` does, from the new state again where another writer was first. A ``batch`` of ``job``
        that a commit already holds, or an earlier one, changes nothing: it may be delivered twice."""
        for _ in range(tries):
            change = self.change()
            if job is not None and batch is not None:
                if change.done(job) >= batch:
                    return self.latest()
                change.record(job, batch)
            make(change)
            try:
                return change.commit()
            except ConflictError:
                continue
        raise ConflictError(f"lost to other writers {tries} times")

    def vacuum(self, keep: int = 10, age: float = 7 * 86400) -> int:
        """Deletes manifests but the last ``keep``, and folders that none of these names; how many folders went.

        Nothing younger than ``age`` seconds goes: a change under way has folders that no manifest names yet, and a
        reader may still be at an old commit.
        """
        found = self._versions()
        limit = (time.time() - age) * 1000
        kept = set(found[-keep:])
        for v in found:
            p = self._path(self._file(v))
            if v not in kept and self._fs.getFileStatus(p).getModificationTime() <= limit:
                self._fs.delete(p, False)
            else:
                kept.add(v)
        used = {f for v in kept for t in self._manifest(v)["tables"].values() for fs in t["folders"].values() for f in fs}
        old = [n for n in self._list(f"{self.root}/data") if n not in used]
        old = [p for p in (self._path(f"{self.root}/data/{n}") for n in old) if self._fs.getFileStatus(p).getModificationTime() <= limit]
        for p in old:
            self._fs.delete(p, True)
        return len(old)

    def _file(self, version: int) -> str:
        return f"{self.root}/commits/{version:012d}.json"

    def _list(self, path: str) -> list[str]:
        p = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list(f"{self.root}/commits") if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(self._file(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        staged = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}.staged")
        out = self._fs.create(staged, False)
        try:
            out.write(json.dumps(manifest | {"buckets": self.buckets}).encode())
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(staged, self._path(self._file(manifest["version"])), options)
        except Py4JJavaError as e:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise ConflictError(f"commit {manifest['version']} exists") from e
            raise
