"""Versions of tables in a folder: each is a manifest that names the files of every partition, so that a commit writes what it
changes and shares the rest, readers keep the version that they began with, and of two writers on one parent one is refused."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed on the same parent."""


class Versions:
    """state: {"version", "tables": {name: {"schema", "files": {partition: [[segment, folder], ...]}}}, "numbers"}; of the size of the list of files."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def latest(self) -> int:
        """The newest version; -1 if there is none."""
        return max((int(m[1]) for n in self._names(self.root) if (m := re.fullmatch(r"v(\d+)\.json", n))), default=-1)

    def has(self, version: int) -> bool:
        return f"v{version}.json" in self._names(self.root)

    def state(self, version: int | None = None) -> dict:
        at = self.latest() if version is None else version
        if at < 0:
            return {"version": -1, "tables": {}, "numbers": {}}
        return json.loads(self.spark.read.text(f"{self.root}/v{at}.json", wholetext=True).first()[0])

    def write(self, rows: DataFrame, part: str) -> tuple[dict, dict[str, str]]:
        """(schema without the partition's column, folders by partition) of rows, written by part. The folder has a name of its own, so that a
        commit that fails leaves nothing that is read."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy(part).parquet(f"{self.root}/{folder}")
        schema = StructType([f for f in rows.schema if f.name != part])
        return json.loads(schema.json()), {n.split("=", 1)[1]: f"{folder}/{n}" for n in self._names(f"{self.root}/{folder}") if n.startswith(f"{part}=")}

    def read(self, state: dict, table: str, parts: set[int] | None = None) -> DataFrame:
        """A table's rows with segment_, of all partitions or of some: only their files are listed and opened."""
        t = state["tables"][table]
        schema, by = StructType.fromJson(t["schema"]), {}
        for part, files in t["files"].items():
            if parts is None or int(part) in parts:
                for segment, folder in files:
                    by.setdefault(segment, []).append(f"{self.root}/{folder}")
        frames = [self.spark.read.schema(schema).parquet(*folders).withColumn("segment_", F.lit(segment)) for segment, folders in sorted(by.items())]
        return reduce(lambda a, b: a.unionByName(b), frames) if frames else self.spark.createDataFrame([], schema).withColumn("segment_", F.lit(0))

    def commit(self, parent: int, tables: dict, numbers: dict | None = None) -> dict:
        """The new state, if parent is still the newest version, or if there is none yet; else Conflict. The manifest appears whole: it is written beside and renamed,
        which fails where the name is taken."""
        state = {"version": parent + 1, "tables": tables, "numbers": numbers or {}}
        beside, final = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/v{parent + 1}.json")
        fs = beside.getFileSystem(self._conf)
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark._jvm
        # file systems of old, local ones too, would replace the file, so that what is asked first tells most conflicts and rename the rest
        taken = fs.exists(final) or self.latest() not in (-1, parent)
        try:
            if not taken:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), self._conf).rename(beside, final, none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            taken = True
        if taken:
            fs.delete(beside, False)
            raise Conflict(f"version {parent + 1} of {self.root} is there already")
        return state

    # -- tables of rows with a key, partitioned by a hash of it

    def put(self, tables: dict[str, tuple[DataFrame, str]], parts: int = 64) -> dict:
        """The next version with these tables(rows, key) whole, all others as they are."""
        state = self.state()
        new = dict(state["tables"])
        for name, (rows, key) in tables.items():
            n = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
            schema, files = self.write(rows.withColumn("part_", n).repartition("part_"), "part_")
            new[name] = {"schema": schema, "key": key, "parts": parts, "files": {p: [[0, f]] for p, f in files.items()}}
        return self.commit(state["version"], new, state["numbers"])

    def change(self, state: dict, changes: dict[str, tuple[DataFrame, DataFrame]], more: dict[str, DataFrame] | None = None, numbers: dict | None = None) -> dict:
        """The version after state with rows in place of those of their keys, and without those of gone(key): changes are table: (rows,
        gone). Partitions that hold no such key keep their files. The rows of more, by table, are only added, as files beside those that
        are there. numbers replace those of their names. All tables change together or none does."""
        new = dict(state["tables"])
        for name, (rows, gone) in changes.items():
            t = state["tables"][name]
            key = t["key"]
            keys = self._part(rows.select(key).unionByName(gone.select(key)).distinct(), t)
            touched = {r.part_ for r in keys.select("part_").distinct().collect()}  # at most t["parts"]
            columns = StructType.fromJson(t["schema"]).names
            left = self._part(self.read(state, name, touched).join(keys.select(key), key, "left_anti").select(columns), t)
            _, files = self.write(left.unionByName(self._part(rows.select(columns), t)).repartition("part_"), "part_")
            new[name] = t | {"files": {p: f for p, f in t["files"].items() if int(p) not in touched} | {p: [[0, f]] for p, f in files.items()}}
            new[name]["digests"] = {p: d for p, d in t.get("digests", {}).items() if int(p) not in touched}
        for name, rows in (more or {}).items():
            t = new[name]
            _, files = self.write(self._part(rows.select(StructType.fromJson(t["schema"]).names), t).repartition("part_"), "part_")
            new[name] = t | {"files": t["files"] | {p: [*t["files"].get(p, []), [0, f]] for p, f in files.items()}}
            new[name]["digests"] = {p: d for p, d in t.get("digests", {}).items() if p not in files}
        return self.commit(state["version"], new, state["numbers"] | (numbers or {}))

    def replace(self, state: dict, tables: dict[str, tuple[DataFrame, str | list[str]]], parts: int = 64) -> dict:
        """The version after state that holds exactly these tables(rows, key), whole. Partitions whose rows are those of state keep their files:
        each partition has a digest (its number of rows and two sums of their hashes), so that a table is read once for the digests and only
        what differs is written. Rows must come out alike each time that they are computed. Rows of one key stand in one partition, so a key
        of several columns deals out what one column would heap up; `parts` holds for tables that are new or have another schema or key."""
        new = {}
        for name, (rows, key) in tables.items():
            t = state["tables"].get(name)
            same = t is not None and t["key"] == key and StructType.fromJson(t["schema"]).simpleString() == rows.schema.simpleString()
            held = {"key": key, "parts": t["parts"] if same else parts}
            placed, old = self._part(rows, held), t.get("digests", {}) if same else {}
            text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
            sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64(text), F.xxhash64(F.lit(1), text))]
            found = placed.groupBy("part_").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("digest")).collect()  # at most t["parts"] rows
            digests = {str(r.part_): r.digest for r in found}
            differ = [int(p) for p, d in digests.items() if old.get(p) != d]
            schema, files = self.write(placed.where(F.col("part_").isin(differ)).repartition("part_"), "part_")
            kept = {p: t["files"][p] for p, d in digests.items() if old.get(p) == d}
            new[name] = held | {"schema": schema, "digests": digests, "files": kept | {p: [[0, f]] for p, f in files.items()}}
        return self.commit(state["version"], new, state["numbers"])

    def compact(self, state: dict, table: str, most: int = 16) -> dict:
        """The version after state with one file list anew for each partition of a table that has gathered more than `most` of them; the
        state itself if none has."""
        t = state["tables"][table]
        many = {int(p) for p, f in t["files"].items() if len(f) > most}
        if not many:
            return state
        _, files = self.write(self._part(self.read(state, table, many).drop("segment_"), t).repartition("part_"), "part_")
        new = t | {"files": {p: f for p, f in t["files"].items() if int(p) not in many} | {p: [[0, f]] for p, f in files.items()}}
        return self.commit(state["version"], state["tables"] | {table: new}, state["numbers"])

    def release(self, keep: int = 10) -> int:
        """Removes all versions but the newest `keep`, and the files that only those had; how many files went. What another writer has written
        and not committed yet is named by no version, and stays."""
        at = sorted(int(m[1]) for n in self._names(self.root) if (m := re.fullmatch(r"v(\d+)\.json", n)))
        named = lambda v: {folder for t in self.state(v)["tables"].values() for files in t["files"].values() for _, folder in files}
        old, kept = at[:-keep], set().union(*map(named, at[-keep:]))
        gone = set().union(*map(named, old)) - kept
        for name in [*(f"v{v}.json" for v in old), *gone]:
            path = self._path(f"{self.root}/{name}")
            path.getFileSystem(self._conf).delete(path, True)
        return len(gone)

    @staticmethod
    def _part(df: DataFrame, t: dict) -> DataFrame:
        return df.withColumn("part_", F.pmod(F.xxhash64(*([t["key"]] if isinstance(t["key"], str) else t["key"])), F.lit(t["parts"])).cast("int"))
