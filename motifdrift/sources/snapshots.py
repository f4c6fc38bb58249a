"""Tables of immutable folders and a manifest that says which of them count.

A writer puts its rows into a folder that nothing has used yet, and then commits a manifest that names it, by a rename that fails if another writer
was first; that one starts over from the manifest that is there now. Readers see one manifest: an overwrite that was killed changes nothing, and a
reader that has begun keeps its files until clean() is called. Layout under a root: data/v=<unique>/<part>, manifests/<number>.json.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Manifests that clean() keeps, and how old a folder must be that none of them names: a writer may be about to commit it.
KEPT, AGE_S = 2, 24 * 3600
#: Times that a commit starts over after another writer's.
RETRIES = 20


class Conflict(RuntimeError):
    """Another writer has committed this number."""


class Manifests:
    """Numbered JSON states under root/manifests, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def children(self, path: str) -> list[tuple[str, float]]:
        """Names in a folder with the time of their last change in seconds; none if it isn't there."""
        at = self._path(f"{self.root}/{path}".rstrip("/"))
        found = self.fs.listStatus(at) if self.fs.exists(at) else []
        return sorted((f.getPath().getName(), f.getModificationTime() / 1000) for f in found if not f.getPath().getName().startswith(("_", ".")))

    def versions(self) -> list[int]:
        return [int(name[:-5]) for name, _ in self.children("manifests") if name.endswith(".json")]

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/manifests/{version:020d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The newest state and its number; 0 and an empty one before the first commit."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def commit(self, state: dict, after: int) -> int:
        """Makes state number after + 1. A Conflict if there is one of that number already."""
        to = self._path(f"{self.root}/manifests/{after + 1:020d}.json")
        made = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(made, True)
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(made, to, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in str(e) or self.fs.exists(to):
                raise Conflict(f"{self.root} has a version {after + 1} already") from None
            raise
        return after + 1

    def clean(self, folders_of: Callable[[dict], Iterable[str]], depth: int = 2, kept: int = KEPT, age_s: float = AGE_S) -> int:
        """Deletes all but the newest manifests, and folders of this depth under root that none of those names (folders_of a state). How many folders."""
        versions = self.versions()
        live = {f for v in versions[-kept:] for f in folders_of(self.read(v))}
        for v in versions[:-kept]:
            self.fs.delete(self._path(f"{self.root}/manifests/{v:020d}.json"), False)
        found = [(name, at) for name, at in self.children("") if name != "manifests"]
        for _ in range(depth - 1):
            found = [(f"{name}/{child}", at) for name, _ in found for child, at in self.children(name)]
        dead = [name for name, at in found if name not in live and at <= time.time() - age_s]
        for name in dead:
            self.fs.delete(self._path(f"{self.root}/{name}"), True)
        return len(dead)


def write_table(df: DataFrame, root: str, by: str | None = None, mode: str = "append", source: str = "parquet", **options) -> int:
    """Adds df's rows as a version, in parts of a column's values. The version's number.

    mode: 'append' adds to the parts; 'overwrite' takes the place of the parts that df has; 'replace' of all. df may be read from the same root.
    """
    if mode not in ("append", "overwrite", "replace"):
        raise ValueError(f"mode {mode}")
    table, folder = Manifests(df.sparkSession, root), f"v={uuid.uuid4().hex}"
    out = df.write.partitionBy(by) if by else df.write
    out.format(source).options(**options).save(f"{table.root}/data/{folder}")
    parts = [name for name, _ in table.children(f"data/{folder}") if name.startswith(f"{by}=")] if by else [""]
    for _ in range(RETRIES):
        version, state = table.latest()
        now = {} if mode == "replace" else dict(state.get("parts", {}))
        now |= {p: [*(now.get(p, []) if mode == "append" else []), folder] for p in parts}
        try:
            return table.commit({"parts": now}, version)
        except Conflict:
            continue
    raise Conflict(f"{RETRIES} other commits to {root}")


def read_table(spark: SparkSession, root: str, schema: str, version: int | None = None, source: str = "parquet", **options) -> DataFrame:
    """The rows of the newest version, or of an older one that is kept. A folder without manifests is read as it is; if a first write was killed, there is nothing."""
    table = Manifests(spark, root)
    number, state = table.latest() if version is None else (version, table.read(version))
    read = spark.read.format(source).options(**options)
    if not number and not table.children("data"):
        return read.schema(schema).load(root)
    paths = [f"{table.root}/data/{v}/{p}".rstrip("/") for p, folders in state.get("parts", {}).items() for v in folders]
    if not paths:
        return spark.createDataFrame([], schema)
    return read.schema(f"{schema}, v string").option("basePath", f"{table.root}/data").load(paths).drop("v")


def clean_table(spark: SparkSession, root: str, kept: int = KEPT, age_s: float = AGE_S) -> int:
    """Deletes what no kept version of the table names; how many folders."""
    return Manifests(spark, root).clean(lambda state: {f"data/{v}" for folders in state.get("parts", {}).values() for v in folders}, kept=kept, age_s=age_s)
