"""Versioned Parquet datasets with a pointer to the current version, points in them, and a folder for scratch tables."""

from __future__ import annotations

import atexit
import json
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: what spark.checkpoint.dir names; in a single local process, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        folder = tempfile.TemporaryDirectory(prefix="textquarry-")
        atexit.register(folder.cleanup)
        _own[app] = folder.name
    return f"{_own[app]}/{app}"


class Snapshots:
    """A dataset under `folder`: v1, v2, ... and a file CURRENT that names the one to read.

    Writers make a new version beside the current one and then move the pointer by a rename; readers resolve it once, so
    they never see half a version. Works on any file system that Hadoop reaches.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def current(self) -> int | None:
        at = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return int(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def path(self, version: int | None = None) -> str:
        found = version if version is not None else self.current()
        if found is None:
            raise FileNotFoundError(f"no version in {self.folder}")
        return f"{self.folder}/v{found}"

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(version))

    def write(self, df: DataFrame, *, partition_by: list[str] | None = None, meta: dict | None = None) -> int:
        """A new version, not yet current."""
        new = max([0, *self.versions()]) + 1
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.folder}/v{new}")
        self._text(f"{self.folder}/v{new}/_meta.json", json.dumps({"version": new, "written": time.time(), **(meta or {})}))
        return new

    def commit(self, version: int, keep: int = 1) -> list[int]:
        """Makes it current and deletes older versions but the last `keep`; returns those deleted."""
        if version not in self.versions():
            raise FileNotFoundError(self.path(version))
        self.move("CURRENT", str(version))
        old = [v for v in self.versions() if v < version]
        gone = old[: len(old) - (keep - 1)] if keep > 1 else old
        for v in gone:
            self._fs.delete(self._path(f"{self.folder}/v{v}"), True)
        return gone

    def move(self, name: str, text: str) -> None:
        """Puts a file in place by a rename."""
        self._text(f"{self.folder}/_{name}.new", text)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri() if "://" in self.folder else self._fs.getUri())
        context.rename(self._path(f"{self.folder}/_{name}.new"), self._path(f"{self.folder}/{name}"), array)

    def replace(self, df: DataFrame, **settings) -> int:
        version = self.write(df, **settings)
        self.commit(version)
        return version

    def info(self) -> dict:
        now = self.current()
        return {"current": now, "versions": self.versions(), "rows": self.read(now).count() if now else 0, "columns": self.read(now).dtypes if now else []}

    def _text(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    # points

    def upsert(self, rows: DataFrame, key: str = "chunk_id") -> int:
        """The current points with those of the same keys replaced."""
        if self.current() is None:
            return self.replace(rows)
        return self.replace(self.read().join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, gone: DataFrame | Column, on: list[str] | None = None) -> int:
        """Without the rows that meet a condition, or whose columns `on` occur in a frame."""
        now = self.read()
        kept = now.where(~F.coalesce(gone, F.lit(False))) if isinstance(gone, Column) else now.join(gone.select(*(on or gone.columns)).distinct(), on or gone.columns, "left_anti")
        return self.replace(kept)

    def by_file(self) -> DataFrame:
        """(file_path, file_hash, point_count)."""
        return self.read().groupBy("file_path").agg(F.min("file_hash").alias("file_hash"), F.count(F.lit(1)).alias("point_count"))


    def chunks_of(self, files: list[str]) -> DataFrame:
        """The points of some files, by file and place."""
        return self.read().where(F.col("file_path").isin(*files)).orderBy("file_path", "line_start")


def collections(spark: SparkSession, store: str) -> list[dict]:
    """The datasets below a folder that have a current version: name, current version, versions."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()) if fs.exists(path) else []
    found = [(n, Snapshots(spark, f"{store.rstrip('/')}/{n}")) for n in names]
    return [{"name": n, "current": d.current(), "versions": d.versions()} for n, d in found if d.current() is not None]


class Manifest:
    """One file that names the current versions of several datasets: readers see all of one state or all of another.

    A new state is put in place by one rename. Versions of the state before it are kept for those who still read them;
    older ones are deleted.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        self._one = Snapshots(spark, self.store)

    def _states(self) -> list[dict[str, int]]:
        at = self._one._path(f"{self.store}/MANIFEST")
        if not self._one._fs.exists(at):
            return []
        stream = self._one._fs.open(at)
        try:
            return json.loads(self._one._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> dict[str, int]:
        return next(iter(self._states()), {})

    def write(self, versions: dict[str, int]) -> None:
        states = [versions, *self._states()[:1]]
        self._one.move("MANIFEST", json.dumps(states))
        for name in versions:
            data = Snapshots(self.spark, f"{self.store}/{name}")
            for old in data.versions():
                if old < min(x[name] for x in states if name in x):
                    data._fs.delete(data._path(f"{data.folder}/v{old}"), True)


def fingerprint(settings: dict, schema_version: int = 1) -> str:
    """A name for a configuration, to keep indexes of different ones apart."""
    import hashlib

    return hashlib.sha256(json.dumps({"v": schema_version, **settings}, sort_keys=True).encode()).hexdigest()[:16]
