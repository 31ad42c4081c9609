"""A table of rows with a path, as Parquet files in parts by the path's hash.

A version is a small file that names the folders of each part. A commit writes new
folders for the parts it touches alone (an append adds to them) and then creates the
next version's file, which fails if it is there: two writers cannot both be the next. Nothing that a
version names is changed or removed before newer versions stand, so a reader sees
the newest whole version whenever a commit stops, and untouched parts keep their
files. A batch that is replayed under its id changes nothing. Files are reached
through Spark's own file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that names a row's part in folders, and the most files that a commit makes of a part.
PART = "store_part"
SPREAD = 4


class Conflict(RuntimeError):
    """Another writer made the version that this commit would have been."""


class Files:
    """The few file operations that the stores need, on the file system of their root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def text(self, name: str) -> str:
        found = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made; False if it is there."""
        try:
            out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Exception as e:  # noqa: BLE001 - the JVM's exception classes differ by file system
            if self._fs.exists(self._path(f"{self.root}/{name}")):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Versions:
    """Numbered JSON files, each made once; the newest that is whole counts."""

    def __init__(self, files: Files, folder: str = "versions"):
        self.files, self.folder = files, folder

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and n[:-5].isdigit()]

    def load(self, number: int) -> dict | None:
        """None for a file whose writer stopped within it."""
        try:
            return json.loads(self.files.text(f"{self.folder}/{number:012d}.json"))
        except ValueError:
            return None

    def newest(self) -> dict:
        for n in reversed(self.numbers()):
            if (found := self.load(n)) is not None:
                return found | {"version": n}
        return {"version": 0}

    def add(self, after: int, content: dict) -> int:
        """Makes the version that follows ``after``; Conflict if another made one since."""
        numbers = self.numbers()
        if any(n > after and self.load(n) is not None for n in numbers):
            raise Conflict(f"version {after} is no longer the newest")
        number = max([after, *numbers]) + 1
        if not self.files.create(f"{self.folder}/{number:012d}.json", json.dumps(content)):
            raise Conflict(f"version {number} is there")
        return number


class Store:
    """``parts`` is fixed when a table is made: more of them make smaller rewrites and more files."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keep: int = 2, parts: int = 16):
        self.spark, self.root, self.schema, self.keep, self._parts = spark, root.rstrip("/"), schema, keep, parts
        self.files = Files(spark, root)
        self.versions = Versions(self.files)

    def pointer(self) -> dict:
        """version, batch (the last that had an id), parts (how many) and dirs (the folders of each part that has rows)."""
        return {"batch": None, "parts": self._parts, "dirs": {}} | self.versions.newest()

    def _part(self, path: str | Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")

    def _read(self, was: dict, parts: list[int] | None = None) -> DataFrame:
        dirs = [f"{self.root}/{d}" for p, own in was["dirs"].items() if parts is None or int(p) in parts for d in own]
        return self.spark.read.schema(self.schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], self.schema)

    def _touched(self, was: dict, paths: DataFrame) -> list[int]:
        # At most one row a part.
        return [r[0] for r in paths.select(self._part("path", was["parts"]).alias("p")).distinct().collect()]

    def read(self, paths: DataFrame | None = None) -> DataFrame:
        """The newest version; no rows where there is none. With ``paths`` (a column path), only the parts that hold them."""
        was = self.pointer()
        return self._read(was, None if paths is None else self._touched(was, paths))

    def commit(self, rows: DataFrame, batch: int | str | None = None) -> int:
        """Makes ``rows`` the table. The rows may come from the version that they replace."""
        was = self.pointer()
        return self._commit(was, rows, list(range(was["parts"])), batch)

    def rewrite(self, paths: DataFrame, change: Callable[[DataFrame], DataFrame], batch: int | str | None = None) -> int:
        """Changes the parts that hold ``paths`` (a column path): ``change`` turns their rows into the new ones, whose paths are among them."""
        was = self.pointer()
        if batch is not None and was["batch"] == batch:
            return was["version"]
        touched = self._touched(was, paths)
        return self._commit(was, change(self._read(was, touched)), touched, batch) if touched else was["version"]

    def append(self, rows: DataFrame, batch: int | str | None = None) -> int:
        """Adds rows; the files that are there stay."""
        return self._commit(self.pointer(), rows, None, batch)

    def _commit(self, was: dict, rows: DataFrame, touched: list[int] | None, batch: int | str | None) -> int:
        if batch is not None and was["batch"] == batch:
            return was["version"]
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], self._part("path", was["parts"]).alias(PART))
        # A note's rows stay together.
        made = self._write(was, out.repartition(PART, F.pmod(F.hash("path"), F.lit(SPREAD))))
        if touched is None:
            dirs = was["dirs"] | {p: was["dirs"].get(p, []) + own for p, own in made.items()}
        elif strange := set(map(int, made)) - set(touched):
            raise ValueError(f"rows of parts that the change did not name: {sorted(strange)}")
        else:
            dirs = {p: own for p, own in was["dirs"].items() if int(p) not in touched} | made
        return self._add(was, dirs, was["batch"] if batch is None else batch)

    def _write(self, was: dict, rows: DataFrame) -> dict[str, list[str]]:
        """The folder of each part of the rows, in a list."""
        folder = f"data/{was['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        rows.sortWithinPartitions(PART, "path").write.partitionBy(PART).parquet(f"{self.root}/{folder}")
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in self.files.names(folder) if n.startswith(f"{PART}=")}

    def _add(self, was: dict, dirs: dict[str, list[str]], batch: int | str | None) -> int:
        number = self.versions.add(was["version"], {"batch": batch, "parts": was["parts"], "dirs": dirs})
        self._forget()
        return number

    def _forget(self) -> None:
        """Drops versions beyond the newest ``keep`` and the folders that only they name."""
        numbers = self.versions.numbers()
        whole = [n for n in numbers if self.versions.load(n) is not None]
        if len(whole) <= self.keep:
            return
        first = whole[-self.keep]
        named = {d for n in whole[-self.keep :] for own in self.versions.load(n)["dirs"].values() for d in own}
        for n in numbers:
            if n < first:
                self.files.delete(f"versions/{n:012d}.json")
        for folder in self.files.names("data"):
            # Folders of versions to come may be in the making.
            if int(folder.split("-")[0]) <= first:
                inner = [f"data/{folder}/{p}" for p in self.files.names(f"data/{folder}") if p.startswith(f"{PART}=")]
                for d in inner:
                    if d not in named:
                        self.files.delete(d)
                if not any(d in named for d in inner):
                    self.files.delete(f"data/{folder}")

    def compact(self, files: int = SPREAD) -> int:
        """Rewrites the parts that have more than ``files`` files as so many at most."""
        was = self.pointer()
        size = lambda own: sum(n.endswith(".parquet") for d in own for n in self.files.names(d))
        many = [int(p) for p, own in was["dirs"].items() if size(own) > files]
        if not many:
            return was["version"]
        rows = self._read(was, many).withColumn(PART, self._part("path", was["parts"]))
        made = self._write(was, rows.repartition(len(many) * files, PART, F.pmod(F.hash("path"), F.lit(files))))
        return self._add(was, was["dirs"] | made, was["batch"])


def tried(action: Callable[[], int]) -> int | None:
    """Runs upkeep that may fail without harm; None if it did."""
    import logging

    try:
        return action()
    except (Conflict, PySparkException) as e:
        logging.getLogger(__name__).warning("upkeep of the table failed: %s", e)
        return None
