"""Tables with versions: changes write the touched parts anew beside the old ones, and a new version takes effect by one rename.

`<root>/data` holds folders of part files that never change; `<root>/versions/<number>.json` says which folder holds each part in
that version. Readers take the greatest number and are not disturbed by what comes later. A commit renames its file to the next
number, which fails if somebody else has taken it: the loser reads again, decides again and tries again. What fails before the
rename leaves the old version as it was. Parts are hash buckets of a key, so a version is a bounded list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets that a table's rows are dealt into; a change rewrites those with rows that it concerns.
PARTS = 32
_PART = "_part"


class Conflict(Exception):
    """Somebody else has committed the version that this commit was to become."""


class VersionedTable:
    """A table below root, whose rows are dealt into PARTS by the hash of `key`."""

    def __init__(self, spark: SparkSession, root: str, key: str, parts: int = PARTS):
        self.spark, self.root, self.key, self.parts = spark, root.rstrip("/"), key, parts
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, df: DataFrame) -> int:
        return self._commit(0, df.schema, self._written(df))

    def version(self) -> int:
        """The current version's number; 0 before there is one."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def _manifest(self, version: int) -> dict:
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/versions/{version:08d}.json", wholetext=True).collect()))  # one small file

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A version's rows (the current one's by default), of some parts only if they are named."""
        found = self._manifest(self.version() if version is None else version)
        schema = T.StructType.fromJson(found["schema"])
        folders = [f"{self.root}/data/{f}" for part, of in found["parts"].items() if only is None or int(part) in only for f in of]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _written(self, df: DataFrame) -> dict[str, list[str]]:
        """Folders of each part with rows."""
        name = uuid.uuid4().hex
        part = F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.parts))
        df.withColumn(_PART, part).write.partitionBy(_PART).parquet(f"{self.root}/data/{name}")
        folders = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/data/{name}"))]
        return {f.partition("=")[2]: [f"{name}/{f}"] for f in folders if f.startswith(f"{_PART}=")}

    def marks(self, version: int | None = None) -> dict[str, int]:
        """The last batch of each stream whose rows a version holds."""
        found = self.version() if version is None else version
        return self._manifest(found)["marks"] if found else {}

    def _commit(self, base: int, schema: T.StructType, parts: dict[str, list[str]], mark: tuple[str, int] | None = None) -> int:
        """Make base + 1 of these parts, unless there is one. A mark takes effect with them, or not at all."""
        marks = self.marks(base) | ({mark[0]: mark[1]} if mark else {})
        text = json.dumps({"schema": schema.jsonValue(), "parts": parts, "marks": marks})
        aside, to = self._path(f"{self.root}/pending/{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{base + 1:08d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(to.getParent())
        # rename() without the option to overwrite: of two that want one name, one fails
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(to), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self._fs.delete(aside, False)
                raise Conflict(f"version {base + 1} is taken") from None
            raise
        return base + 1

    def rewrite(self, concerned: Column, change: Callable[[DataFrame], DataFrame], base: int | None = None) -> int:
        """Write the parts with concerned rows anew as `change` makes them, and commit on top of `base` (the current version by
        default). Returns the new version, or base where no row is concerned; Conflict if base is no longer the current one."""
        base = self.version() if base is None else base
        rows = self.read(base)
        part = F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.parts))
        touched = [r["part"] for r in rows.where(concerned).select(part.alias("part")).distinct().collect()]  # PARTS at most
        return self._rewritten(base, touched, change)

    def _rewritten(self, base: int, touched: list[int], change: Callable[[DataFrame], DataFrame], mark: tuple[str, int] | None = None) -> int:
        if not touched and mark is None:
            return base
        found, rows = self._manifest(base), self.read(base, only=touched)
        left = {p: f for p, f in found["parts"].items() if int(p) not in touched}
        return self._commit(base, rows.schema, left | self._written(change(rows).select(*(f"`{c}`" for c in rows.columns))), mark)

    def merge(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], base: int | None = None, mark: tuple[str, int] | None = None) -> int:
        """rewrite() for the parts that hold, or would hold, one of keys(key); `mark` is the (stream, batch) they come from."""
        base = self.version() if base is None else base
        part = F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.parts))
        touched = [r["part"] for r in keys.select(part.alias("part")).distinct().collect()]  # PARTS at most
        return self._rewritten(base, touched, change, mark)

    def retried(self, step: Callable[[int], int], most: int = 20) -> int:
        """step(base) until it commits without a conflict."""
        for _ in range(most):
            try:
                return step(self.version())
            except Conflict:
                continue
        raise Conflict(f"no commit in {most} tries")

    def append(self, df: DataFrame, base: int | None = None) -> int:
        """Add rows: new folders beside those of the parts they fall into."""
        base = self.version() if base is None else base
        found, new = self._manifest(base), self._written(df)
        if not new:
            return base
        return self._commit(base, df.schema, {p: found["parts"].get(p, []) + new.get(p, []) for p in {*found["parts"], *new}})

    def delete(self, rows: Column) -> int:
        return self.retried(lambda base: self.rewrite(rows, lambda df: df.where(~F.coalesce(rows, F.lit(False))), base))

    def update(self, rows: Column, values: dict[str, Column]) -> int:
        hit = F.coalesce(rows, F.lit(False))
        return self.retried(lambda base: self.rewrite(rows, lambda df: df.withColumns({c: F.when(hit, v).otherwise(F.col(f"`{c}`")) for c, v in values.items()}), base))

    def swap(self, df: DataFrame, ready: Callable[[DataFrame], bool]) -> bool:
        """Replace all rows by df, if what was written of it is ready; else the current version stays."""
        base, parts = self.version(), self._written(df)
        candidate = self.spark.read.schema(df.schema).parquet(*(f"{self.root}/data/{f}" for of in parts.values() for f in of)) if parts else df.limit(0)
        if not ready(candidate):
            for f in {f.partition("/")[0] for of in parts.values() for f in of}:
                self._fs.delete(self._path(f"{self.root}/data/{f}"), True)
            return False
        self._commit(base, df.schema, parts)
        return True

    def vacuum(self, keep: int = 1) -> None:
        """Delete versions but the last `keep`, and folders that none of these names; not while others write."""
        last = self.version()
        stay = {f for v in range(max(1, last - keep + 1), last + 1) for of in self._manifest(v)["parts"].values() for f in of}
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.root}/versions/{v:08d}.json"), False)
        for folder in self._fs.listStatus(self._path(f"{self.root}/data")):
            name = folder.getPath().getName()
            for part in self._fs.listStatus(folder.getPath()):
                if f"{name}/{part.getPath().getName()}" not in stay:
                    self._fs.delete(part.getPath(), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)
