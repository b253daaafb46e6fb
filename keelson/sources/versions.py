"""Tables of which every version stays: data is written first, and counts once its manifest is.

A manifest is a small JSON file of its own name, made last and never changed. Readers see what manifests name and nothing
else, so a write that died leaves files that nobody reads, and two writers get two numbers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Numbers have so many digits in names, so that names sort as numbers do.
DIGITS = 8
ENTRY = "version int, path string, schema string, n_rows long, note string, whole boolean"


class Versions:
    """The versions of a table under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """What is committed, oldest first. A manifest that isn't whole, as of a writer that died in it, doesn't count."""
        path, store = self._path("manifest")
        if not store.exists(path):
            return []
        text = self.spark.read.text(f"{self.root}/manifest", wholetext=True).select(F.from_json("value", ENTRY).alias("e")).select("e.*")
        return [r.asDict() for r in text.where("whole").orderBy("version").collect()]

    def _create(self, version: int, entry: dict) -> bool:
        """Makes a manifest, unless there is one of this number."""
        path, store = self._path(f"manifest/{version:0{DIGITS}d}.json")
        try:
            out = store.create(path, False)
        except Exception as e:  # noqa: BLE001
            if store.exists(path):
                return False
            raise e
        try:
            out.write(bytearray(json.dumps(entry | {"version": version, "whole": True}).encode()))
        finally:
            out.close()
        return True

    def _numbers(self) -> list[int]:
        """Numbers taken, also by manifests that aren't whole."""
        path, store = self._path("manifest")
        names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
        return [int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit()]

    def commit(self, df: DataFrame, note: str = "") -> int:
        """Writes a version and gives its number, 1 for the first."""
        path = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        n = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}").count()
        version = max(self._numbers(), default=0) + 1
        while not self._create(version, {"path": path, "schema": df.schema.json(), "n_rows": n, "note": note}):
            version += 1
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the last if none is named."""
        have = {e["version"]: e for e in self.entries()}
        if not have or version is not None and version not in have:
            raise LookupError(f"no version {version or ''} under {self.root}; committed: {sorted(have)}")
        e = have[max(have) if version is None else version]
        return self.spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(f"{self.root}/{e['path']}")

    def read_all(self, column: str, schema: str) -> DataFrame:
        """All versions, one under another, with their number in ``column``; an empty table of ``schema`` where there is none."""
        out = self.spark.createDataFrame([], schema).withColumn(column, F.lit(0))
        for e in self.entries():
            out = out.unionByName(self.read(e["version"]).withColumn(column, F.lit(e["version"])))
        return out

    def frozen(self, df: DataFrame) -> DataFrame:
        """The first version; ``df`` is committed as that where there is none."""
        have = self.entries()
        return self.read(have[0]["version"] if have else self.commit(df, "frozen"))
