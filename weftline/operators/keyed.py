"""Tables that change in place: bucketed by the hash of their key, changed bucket by bucket, published by versions.

A table is a folder:

    versions/N/                 (bucket, home): which folder holds each bucket in version N; its _SUCCESS publishes it
    data/v=N/bucket=B/          the rows of the buckets that version N wrote

A change reads and writes only the buckets that its keys fall into, into a folder of its own; all other buckets keep
their home. A reader takes the newest version that is published and goes on seeing it, whatever is written meanwhile. A
change that fails leaves files that no version names. Two writers at a time are not kept apart: the later one to publish
finds its version there already and fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import dml


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    keys: list[str]
    schema: str
    buckets: int = 64

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest published version; 0 for a table that has none."""
        fs, path = self._files("versions")
        if not fs.exists(path):
            return 0
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(path)]
        return max([n for n in numbers if fs.exists(self._files(f"versions/{n}/_SUCCESS")[1])], default=0)

    def homes(self, version: int | None = None) -> dict[int, int]:
        """bucket -> the version that wrote it; at most `buckets` of them."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return {r["bucket"]: r["home"] for r in self.spark.read.schema("bucket int, home int").parquet(f"{self.path}/versions/{version}").collect()}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some buckets if `only` names them."""
        homes = {b: h for b, h in self.homes(version).items() if only is None or b in only}
        if not homes:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/v={h}/bucket={b}" for b, h in sorted(homes.items())))

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def changed(self, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Writes change(old rows, new rows) for the buckets that new's keys fall into; the new version's number."""
        now, homes, new = self.version(), self.homes(), self.bucketed(new)
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        if not touched:
            return now
        result = self.bucketed(change(self.read(now, touched), new.drop("bucket")))
        result.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/v={now + 1}")
        fs, _ = self._files("data")
        left = {b for b in touched if fs.exists(self._files(f"data/v={now + 1}/bucket={b}")[1])}
        homes = {b: h for b, h in homes.items() if b not in touched} | dict.fromkeys(left, now + 1)
        rows = self.spark.createDataFrame(sorted(homes.items()), "bucket int, home int")
        rows.coalesce(1).write.parquet(f"{self.path}/versions/{now + 1}")
        return now + 1

    def upsert(self, new: DataFrame, updated: list[str]) -> int:
        """New keys are inserted; of known keys only the `updated` columns change. Keys are unique in new."""
        return self.changed(new, lambda old, rows: dml.upsert(old, rows, self.keys, updated))

    def insert_ignore(self, new: DataFrame) -> int:
        """Rows whose key is there already are left as they are."""
        return self.changed(new, lambda old, rows: dml.insert_ignore(old, rows, self.keys).select(*old.columns))

    def delete(self, gone: DataFrame) -> int:
        """Rows of these keys go."""
        return self.changed(gone.select(*self.keys).distinct(), lambda old, rows: old.join(rows, self.keys, "left_anti").select(*old.columns))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes what only versions before the newest `keep` need: readers of older ones lose their files."""
        now = self.version()
        kept = [n for n in range(max(1, now - keep + 1), now + 1)]
        needed = {(b, h) for n in kept for b, h in self.homes(n).items()}
        fs, data = self._files("data")
        for folder in fs.listStatus(data):
            home = int(folder.getPath().getName().removeprefix("v="))
            for part in fs.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and (int(name.removeprefix("bucket=")), home) not in needed:
                    fs.delete(part.getPath(), True)
        fs, versions = self._files("versions")
        for folder in fs.listStatus(versions):
            if int(folder.getPath().getName()) < kept[0]:
                fs.delete(folder.getPath(), True)
