"""A table of rows by key that is corrected in place of being rewritten: folders of key hashes under a versioned manifest.

A row belongs to a bucket by the hash of its key. A batch rewrites only the buckets that its keys fall in, into a new
folder, and then commits by renaming one manifest, which names the folder of every bucket. Readers take the newest
manifest, so they see all of a batch or nothing. A manifest bears the id of its batch: a batch that is given again
changes nothing, and what a failed attempt has written is named by no manifest and is swept up later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    """The table at a path. ``keys`` name a row; ``order`` tells which of several rows of a key is the latest."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: str, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), list(keys), order, buckets
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """{version, batch, buckets, schema, folders: bucket -> folder}; the newest unless a version is given."""
        have = self.versions()
        if not have or (version is not None and version not in have):
            return None
        lines = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version or have[-1]}.json").first()
        return json.loads(lines[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; one that doesn't exist is an error."""
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"no version {version or ''} of {self.path}")
        return self.of_folders(m, m["folders"].values())

    def of_folders(self, m: dict, folders: Sequence[str]) -> DataFrame:
        folders = list(folders)
        if not folders:
            return self.spark.createDataFrame([], m["schema"])
        return self.spark.read.schema(m["schema"]).parquet(*[f"{self.path}/{f}" for f in folders])

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Writes a batch; False if it, or a later one, was already committed. Of a key's rows the one of the largest order
        stays, of equal ones that of the batch, and among these the largest row."""
        before = self.manifest()
        if before and before["batch"] >= batch_id:
            return False
        buckets = before["buckets"] if before else self.buckets
        columns = batch.columns
        schema = before["schema"] if before else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        where = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        new = batch.withColumns({"_new": F.lit(1), "_bucket": where})
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        folders = dict(before["folders"]) if before else {}
        if touched:
            kept = new
            old = [folders[str(b)] for b in touched if str(b) in folders]
            if old:
                kept = new.unionByName(self.of_folders(before, old).withColumns({"_new": F.lit(0), "_bucket": where}))
            rest = [F.col(c).desc_nulls_last() for c in columns if c not in self.keys]
            latest = Window.partitionBy("_bucket", *self.keys).orderBy(F.col(self.order).desc_nulls_last(), F.desc("_new"), *rest)
            kept = kept.withColumn("_k", F.row_number().over(latest)).where("_k = 1").select(*columns, "_bucket")
            folder = f"data/{batch_id}-{uuid.uuid4().hex}"
            kept.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            folders |= {str(b): f"{folder}/_bucket={b}" for b in touched}
        self.commit({"version": (before["version"] if before else 0) + 1, "batch": batch_id, "buckets": buckets, "schema": schema, "folders": folders})
        return True

    def commit(self, m: dict) -> None:
        """One rename makes a version. A version that another writer made first is an error."""
        part = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        self._fs.mkdirs(part.getParent())
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        target = self._path(f"{self.path}/manifests/{m['version']}.json")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise RuntimeError(f"version {m['version']} of {self.path} was written by another")

    def sweep(self, keep: int = 1) -> int:
        """Deletes all manifests but the newest ``keep``, and the folders of buckets that none of these names. Returns how
        many folders went. Not to be run beside a writer."""
        have = self.versions()
        keep = max(1, keep)
        named = {f for v in have[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = 0
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v}.json"), False)
        data = self._path(f"{self.path}/data")
        for batch in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = batch.getPath().getName()
            parts = [s.getPath() for s in self._fs.listStatus(batch.getPath()) if s.isDirectory()]
            dead = [p for p in parts if f"data/{name}/{p.getName()}" not in named]
            gone += len(dead)
            for p in [batch.getPath()] if len(dead) == len(parts) else dead:
                self._fs.delete(p, True)
        return gone


def corrected(stream: DataFrame, table: VersionedTable, checkpoint: str):
    """A stream of corrections into the table, a version for each micro-batch that has not been applied yet."""

    def put(batch: DataFrame, number: int) -> None:
        table.apply(batch, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
