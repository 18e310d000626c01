"""A vector store on disk that takes upserts without being rewritten.

Rows (id, document, embedding, metadata) live in buckets of their id's first four hexadecimal digits. An upsert writes one
layer that holds only what it was given, by bucket; a manifest names the layers of each bucket, from old to new, and a
reader takes the newest row of an id. Once a bucket's newer layers hold more than ``merge_share`` of what its first one
does, the upsert writes that bucket anew and its older layers no longer count, so that reading stays within a constant
factor of the store, and writing on average, too.

An upsert counts once its manifest is there (``versions``); ``vacuum`` removes what no manifest in use names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators.retrieval import upsert as latest
from tributary.session import save
from tributary.sources.versions import Conflict, Versions

BUCKETS, MERGE_SHARE = 256, 0.5
_ROW = "id string, document string, embedding array<float>, metadata map<string,string>"


class VectorStore(Versions):
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, merge_share: float = MERGE_SHARE):
        super().__init__(spark, path)
        self.merge_share = merge_share
        self.buckets = self.manifest()["n_buckets"] if self.version() else buckets

    def manifest(self) -> dict:
        """n_buckets, and by bucket (as text) its layers from old to new: [name, rows]."""
        return self._latest()[1] or {"n_buckets": self.buckets, "layers": {}}

    def _bucket(self) -> F.Column:
        return F.pmod(F.conv(F.substring("id", 1, 4), 16, 10).cast("int"), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        """The newest rows of the buckets: id, document, embedding, metadata, bucket."""
        single = [b for b in buckets if len(manifest["layers"][b]) == 1]
        several = [b for b in buckets if len(manifest["layers"][b]) > 1]

        def union(chosen: list[str]) -> DataFrame:
            of: dict[str, list[tuple[int, int]]] = {}
            for b in chosen:
                for age, (name, _) in enumerate(manifest["layers"][b]):
                    of.setdefault(name, []).append((int(b), age))
            parts = []
            for name, cells in of.items():
                rows = self.spark.read.schema(f"{_ROW}, bucket int").parquet(f"{self.path}/layers/{name}")
                ages: dict[int, list[int]] = {}
                for b, age in cells:
                    ages.setdefault(age, []).append(b)
                parts += [rows.where(F.col("bucket").isin(bs)).withColumn("_age", F.lit(age)) for age, bs in ages.items()]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out

        found = self.spark.createDataFrame([], f"{_ROW}, bucket int")
        if single:
            found = found.unionByName(union(single).drop("_age"))
        if several:
            newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_age")))
            found = found.unionByName(union(several).withColumn("_r", newest).where("_r = 1").drop("_r", "_age"))
        return found

    def read(self) -> DataFrame:
        """id, document, embedding, metadata."""
        manifest = self.manifest()
        return self._rows(manifest, list(manifest["layers"])).drop("bucket")

    def count(self) -> int:
        return self.read().count()

    def upsert(self, passages: DataFrame) -> int:
        """Adds passages (document, embedding, metadata, ordinal) as ``retrieval.upsert`` does. Returns the rows written."""
        version, manifest = self.version(), self.manifest()
        new = save(latest(None, passages).withColumn("bucket", self._bucket()), "upserted")
        sizes = {str(r["bucket"]): r["n"] for r in new.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket
        if not sizes:
            return 0
        layers = manifest["layers"]
        full = [b for b, n in sizes.items() if b in layers and n + sum(m for _, m in layers[b][1:]) > self.merge_share * layers[b][0][1]]
        rows = new
        if full:
            every = self._rows(manifest, full).withColumn("_v", F.lit(0)).unionByName(new.where(F.col("bucket").isin([int(b) for b in full])).withColumn("_v", F.lit(1)))
            merged = every.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_v")))).where("_r = 1").drop("_r", "_v")
            rows = new.where(~F.col("bucket").isin([int(b) for b in full])).unionByName(merged)
        name = uuid.uuid4().hex
        path = f"{self.path}/layers/{name}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
        written = {str(r["bucket"]): r["n"] for r in self.spark.read.schema(f"{_ROW}, bucket int").parquet(path).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        for b, n in written.items():
            layers[b] = [[name, n]] if b in full else [*layers.get(b, []), [name, n]]
        self._commit(version + 1, {"n_buckets": self.buckets, "layers": layers})
        return sum(written.values())

    def vacuum(self, keep: int = 1) -> int:
        """Removes layers that the newest ``keep`` manifests don't name, and older manifests; not while others write or read
        older versions. Returns the number of layers removed."""
        return self._vacuum("layers", lambda m: [name for cells in m["layers"].values() for name, _ in cells], keep)


__all__ = ["Conflict", "VectorStore"]
