"""An index on disk of the records that near dedup has kept, so that a new batch is compared with all earlier ones from
sketches, and only texts of candidates are read.

``add`` gives what the sequential pass over all batches in turn would keep of the last one: what is similar to a kept
record of an earlier batch goes, and ``near_dedup`` decides among the rest, because kept records never go later.

A layer holds kept keys, by bucket of the id, and their sketches (``dedup.sketches``), about a bit a shingle. A batch is
written together with the newest layers that are not twice as large, so that there are as many layers as the logarithm of
the records, and a record is rewritten as often.

A batch counts once its manifest is there (``versions``). A batch whose name the manifest has changes nothing and gives
what it gave before, so that a job that broke off may run again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import dedup
from tributary.session import drop_saved, n_saved, save
from tributary.sources.versions import Conflict, Versions

PARTS = 64
_KEYS = "rec_id long, key string, batch string, part int"


class RecordIndex(Versions):
    def __init__(self, spark: SparkSession, path: str, threshold: float = dedup.THRESHOLD, k: int = dedup.SHINGLE, parts: int = PARTS):
        """``threshold``, ``k`` and ``parts`` are those of the index where there is one already."""
        super().__init__(spark, path)
        own = self._latest()[1] or {"threshold": threshold, "k": k, "parts": parts}
        self.threshold, self.k, self.parts = own["threshold"], own["k"], own["parts"]
        if not 0 < self.threshold < 1:
            raise ValueError("the threshold must lie between 0 and 1")

    def manifest(self) -> dict:
        """layers from old to new: [name, records]; batches: names."""
        return self._latest()[1] or {"threshold": self.threshold, "k": self.k, "parts": self.parts, "layers": [], "batches": []}

    def _table(self, layers: list, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/layers/{name}/{kind}" for name, _ in layers]
        empty = self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths], empty)

    def kept(self, batch: str | None = None) -> DataFrame:
        """rec_id, key of all kept records, or of those of one batch."""
        rows = self._table(self.manifest()["layers"], "keys", _KEYS)
        return (rows if batch is None else rows.where(F.col("batch") == batch)).select("rec_id", "key")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("rec_id"), F.lit(self.parts)).cast("int").alias("part")

    def _known(self, keys: DataFrame, drawn: DataFrame, manifest: dict) -> DataFrame:
        """rec_id of the records that are similar to an indexed one."""
        old = self._table(manifest["layers"], "sketches", dedup.SKETCH)
        pairs = save(dedup.candidates(drawn, old, self.threshold).select("a", "b"), "candidates")
        parts = [r["part"] for r in pairs.select(F.col("b").alias("rec_id")).select(self._part()).distinct().collect()]  # at most ``parts`` numbers
        texts = self._table(manifest["layers"], "keys", _KEYS).where(F.col("part").isin(parts)).select("rec_id", "key")
        return dedup._compared(pairs, keys, texts, self.threshold, self.k).select(F.col("a").alias("rec_id")).distinct()

    def add(self, records: DataFrame, batch: str) -> DataFrame:
        """Indexes a batch of records (rec_id, key; ids that no other batch has) and returns the kept ones of it. Records
        without a key are kept, as in ``near_dedup``."""
        version, manifest = self.version(), self.manifest()
        if batch in manifest["batches"]:
            return self.kept(batch)
        since = n_saved()
        # dealt by bucket once: a layer's keys are then written without another shuffle of texts
        dealt = records.select("rec_id", "key").repartition(dedup.shuffle_partitions(self.spark), self._part())
        keys = save(dealt, "keys", "zstd")
        drawn = save(dedup.sketches(keys, self.threshold, self.k), "sketches")
        gone = self.spark.createDataFrame([], "rec_id long")
        if manifest["layers"]:
            gone = save(self._known(keys, drawn, manifest), "known")
            drawn = save(drawn.join(gone, "rec_id", "left_anti"), "sketches")
        own = n_saved()
        gone = save(gone.unionByName(dedup.near_copies(keys, drawn, self.threshold, self.k, own)).distinct(), "gone")
        new = keys.join(gone, "rec_id", "left_anti").withColumn("batch", F.lit(batch))
        total = new.count()
        if total:
            self._write(new, drawn.join(gone, "rec_id", "left_anti"), total, manifest)
        drop_saved(self.spark, since)
        self._commit(version + 1, {**manifest, "batches": [*manifest["batches"], batch]})
        return self.kept(batch)

    def _write(self, new: DataFrame, drawn: DataFrame, total: int, manifest: dict) -> None:
        """Writes a layer of new and merged records, and changes the manifest to it."""
        layers = manifest["layers"]
        at = len(layers)
        while at and 2 * total >= layers[at - 1][1]:
            at -= 1
            total += layers[at][1]
        merged = layers[at:]
        name = uuid.uuid4().hex
        keys = new.select("*", self._part()).unionByName(self._table(merged, "keys", _KEYS))
        keys.sortWithinPartitions("part", "rec_id").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/layers/{name}/keys")
        drawn.unionByName(self._table(merged, "sketches", dedup.SKETCH)).write.parquet(f"{self.path}/layers/{name}/sketches")
        manifest["layers"] = [*layers[:at], [name, total]]

    def vacuum(self, keep: int = 1) -> int:
        """Removes layers that the newest ``keep`` manifests don't name; not while others write or read."""
        return self._vacuum("layers", lambda m: [name for name, _ in m["layers"]], keep)


__all__ = ["Conflict", "RecordIndex"]
