"""Pair counts of a growing set: each batch adds its pairs within itself and with all before it.

Counts are additive: of the new pairs of a set, those within the batch count in
both orders, those between new and old points twice.  For use in ``foreachBatch``.
Points are kept in folders by slab of the box, and a batch reads the slabs that it
can reach, so a batch that is confined in space costs what is near it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.functions.bins import normalize_bins
from tallyfield.operators.theory import DD

#: Folders of points at most, for each of the first two axes.
SLABS = 64


class GrowingCounts:
    """``DD`` of all points seen, kept as Parquet under ``folder``, a shared path.

    A batch that is delivered again replaces what it wrote before, so counts stay
    exact after restarts.  The box must be given, as the extent still grows.
    """

    def __init__(self, spark: SparkSession, folder: str, bins, boxsize: float):
        self.spark, self.folder, self.bins, self.boxsize = spark, folder.rstrip("/"), normalize_bins(bins), boxsize
        self.slabs = max(1, min(SLABS, int(boxsize / self.bins[-1])))

    def _slab(self, axis: str):
        return F.least(F.lit(self.slabs - 1), F.floor(F.pmod(F.col(axis), F.lit(self.boxsize)) / (self.boxsize / self.slabs))).cast("int")

    def _read(self, name: str, before: int | None = None) -> DataFrame | None:
        try:
            found = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None
        return found if before is None else found.where(F.col("batch") < before)

    def _reached(self, batch: DataFrame) -> list[tuple[int, int]]:
        """Slabs of the batch and next to it, at most ``SLABS`` squared."""
        own = batch.select("sx", "sy").distinct().collect()
        return sorted({((r.sx + i) % self.slabs, (r.sy + j) % self.slabs) for r in own for i in (-1, 0, 1) for j in (-1, 0, 1)})

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.select("id", "x", "y", "z", "w", self._slab("x").alias("sx"), self._slab("y").alias("sy")).persist()
        try:
            new = DD(batch, self.bins, periodic=True, boxsize=self.boxsize).select("rmin", "npairs")
            old = self._read("points", number)
            reached = self._reached(batch)
            if old is not None and reached:
                # constants on partition columns: other folders aren't opened
                old = old.where((F.col("sx") * self.slabs + F.col("sy")).isin([a * self.slabs + b for a, b in reached]))
                crossed = DD(batch, self.bins, old, periodic=True, boxsize=self.boxsize).select("rmin", (F.col("npairs") * 2).alias("npairs"))
                new = new.union(crossed).groupBy("rmin").agg(F.sum("npairs").alias("npairs"))
            new.write.mode("overwrite").parquet(f"{self.folder}/counts/batch={number}")
            batch.write.mode("overwrite").partitionBy("sx", "sy").parquet(f"{self.folder}/points/batch={number}")
        finally:
            batch.unpersist()

    def table(self) -> DataFrame:
        """``rmin, npairs`` over all batches."""
        found = self._read("counts")
        if found is None:
            raise ValueError("no batch has been counted")
        return found.groupBy("rmin").agg(F.sum("npairs").alias("npairs")).orderBy("rmin")

    @staticmethod
    def fresh(spark: SparkSession, shared: str, bins, boxsize: float) -> GrowingCounts:
        return GrowingCounts(spark, f"{shared.rstrip('/')}/growing-{uuid.uuid4().hex}", bins, boxsize)
