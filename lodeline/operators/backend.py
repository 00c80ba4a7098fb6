"""What a store of vectors must offer, and the one over Parquet snapshots that is used by default."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.dense import dense_top_k, is_finite, matches
from lodeline.operators.index import SnapshotStore, delete_ids, fingerprint, property_issues, upsert_vectors


class VectorIndex(Protocol):
    """Rows are chunk_id, embedding, metadata_json; queries are query_id, query_vec."""

    def upsert(self, rows: DataFrame) -> int: ...

    def delete(self, ids: DataFrame) -> int: ...

    def reset(self) -> None: ...

    def count(self) -> int: ...

    def ids(self) -> DataFrame: ...

    def search(self, queries: DataFrame, k: int, where: dict[str, str | int | bool] | None = None) -> DataFrame: ...


class ParquetIndex:
    """A collection of vectors of one dimension as snapshots; search is an exact scan. Properties of another collection, or vectors of another dimension, are refused."""

    def __init__(self, spark: SparkSession, root: str, name: str, dimension: int) -> None:
        self.spark, self.name, self.dimension = spark, name, dimension
        self.store, self.digest = SnapshotStore(spark, f"{root.rstrip('/')}/{name}"), fingerprint({"name": name, "dimension": dimension, "distance": "cosine"})
        at = self.store.current()
        issues = property_issues({"digest": self.digest}, at) if at else []
        if issues:
            raise ValueError("; ".join(issues))

    def _rows(self) -> DataFrame:
        if self.store.current() is None:
            return self.spark.createDataFrame([], "chunk_id string, embedding array<float>, metadata_json string")
        return self.store.read(self.digest)

    def upsert(self, rows: DataFrame) -> int:
        wrong = rows.filter(~is_finite(F.col("embedding")) | (F.size("embedding") != self.dimension)).limit(1).collect()
        if wrong:
            raise ValueError(f"vector of {wrong[0].chunk_id} can't be used")
        named = lambda df: df.withColumn("collection_name", F.lit(self.name))
        merged = upsert_vectors(named(self._rows()), named(rows)).select("chunk_id", "embedding")
        metadata = rows.select("chunk_id", "metadata_json").unionByName(delete_ids(self._rows(), rows).select("chunk_id", "metadata_json"))
        self.store.commit(merged.join(metadata, "chunk_id"), self.digest)
        return self.count()

    def delete(self, ids: DataFrame) -> int:
        self.store.commit(delete_ids(self._rows(), ids), self.digest)
        return self.count()

    def reset(self) -> None:
        self.store.invalidate()

    def count(self) -> int:
        at = self.store.current()
        return at["rows"] if at else 0

    def ids(self) -> DataFrame:
        return self._rows().select("chunk_id")

    def search(self, queries: DataFrame, k: int, where: dict[str, str | int | bool] | None = None) -> DataFrame:
        """query_id, chunk_id, cosine, rank of the k nearest rows whose metadata match `where`; k below 1 gives none."""
        rows = self._rows().filter(matches(F.col("metadata_json"), where or {})).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
        return dense_top_k(queries, rows, max(k, 1)).withColumnRenamed("id", "chunk_id").filter(F.col("rank") <= k)
