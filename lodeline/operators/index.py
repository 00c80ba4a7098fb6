"""Index maintenance: manifests, differences, ledgers, snapshots behind a pointer file, deletes, copies."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def id_digest(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, id_sum, id_mix): number and order-free digests of the different chunk ids of each key, so that sets of any size are compared without listing them."""
    h = F.xxhash64("chunk_id")
    one = rows.filter("chunk_id IS NOT NULL").select(*keys, "chunk_id").distinct()
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("id_sum"), F.bit_xor(F.xxhash64(F.lit(7), "chunk_id")).alias("id_mix"))


def manifest(chunks: DataFrame) -> DataFrame:
    """(source, sha256, n, id_sum, id_mix): of each source its digest and what identifies its set of chunk ids. `chunks` has source, file_hash, chunk_id."""
    named = chunks.filter("source IS NOT NULL")
    return named.groupBy("source").agg(F.min("file_hash").alias("sha256")).join(id_digest(named, "source"), "source", "left").fillna(0, ["n", "id_sum", "id_mix"])


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, change): added, removed, updated or unchanged, by one full outer join on source."""
    both = old.select("source", F.col("sha256").alias("was")).join(new.select("source", F.col("sha256").alias("now")), "source", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    return both.select("source", change.alias("change"))


def diff_report(diff: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of each outcome and of the new chunks, one row."""
    counts = diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "removed", "unchanged")])
    return counts.crossJoin(new.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("chunks")))  # one row each


def checkpoint_merge(previous: DataFrame, done: DataFrame, present: DataFrame) -> DataFrame:
    """The manifest to save after part of a refresh: entries of the sources done, and the old ones of sources that are still present and not done yet (`present` has source)."""
    waiting = previous.join(done.select("source"), "source", "left_anti").join(present.select("source").distinct(), "source", "left_semi")
    return done.unionByName(waiting.select(*done.columns))


def ledger_report(ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """Sources whose ledger (a manifest) and documents (source, chunk_id) disagree: source, listed, actual, state (orphan, missing or inconsistent)."""
    both = ledger.select("source", F.struct("n", "id_sum", "id_mix").alias("listed")).join(id_digest(docs.filter("source IS NOT NULL"), "source").select("source", F.struct("n", "id_sum", "id_mix").alias("actual")), "source", "full_outer")
    state = F.when(F.col("listed").isNull(), "orphan").when(F.col("actual").isNull(), "missing").when(F.col("listed") != F.col("actual"), "inconsistent")
    return both.select("source", F.coalesce("listed.n", F.lit(0)).cast("bigint").alias("listed"), F.coalesce("actual.n", F.lit(0)).cast("bigint").alias("actual"), state.alias("state")).filter("state IS NOT NULL")


def repair_rows(report: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of `chunks` to index again so that ledger and word index agree: those of sources reported missing or inconsistent."""
    return chunks.join(report.filter("state <> 'orphan'").select("source"), "source", "left_semi")


def keyword_sync_plan(previous: DataFrame, current: DataFrame, docs: DataFrame) -> DataFrame:
    """Sources whose words must be indexed again without touching vectors. Raises at run time unless the manifests name the same sources with the same digests."""
    diff = manifest_diff(previous, current).filter("change <> 'unchanged'")
    bad = diff.agg(F.count(F.lit(1)).alias("bad"), F.min("source").alias("first"))
    todo = ledger_report(previous, docs).filter("state <> 'orphan'").select("source", "state")
    checked = F.when(F.col("bad") > 0, F.raise_error(F.concat(F.lit("the manifest is not current: "), "first")).cast("string")).otherwise(F.col("state"))
    return todo.crossJoin(bad).select("source", checked.alias("state"))  # one row beside them


def id_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Ids on one side only: chunk_id, side."""
    a, b = expected.select("chunk_id").distinct(), actual.select("chunk_id").distinct()
    return a.join(b, "chunk_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "chunk_id", "left_anti").withColumn("side", F.lit("extra")))


def assert_same_ids(expected: DataFrame, actual: DataFrame) -> None:
    """Raises ValueError, with a few of them, if the two have different ids."""
    some = id_differences(expected, actual).limit(5).collect()
    if some:
        raise ValueError("ids differ: " + ", ".join(f"{r.chunk_id} ({r.side})" for r in some))


def delete_ids(rows: DataFrame, ids: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows without those whose keys (default chunk_id) are listed; ids that aren't there change nothing."""
    keys = keys or ["chunk_id"]
    return rows.join(ids.select(*keys).distinct(), keys, "left_anti")


def delete_source(rows: DataFrame, source: str, namespace: str | None = None) -> DataFrame:
    """Rows without those of one source (of one namespace); rows without a source stay. Doing it again changes nothing."""
    hit = F.col("source") == source if namespace is None else (F.col("source") == source) & (F.col("namespace") == namespace)
    return rows.filter(~F.coalesce(hit, F.lit(False)))


def reset(rows: DataFrame, scope: str, value: str) -> DataFrame:
    """Rows without those of one collection or namespace."""
    return rows.filter(~F.coalesce(F.col(scope) == value, F.lit(False)))


def index_status(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(namespace, chunks, files, postings) of each namespace of the word index."""
    sides = docs.groupBy("namespace").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("source").alias("files"))
    return sides.join(postings.groupBy("namespace").agg(F.count(F.lit(1)).alias("postings")), "namespace", "left").fillna(0, ["postings"])


def ids_of_sources(docs: DataFrame) -> DataFrame:
    """(source, chunk_id, pos): the ids of each source in order, one row each."""
    from pyspark.sql.window import Window as W

    one = docs.filter("source IS NOT NULL").select("source", "chunk_id").distinct()
    return one.withColumn("pos", (F.row_number().over(W.partitionBy("source").orderBy("chunk_id")) - 1).cast("bigint"))


def upsert_vectors(stored: DataFrame, given: DataFrame) -> DataFrame:
    """Stored vectors (collection_name, chunk_id, embedding) with given ones (also metadata_json) put in. Raises at run time if the metadata of a given row names another chunk_id, or its vector is empty or not finite."""
    named = F.get_json_object("metadata_json", "$.chunk_id")
    usable = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    problem = F.when(named.isNotNull() & (named != F.col("chunk_id")), "metadata names another chunk: ").when(~usable, "vector can't be used: ")
    key = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, "chunk_id")).cast("string")).otherwise(F.col("chunk_id"))
    fresh = given.select("collection_name", key.alias("chunk_id"), "embedding")
    return stored.join(fresh.select("collection_name", "chunk_id").distinct(), ["collection_name", "chunk_id"], "left_anti").select("collection_name", "chunk_id", "embedding").unionByName(fresh)


def copy_differences(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows by which a copy of a table differs from it, both ways: keys, side (missing or extra). Rows are compared by a digest of the columns, so wide rows aren't shuffled."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256).alias("_d")
    a, b = source.select(*keys, digest), target.select(*keys, digest)
    return a.exceptAll(b).select(*keys, F.lit("missing").alias("side")).unionByName(b.exceptAll(a).select(*keys, F.lit("extra").alias("side")))


def copy_verified(source: DataFrame, store: SnapshotStore, keys: list[str], digest: str) -> DataFrame:
    """A verified copy of a table as a snapshot: written, read again and compared both ways; the pointer moves only if nothing differs."""
    return store.commit(source, digest, check=lambda copy: copy_differences(source, copy, keys, source.columns).limit(1).count() == 0)


def property_issues(expected: dict[str, str], stored: dict[str, str]) -> list[str]:
    """What a stored collection's properties (dimension, distance, fingerprint, ...) contradict; extra stored ones are no matter."""
    return [f"{k}: expected {v}, stored {stored.get(k)}" for k, v in sorted(expected.items()) if stored.get(k) != v]


def replace_source(docs: DataFrame, source: str, rows: DataFrame) -> DataFrame:
    """Documents with those of one source replaced; ids that another source holds or that come twice are refused at run time."""
    rest = docs.filter(F.coalesce(F.col("source") != source, F.lit(True)))
    taken = rest.select("namespace", "chunk_id", F.lit(True).alias("taken")).distinct()
    many = rows.groupBy("namespace", "chunk_id").agg(F.count(F.lit(1)).alias("copies"))
    checked = rows.join(many, ["namespace", "chunk_id"]).join(taken, ["namespace", "chunk_id"], "left")
    bad = F.col("taken").isNotNull() | (F.col("copies") > 1)
    checked = checked.withColumn("chunk_id", F.when(bad, F.raise_error(F.concat(F.lit("chunk id in use: "), "chunk_id")).cast("string")).otherwise(F.col("chunk_id")))
    return rest.unionByName(checked.select(*docs.columns))


class SnapshotStore:
    """Versions of a table as Parquet folders under a path of any Hadoop file system, with one pointer file that names the current one.

    A version is visible only once the pointer is replaced, so a job that dies leaves the last version in place; the pointer carries a digest of what the version was built from, by which readers know it is ready. A
    version may reuse folders of the one before (`parts`), so that a change of some sources rewrites only their buckets.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs(self.root).mkdirs(self._path(self.root))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def _pointer(self) -> str:
        return f"{self.root}/CURRENT"

    def current(self) -> dict | None:
        fs = self._fs(self.root)
        try:
            stream = fs.open(self._path(self._pointer))
        except Py4JJavaError as x:
            if x.java_exception.getClass().getSimpleName() == "FileNotFoundException":
                return None
            raise
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as x:
            raise RuntimeError(f"broken pointer file {self._pointer}") from x
        finally:
            stream.close()

    def _point(self, at: dict) -> None:
        temporary = f"{self._pointer}.{uuid.uuid4().hex}"
        out = self._fs(self.root).create(self._path(temporary), True)
        out.write(bytearray(json.dumps(at), "utf-8"))
        out.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(self.root).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(temporary), self._path(self._pointer), options)

    def _read(self, at: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in at["parts"].values()])

    def commit(self, df: DataFrame, digest: str, sort: list[str] | None = None, check: Callable[[DataFrame], bool] | None = None) -> DataFrame:
        """Write a whole version, count and check it, then point to it."""
        version = f"v-{uuid.uuid4().hex}"
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(f"{self.root}/{version}")
        at = {"parts": {"all": version}, "digest": digest, "rows": self.spark.read.parquet(f"{self.root}/{version}").count()}
        if check and not check(self._read(at)):
            raise RuntimeError("the written version differs from what was to be written")
        self._point(at)
        return self._read(at)

    def commit_buckets(self, df: DataFrame, digest: str, bucket: Column, buckets: int, touched: set[int] | None = None) -> DataFrame:
        """Write the touched buckets of a version (all by default) and keep the folders of the others; `df` need hold only rows of touched buckets."""
        held = self.current()
        keep = {k: v for k, v in held["parts"].items() if k != "all" and int(k) not in touched} if held and touched is not None else {}
        version = f"v-{uuid.uuid4().hex}"
        todo = sorted(range(buckets) if touched is None else touched)
        df.withColumn("_bucket", bucket.cast("int")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{version}")
        fs = self._fs(self.root)
        parts = keep | {str(b): f"{version}/_bucket={b}" for b in todo if fs.exists(self._path(f"{self.root}/{version}/_bucket={b}"))}
        at = {"parts": parts, "digest": digest}
        at["rows"] = self._read(at).count() if parts else 0
        self._point(at)
        return self._read(at) if parts else df.limit(0)

    def read(self, digest: str | None = None) -> DataFrame:
        """The current version; with a digest only if it was built from just that."""
        at = self.current()
        if at is None or digest is not None and at["digest"] != digest:
            raise RuntimeError("the index is not ready")
        return self._read(at)

    def is_ready(self, digest: str) -> bool:
        at = self.current()
        return at is not None and at["digest"] == digest

    def invalidate(self) -> None:
        self._fs(self.root).delete(self._path(self._pointer), False)


def fingerprint(settings: dict) -> str:
    """Digest of settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def refresh(store: SnapshotStore, chunks: DataFrame, settings: dict, build: Callable[[DataFrame], DataFrame], buckets: int = 64) -> dict[str, int]:
    """Bring a store of chunk rows (source, file_hash, chunk_id, ...) up to date: only added and updated sources are built again, and only the buckets of sources that changed are written.

    Running it twice changes nothing; the result equals a build from nothing. Other settings than those of the current version rebuild all. The written rows are counted before the pointer moves.
    """
    digest = fingerprint(settings)
    bucket = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(buckets))
    at = store.current()
    new = manifest(chunks)
    if at is None or at["digest"] != digest:
        built = store.commit_buckets(build(chunks), digest, bucket, buckets)
        return {"added": new.count(), "updated": 0, "removed": 0, "unchanged": 0, "rows": built.count()}
    old = store.read()
    diff = manifest_diff(manifest(old), new).withColumn("bucket", bucket.cast("int"))
    tally = diff.groupBy("change", "bucket").count().collect()  # at most four rows a bucket
    counts = {c: sum(r["count"] for r in tally if r["change"] == c) for c in ("added", "updated", "removed", "unchanged")}
    touched = {r["bucket"] for r in tally if r["change"] != "unchanged"}
    if touched:
        near = bucket.cast("int").isin(sorted(touched))
        kept = old.filter(near).join(diff.filter("change IN ('updated', 'removed', 'added')").select("source"), "source", "left_anti")
        fresh = chunks.filter(near).join(diff.filter("change IN ('added', 'updated')").select("source"), "source", "left_semi")
        store.commit_buckets(kept.unionByName(build(fresh).select(*kept.columns)), digest, bucket, buckets, touched)
    return counts | {"rows": store.current()["rows"]}


def rebuild(store: SnapshotStore, chunks: DataFrame, settings: dict, build: Callable[[DataFrame], DataFrame], buckets: int = 64) -> dict[str, int]:
    """Build a store from nothing, whatever it holds."""
    store.invalidate()
    return refresh(store, chunks, settings, build, buckets)
