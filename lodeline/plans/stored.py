"""The stored word index that the queries read: built once for a state of the tables, then read by every query."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodeline.operators.index import SnapshotStore, fingerprint
from lodeline.operators.lexical import WordIndex, frequencies, index_documents, sizes_of
from lodeline.sources.tables import parallelism, shared_dir, table

VERSION = 5


def _state(spark: SparkSession, path: str) -> list[str]:
    """Names, sizes and times of the files of a table, by which a built index is known to be of just these."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)


def word_index(spark: SparkSession, sf_dir: str) -> WordIndex:
    """The word index of lexical_documents. Each of its tables is ready only if its digest names this state of the table; what isn't is built and committed first."""
    digest = fingerprint({"version": VERSION, "files": _state(spark, f"{sf_dir}/lexical_documents.parquet")})
    root = f"{shared_dir(spark)}/word-index/{digest[:24]}"
    stores = {name: SnapshotStore(spark, f"{root}/{name}") for name in ("documents", "terms")}
    texts = table(spark, sf_dir, "lexical_documents").select("namespace", "chunk_id", "text", "subject", "source")
    if not all(s.is_ready(digest) for s in stores.values()):
        held = stores["documents"].commit(index_documents(texts, parts=parallelism(spark), packed=True), digest)
        stores["terms"].commit(frequencies(held), digest)
    documents = stores["documents"].read(digest)
    return WordIndex(documents, stores["terms"].read(digest), sizes_of(documents), texts)
