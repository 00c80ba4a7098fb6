"""The two-route search pipeline for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.blocks import KEYS
from lodeline.operators.dense import dense_top_k
from lodeline.operators.fusion import reciprocal_ranks, rerank
from lodeline.operators.lexical import WordIndex, bm25
from lodeline.sources.tables import ensure_checkpoint_dir

#: Subject that stands for no restriction.
GENERAL = "综合"


def _by_scope(queries: DataFrame, plain: Callable[[DataFrame], DataFrame], scoped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Queries of a subject go one way, those of the general subject, an empty one or none the other; without a subject column all go the plain way."""
    if "subject" not in queries.columns:
        return plain(queries)
    free = F.coalesce("subject", F.lit("")).isin("", GENERAL)
    return plain(queries.filter(free)).unionByName(scoped(queries.filter(~free)))


def routes(queries: DataFrame, index: WordIndex, vectors: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """The dense and the lexical route (query_id, chunk_id, rank, ...) of each query within its collection and namespace, and within its subject if it names one. The queries are a stated set that each route reads several times: they are written once. Uses checkpoint()."""
    return _routes(_written(queries), index, vectors, pool)


def _written(queries: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(queries.sparkSession)
    return queries.checkpoint()


def _routes(queries: DataFrame, index: WordIndex, vectors: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """As `routes`, of queries that are written."""
    rows = vectors.select("collection_name", *(["subject"] if "subject" in vectors.columns else []), F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))

    def dense(q: DataFrame, scope: list[str]) -> DataFrame:
        joined = lambda df: df.withColumn("scope", F.concat_ws("\u0001", *scope))
        return dense_top_k(joined(q), joined(rows), pool, scope="scope").select("query_id", F.col("id").alias("chunk_id"), "cosine", "rank")

    near = _by_scope(queries, lambda q: dense(q, ["collection_name"]), lambda q: dense(q, ["collection_name", "subject"]))
    words = _by_scope(queries, lambda q: bm25(q, index, pool), lambda q: bm25(q, index, pool, by_subject=True))
    return near, words.select("query_id", "chunk_id", "bm25", "rank")


def bodies(found: DataFrame, documents: DataFrame, few: bool = False) -> DataFrame:
    """Ranked chunks with subject, source and text of their document (of the first namespace that has it): only documents that were found are read further. `few` says that what was found can be sent to every task, so that texts are not shuffled to find theirs."""
    ids = found.select("chunk_id").distinct()
    held = documents.join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min_by(F.struct("subject", "source", "text"), "namespace").alias("d"))
    return found.join(held, "chunk_id", "left").select(*found.columns, "d.subject", "d.source", "d.text")


def search(
    queries: DataFrame, index: WordIndex, vectors: DataFrame, k: int = 5, candidates: int = 20, pool: int = 80, weights: tuple[float, float] = (0.75, 0.25), constant: int = 5,
    answers: DataFrame | None = None, ready: Callable[[], bool] | None = None,
) -> DataFrame:
    """Dense and lexical routes of `pool` each, fused to `candidates`, reranked by `answers` (see fusion.rerank) or cut to k, with the documents joined at the end only.

    `queries`: query_id, namespace, collection_name, query, query_vec and maybe subject. Result: query_id, rank, chunk_id, rrf_score, subject, source, text. `ready` says whether the index is current; it is asked before and after the
    routes are planned, and a no is a RuntimeError. Raises ValueError unless k is a whole number of at least 1.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a whole number of at least 1")

    def check() -> None:
        if ready is not None and not ready():
            raise RuntimeError("the index is not ready")

    check()
    queries = _written(queries)
    near, words = _routes(queries, index, vectors, max(candidates, pool))
    check()
    fused = reciprocal_ranks([near.select("query_id", "chunk_id", "rank"), words.select("query_id", "chunk_id", "rank")], list(weights), candidates, constant)
    if answers is None:
        kept = fused.filter(F.col("rank") <= k)
    else:
        kept = rerank(fused, answers, k, "rrf_score").select("query_id", "chunk_id", "rrf_score", F.col("final_rank").alias("rank"))
    return bodies(kept, index.texts, k * queries.count() <= KEYS).select("query_id", "rank", "chunk_id", "rrf_score", "subject", "source", "text")


def render(found: DataFrame) -> DataFrame:
    """One context text for each query: passages numbered in rank order."""
    head = F.concat(F.lit("【资料"), F.col("rank").cast("string"), F.lit("｜"), F.coalesce("subject", F.lit(GENERAL)), F.lit("｜"), F.coalesce("source", F.lit("未知来源")), F.lit("】\n"), F.btrim(F.coalesce("text", F.lit(""))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", head.alias("passage")))), lambda x: x["passage"]), "\n\n").alias("context"))
