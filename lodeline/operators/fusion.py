"""Joining ranked routes: linear fusion, weighted reciprocal ranks, second-stage scores."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodeline.operators.lexical import top_k


def candidate_size(k: int, times: int = 4, most: int = 100) -> int:
    return min(most, max(k, k * times))


def linear(candidates: DataFrame, k: int, vector_weight: float = 0.75, word_weight: float = 0.25) -> DataFrame:
    """Rank candidates (query_id, chunk_id, cosine, bm25) by w1 * (cosine + 1) / 2 + w2 * bm25 / max bm25, then bm25, cosine, chunk_id."""
    total = vector_weight + word_weight
    if min(vector_weight, word_weight) < 0 or not math.isfinite(total) or total <= 0:
        raise ValueError("weights must be finite, not negative and not all zero")
    top = F.max("bm25").over(W.partitionBy("query_id"))
    close = (F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine")) + 1) / 2
    word = F.when(top > 0, F.col("bm25") / top).otherwise(0.0)
    scored = candidates.withColumn("combined", F.round(vector_weight / total * close + word_weight / total * word, 6))
    return top_k(scored, ["query_id"], [F.desc("combined"), F.desc("bm25"), F.desc("cosine"), F.asc("chunk_id")], k)


def reciprocal_ranks(routes: list[DataFrame], weights: list[float], k: int, constant: int = 5) -> DataFrame:
    """Weighted reciprocal rank fusion of routes (query_id, chunk_id, rank), for every query at once.

    Within a route the first place of a chunk counts and ranks close up; a chunk's score is the sum of weight / (constant + rank). Routes of weight 0 are left out. Result: query_id,
    chunk_id, rrf_score (6 decimals), first_route, rank by (score desc, chunk_id). A blank chunk_id fails the job. Raises ValueError for bad weights or a constant that is no whole number of at least 1.
    """
    if len(routes) != len(weights) or any(not math.isfinite(w) or w < 0 for w in weights) or not any(weights):
        raise ValueError("one finite weight for each route, none negative, one above zero")
    if isinstance(constant, bool) or not isinstance(constant, int) or constant < 1:
        raise ValueError("constant must be a whole number of at least 1")
    parts = []
    for n, (route, weight) in enumerate(zip(routes, weights, strict=True)):
        if weight:
            named = F.when(F.coalesce(F.btrim(F.col("chunk_id").cast("string")), F.lit("")) == "", F.raise_error(F.lit("blank chunk id"))).otherwise(F.col("chunk_id").cast("string")).cast(route.schema["chunk_id"].dataType)
            once = route.withColumn("chunk_id", named).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("place"))
            close = F.row_number().over(W.partitionBy("query_id").orderBy("place", "chunk_id"))
            parts.append(once.select("query_id", "chunk_id", F.lit(n).alias("route"), (F.lit(float(weight)) / (F.lit(constant) + close)).alias("part")))
    summed = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("rrf_score"), F.min("route").alias("first_route"))
    return top_k(summed, ["query_id"], [F.desc("rrf_score"), F.asc("chunk_id")], k)


def rerank(candidates: DataFrame, answers: DataFrame, n: int, *keep: str) -> DataFrame:
    """Order candidates (query_id, chunk_id, rank) by a second stage's answer (query_id, answer: JSON with results[index, relevance_score]).

    Indexes that are missing, repeated or out of range are dropped, bad scores are 0; order is score desc, index asc. A query of at most n candidates, or one
    without a usable answer, keeps its order. Columns of the candidates named in `keep` are carried along.
    """
    shape = "array<struct<index:string,relevance_score:string>>"
    results = F.coalesce(F.from_json(F.get_json_object("answer", "$.output.results"), shape), F.from_json(F.get_json_object("answer", "$.results"), shape))
    scores = (
        answers.select("query_id", F.posexplode(results).alias("pos", "r"))
        .select("query_id", "pos", F.expr("try_cast(r.index AS int)").alias("at"), F.coalesce(F.expr("try_cast(r.relevance_score AS double)"), F.lit(0.0)).alias("score"))
        .filter("at IS NOT NULL AND at >= 0").groupBy("query_id", "at").agg(F.min_by("score", "pos").alias("score"))
    )
    many = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    placed = candidates.withColumn("many", many).join(scores.select("query_id", (F.col("at") + 1).cast("bigint").alias("rank"), "score"), ["query_id", "rank"], "left")
    usable = F.count("score").over(W.partitionBy("query_id")) > 0
    judged = placed.withColumn("judged", usable & (F.col("many") > n)).filter("NOT judged OR score IS NOT NULL")
    order = [F.when(F.col("judged"), -F.col("score")).otherwise(0.0), F.col("rank")]
    return judged.withColumn("final_rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("bigint")).filter(F.col("final_rank") <= n).select("query_id", "chunk_id", *keep, "final_rank", F.when(F.col("judged"), F.col("score")).alias("rerank_score"))


def score_candidates(candidates: DataFrame, n: int, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Order candidates (query_id, query, chunk_id, rank, text) by a scorer of questions and passages and keep n: query_id, chunk_id, final_rank, rerank_score.

    The scorer runs on Arrow batches of executors. A query of at most n candidates is not scored at all; where the scorer fails or gives no finite number, the query keeps its order. Ties keep it too.
    """
    many = F.count(F.lit(1)).over(W.partitionBy("query_id"))

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        try:
            return pd.Series(scorer(query.tolist(), text.tolist()), index=query.index, dtype="float64")
        except Exception:  # noqa: BLE001 - whatever fails outside must not lose the answer
            return pd.Series([None] * len(query), index=query.index, dtype="float64")

    sized = candidates.withColumn("many", many)
    asked = sized.filter(F.col("many") > n).withColumn("score", score("query", "text"))
    rows = asked.unionByName(sized.filter(F.col("many") <= n).withColumn("score", F.lit(None).cast("double")))
    sound = F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))
    judged = rows.withColumn("judged", F.min(sound).over(W.partitionBy("query_id")))
    order = [F.when(F.col("judged"), -F.col("score")).otherwise(0.0), F.col("rank")]
    placed = judged.withColumn("final_rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("bigint")).filter(F.col("final_rank") <= n)
    return placed.select("query_id", "chunk_id", "final_rank", F.when(F.col("judged"), F.col("score")).alias("rerank_score"))
