"""Problem 7: mixing sources to target weights.

Method: Efraimidis-Spirakis sampling. Every document gets an exponential key
scaled by its quality weight; within a source documents are taken in key order
until the token budget is used. Complete epochs (every document once more) come
before the fractional selection. Keys fall into buckets of about equal numbers
of documents, whose totals are prefix-summed; only the bucket at which the
budget ends, and the next, are sorted, so a source that holds a third of all
rows is never in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lodeline.llm.common import small
from lodeline.sources.tables import ensure_checkpoint_dir

WIDE = T.DecimalType(38, 0)


def quality_weight(text: Column) -> Column:
    """Sampling weight from 0.05 to 1: share of letters and marks among the characters that are not white space."""
    dense = F.length(F.regexp_replace(text, r"[\s\p{Z}]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    return F.coalesce(F.greatest(F.lit(0.05), letters / F.nullif(dense, F.lit(0))), F.lit(0.05))


def budgets(sizes: DataFrame, plans: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each mix and listed source: its tokens, the mix size, the target and what max_repeats lets it reach.

    `sizes` has source and size. Repeated rows of plans and targets count once; a mix without a plan gives no rows; a listed source without documents has 0 tokens.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast(WIDE).alias("source_tokens"))
    listed = targets.select("mix_id", "source", "target_bp", "max_repeats").distinct().join(small(plans.select("mix_id", "size_pct").distinct())[0], "mix_id")
    rows = listed.join(totals, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0).cast(WIDE)))
    whole = F.sum("source_tokens").over(W.partitionBy("mix_id")).cast(WIDE)
    scaled = F.col("target_bp").cast(T.DecimalType(9, 0)) * F.col("size_pct").cast(T.DecimalType(9, 0)) * whole.cast(T.DecimalType(20, 0))
    return (
        rows.withColumn("target_scaled", scaled.cast(WIDE))  # in 1/1 000 000 of a token
        .withColumn("cap_scaled", (F.col("source_tokens").cast(T.DecimalType(20, 0)) * F.col("max_repeats").cast(T.DecimalType(9, 0)) * F.lit(1_000_000).cast(T.DecimalType(7, 0))).cast(WIDE))
        .withColumn("reachable", F.col("cap_scaled") >= F.col("target_scaled"))
        .withColumn("goal", F.floor(F.least("cap_scaled", "target_scaled") / F.lit(1_000_000)).cast("long"))
        .withColumn("source_tokens", F.col("source_tokens").cast("long"))
        .withColumn("target_tokens", F.floor(F.col("target_scaled") / F.lit(1_000_000)).cast("long"))
        .withColumn("epochs", F.when(F.col("source_tokens") > 0, F.floor(F.col("goal") / F.col("source_tokens"))).otherwise(0).cast("int"))
        .withColumn("fraction_tokens", F.col("goal") - F.col("epochs") * F.col("source_tokens"))
        .select("mix_id", "source", "max_repeats", "source_tokens", "target_tokens", "reachable", "goal", "epochs", "fraction_tokens")
    )


def _narrow(docs: DataFrame) -> DataFrame:
    """Documents as doc_id, source, size, weight, written once to the shared folder, so that texts are read and weighed a single time."""
    ensure_checkpoint_dir(docs.sparkSession)
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.05)
    return docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), weight.alias("weight")).filter("source IS NOT NULL").checkpoint()


def _mixed(sized: DataFrame, plans: DataFrame, targets: DataFrame, seed: int, bucket_docs: int) -> DataFrame:
    listed, declared = small(targets)
    plan = budgets(sized, plans, listed).filter("goal > 0")
    bins = sized.groupBy("source", F.round(F.log2("weight") * 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w"))
    spread = bins.groupBy("source").agg(F.collect_list(F.struct("n", "w")).alias("weights"), F.sum("n").alias("many"))  # at most some hundred bins of weights
    plan = plan.join(spread, "source").withColumn("buckets", F.ceil(F.col("many") / bucket_docs))
    near = F.broadcast if declared <= 50_000 else (lambda df: df)  # one row for each declared target, which were counted
    u = (F.pmod(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    share = F.aggregate("weights", F.lit(0.0), lambda s, b: s + b["n"] * (1 - F.exp(-b["w"] * F.col("key")))) / F.col("many")  # of the source's keys that lie below
    keyed = lambda rows: (
        sized.join(near(rows), "source").withColumn("key", -F.log(u) / F.col("weight"))
        .withColumn("bucket", F.when(F.col("buckets") > 1, F.least(F.floor(share * F.col("buckets")), F.col("buckets") - 1)).otherwise(0).cast("long"))
    )
    totals = keyed(plan).groupBy("mix_id", "source", "bucket").agg(F.sum("size").alias("tokens"), F.first("fraction_tokens").alias("fraction_tokens"))
    until = F.sum("tokens").over(W.partitionBy("mix_id", "source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    edge = totals.withColumn("until", until).filter("until > fraction_tokens").groupBy("mix_id", "source").agg(F.min(F.struct("bucket", (F.col("until") - F.col("tokens")).alias("offset"))).alias("edge"))
    plan = plan.join(edge, ["mix_id", "source"], "left").select("*", F.coalesce("edge.bucket", F.col("buckets")).alias("edge_bucket"), F.coalesce("edge.offset", F.lit(0)).alias("offset")).drop("edge")
    placed = keyed(plan).select("mix_id", "source", "doc_id", "size", "key", "bucket", "epochs", "max_repeats", "fraction_tokens", "edge_bucket", "offset")
    more = F.col("epochs") < F.col("max_repeats")
    sorted_ = more & F.col("bucket").between(F.col("edge_bucket"), F.col("edge_bucket") + 1)
    plain = placed.filter(~sorted_).select("mix_id", "source", "doc_id", "size", (F.col("epochs") + (more & (F.col("bucket") < F.col("edge_bucket")) & (F.col("size") > 0)).cast("int")).alias("repeats"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id"], kind="stable", ignore_index=True)
        room = int(pdf["fraction_tokens"].iloc[0] - pdf["offset"].iloc[0])
        taken = []
        for size in pdf["size"].tolist():
            fits = 0 < size <= room
            room -= size * fits
            taken.append(int(fits))
        pdf["repeats"] = pdf["epochs"] + pd.array(taken, dtype="int32")
        return pdf[["mix_id", "source", "doc_id", "size", "repeats"]]

    fields = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    kind = ", ".join(f"{c} {fields[c]}" for c in ("mix_id", "source", "doc_id", "size")) + ", repeats int"
    filled = placed.filter(sorted_).drop("bucket", "max_repeats", "edge_bucket").groupBy("mix_id", "source").applyInPandas(fill, kind)
    return plain.unionByName(filled).filter("repeats > 0")


def mix(docs: DataFrame, plans: DataFrame, targets: DataFrame, seed: int = 5, bucket_docs: int = 50_000) -> DataFrame:
    """Repeat counts: one row mix_id, source, doc_id, size, repeats for each document used.

    `docs` has doc_id, source, size (tokens) and weight. All documents of a source are repeated for its complete epochs; the rest of its goal is
    filled in the order of the keys -ln(u)/weight: a document is taken if it still fits, and one that doesn't is passed over for later ones of the two buckets (about 2 * bucket_docs documents) looked at
    there. What is left of the goal is then less than any of these that wasn't taken. u comes from a hash of mix and doc_id, so equal input gives equal output. Null sizes count as 0, null or
    non-positive weights as 0.05, null sources belong to no mix. Documents never exceed max_repeats. Repeated rows are documents of their own. Empty tables give no rows. Columns besides the four are left out. Uses checkpoint().
    """
    return _mixed(_narrow(docs), plans, targets, seed, bucket_docs)


def _reached(docs: DataFrame, plans: DataFrame, targets: DataFrame, seed: int = 5, bucket_docs: int = 50_000) -> DataFrame:
    """The budgets together with what the mix took of each source."""
    sized = _narrow(docs)
    chosen = _mixed(sized, plans, targets, seed, bucket_docs).groupBy("mix_id", "source").agg(
        F.sum(F.col("size") * F.col("repeats")).alias("mixed_tokens"), F.count(F.lit(1)).alias("docs_used"), F.max("repeats").alias("most_repeats")
    )
    return budgets(sized, plans, targets).join(chosen, ["mix_id", "source"], "left").fillna(0, ["mixed_tokens", "docs_used", "most_repeats"])


def mix_report(docs: DataFrame, plans: DataFrame, targets: DataFrame, **how: int) -> DataFrame:
    """For each mix and listed source: target and reached tokens, actual share of the mix in 1/10 000, documents used, and whether the target can be reached."""
    rows = _reached(docs, plans, targets, **how)
    share = F.round(10_000 * F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(W.partitionBy("mix_id")), F.lit(0)), 3)
    return rows.select("mix_id", "source", "source_tokens", "target_tokens", "mixed_tokens", "docs_used", "most_repeats", F.coalesce(share, F.lit(0.0)).alias("share_bp"), "reachable")


def unreached(docs: DataFrame, plans: DataFrame, targets: DataFrame, **how: int) -> DataFrame:
    """mix_id, source: listed sources of which the mix used every document as often as allowed and still has no more than the target, where the target is then exactly out of reach.

    A source out of reach is taken in complete epochs only, so that its mixed tokens are max_repeats times its tokens; equality with the target, which is rounded down, is left to `reachable`.
    """
    used_up = F.col("mixed_tokens") == F.col("max_repeats") * F.col("source_tokens")
    return _reached(docs, plans, targets, **how).filter(used_up & (F.col("mixed_tokens") <= F.col("target_tokens")) & ~F.col("reachable")).select("mix_id", "source")
