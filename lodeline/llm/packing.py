"""Problem 6: filling containers of fixed capacity.

Method: first-fit decreasing with a tournament tree over the bins' free room,
run independently in randomised groups of documents. The number of groups
follows the total size, so one task never holds more than a bounded number of
items; each group leaves at most its last bins badly filled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import declared, small


def token_size(text: Column) -> Column:
    """Tokens of the byte-level tokenizer: UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, by first fit over items in the given order.

    A tournament tree holds the free room of all bins; the root is the largest
    room, and the leftmost bin that fits is found in a walk from root to leaf.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins = np.empty(n, dtype=np.int64)
    for i, need in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i] = node - leaves
        tree[node] -= need
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            most = a if a > b else b
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins


def pack(df: DataFrame, id_col: str, size: Column, capacities: DataFrame, group_items: int = 20_000, seed: int = 11) -> DataFrame:
    """Assign every item to containers of every capacity.

    `capacities` has capacity_id and capacity_tokens (a few rows, one pass for each). Returns capacity_id, doc_id, part_no, parts, part_tokens,
    group_no, bin_no: one row for each item and part. Only an item larger than
    the capacity is split, into full containers of its own and a rest that is packed like the others; (capacity_id, group_no, bin_no) names a container in every row. Items of size 0 and null
    sizes take no room and join the first container of their group; a null id is an item like others, and repeated (id, size) rows are one item each. Groups
    are drawn by a hash of the row's id and size; their number is count / group_items, so equal input gives equal output.
    An empty table gives no rows; columns besides id and size are left out.
    """
    items = df.select(df[id_col].alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    groups = max(1, -(-items.count() // group_items))
    sizes = declared(capacities.filter("capacity_tokens > 0"), "capacity_id", "capacity_tokens")
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(int(c)).cast("long").alias("capacity")) for i, c in sizes or [(0, 1)]]))
    salted = (
        (items if sizes else items.limit(0)).select("doc_id", "size", each.alias("c")).select("doc_id", "size", "c.*")
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int"))
        .withColumn("group_no", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(groups)).cast("int"))
        .withColumn("rest", F.col("size") - (F.col("parts") - 1) * F.col("capacity"))
        .select("capacity_id", "capacity", "group_no", "doc_id", "parts", "rest")
    )

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        pdf["bin_no"] = first_fit_decreasing(pdf["rest"].to_numpy(), int(pdf["capacity"].iloc[0]))
        full = pdf["parts"] - 1
        pdf["full_no"] = pdf["bin_no"].max() + 1 + full.cumsum() - full  # full containers are numbered behind the shared ones
        return pdf[["capacity_id", "capacity", "group_no", "doc_id", "parts", "rest", "bin_no", "full_no"]]

    packed = salted.groupBy("capacity_id", "group_no").applyInPandas(
        one_group, f"capacity_id int, capacity long, group_no int, doc_id {items.schema['doc_id'].dataType.simpleString()}, parts int, rest long, bin_no long, full_no long"
    )
    full = "explode(sequence(0, parts - 1)) AS part_no"
    return packed.selectExpr("capacity_id", "capacity", "group_no", "doc_id", "parts", "rest", "bin_no", "full_no", full).select(
        "capacity_id", "doc_id", "part_no", "parts",
        F.when(F.col("part_no") < F.col("parts") - 1, F.col("capacity")).otherwise(F.col("rest")).alias("part_tokens"),
        "group_no",
        F.when(F.col("part_no") < F.col("parts") - 1, F.col("full_no") + F.col("part_no")).otherwise(F.col("bin_no")).alias("bin_no"),
    )


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """For each capacity: containers used, tokens packed, share of room left over."""
    bins = packed.groupBy("capacity_id", "group_no", "bin_no").agg(F.sum("part_tokens").alias("used"))
    return (
        bins.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
        .join(small(capacities.select("capacity_id", "capacity_tokens").distinct())[0], "capacity_id")
        .select("capacity_id", "containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("left_over"))
    )


def overfull(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """For each capacity: tokens and parts packed, documents, the fullest container's tokens beyond the capacity (0: none is overfull) and documents whose parts aren't all there."""
    bins = packed.groupBy("capacity_id", "group_no", "bin_no").agg(F.sum("part_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    sides = small(capacities.select("capacity_id", "capacity_tokens").distinct())[0]
    over = bins.join(sides, "capacity_id").groupBy("capacity_id").agg(F.sum("used").alias("tokens"), F.sum("n").alias("parts"), F.greatest(F.lit(0), F.max(F.col("used") - F.col("capacity_tokens"))).cast("long").alias("excess"))
    docs = packed.groupBy("capacity_id", "doc_id").agg((F.count(F.lit(1)) % F.first("parts") != 0).alias("torn")).groupBy("capacity_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if("torn").alias("torn"))
    return over.join(docs, "capacity_id")
