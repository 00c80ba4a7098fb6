"""Choosing context under budgets: last messages, character budget, compaction, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodeline.functions.text import keep_end, keep_start


def newest_first(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each thread by id, with `back` from 1 for the newest; the limit applies below the exchange."""
    back = F.row_number().over(W.partitionBy("thread_id").orderBy(F.col("id").desc()))
    return messages.withColumn("back", back.cast("bigint")).filter(F.col("back") <= n)


def within_budget(messages: DataFrame, n: int = 12, chars: int = 8_000) -> DataFrame:
    """Messages (thread_id, id, speaker, content) that fit: of the last n, from the newest on while lines and separators stay within `chars`.

    Blank messages are skipped but count towards n; only the newest line may be cut. Result: thread_id, id, line.
    """
    lines = newest_first(messages, n).withColumn("said", F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+$", "")).filter("said <> ''")
    lines = lines.withColumn("line", F.concat(F.when(F.col("speaker") == "assistant", "小助手：").otherwise("学生："), "said"))
    by = W.partitionBy("thread_id").orderBy("back")
    used = F.sum(F.length("line") + 1).over(by.rowsBetween(W.unboundedPreceding, 0)) - 1
    first = F.row_number().over(by) == 1
    kept = lines.withColumn("used", used).withColumn("first", first).filter((F.col("used") <= chars) | F.col("first"))
    return kept.select("thread_id", "id", F.when(F.col("used") > chars, keep_start(F.col("line"), chars)).otherwise(F.col("line")).alias("line"))


def render_lines(lines: DataFrame) -> DataFrame:
    """One text for each thread, lines in order."""
    return lines.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("context"))


def compaction(messages: DataFrame, trigger_messages: int = 24, trigger_chars: int = 8_000, keep: int = 11) -> DataFrame:
    """thread_id, id, retained for every message: in threads of many messages or characters only the last `keep` are retained, elsewhere all."""
    size = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"))
    long = size.filter(((F.col("n") >= trigger_messages) | (F.col("chars") > trigger_chars)) & (F.col("n") > keep)).select("thread_id")
    last = newest_first(messages.join(long, "thread_id", "left_semi"), keep).select("thread_id", "id", F.lit(True).alias("last"))
    rows = messages.select("thread_id", "id").join(long.withColumn("long", F.lit(True)), "thread_id", "left").join(last, ["thread_id", "id"], "left")
    return rows.select("thread_id", "id", (F.col("long").isNull() | F.col("last").isNotNull()).alias("retained"))


def plain_summary(previous: Column, older: Column, most: int = 1_600) -> Column:
    """Summary without a model: the start of what there was and the end of what is new, within `most` characters."""
    new = max(1, int(most * 0.6))
    old = max(1, most - new - 12)
    none = lambda c: F.coalesce(c, F.lit("")).isin("", "无")
    parts = F.array_compact(F.array(F.when(~none(previous), F.concat(F.lit("此前："), keep_start(previous, old))), F.when(~none(older), F.concat(F.lit("新增："), keep_end(older, new)))))
    return keep_start(F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("无"), most)


def last_answer(messages: DataFrame) -> DataFrame:
    """(thread_id, answer): the last message of the assistant with a text in each thread; tool messages don't count."""
    said = messages.filter("speaker = 'assistant'").withColumn("answer", F.regexp_replace("content", r"(?U)^\s+|\s+$", "")).filter("answer <> ''")
    return said.groupBy("thread_id").agg(F.max_by("answer", "id").alias("answer"))
