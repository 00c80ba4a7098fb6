"""Deterministic exercise corpus from spark.range, for load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def primes(spark: SparkSession, n: int, start: int = 11) -> DataFrame:
    """(pos, prime): the first n primes from `start`, by an anti join with the composites of the range the prime number theorem bounds."""
    import math

    top = max(start + 20, int((n + start) * (math.log(n + start) + math.log(math.log(n + start) + 1)) + 20))
    numbers = spark.range(max(2, start), top).withColumnRenamed("id", "prime")
    composite = spark.range(2, math.isqrt(top) + 1).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.lit(top), F.col("id"))).alias("prime")).distinct()
    return numbers.join(composite, "prime", "left_anti").orderBy("prime").limit(n).select((F.row_number().over(_all("prime")) - 1).cast("bigint").alias("pos"), "prime")


def _all(col: str):
    from pyspark.sql.window import Window as W

    return W.partitionBy(F.lit(0)).orderBy(col)  # over the few rows asked for


def fraction(n: Column, d: Column) -> Column:
    """n/d in lowest terms as text."""
    start = F.struct(n.cast("bigint").alias("a"), d.cast("bigint").alias("b"))
    step = lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), F.when(x["b"] == 0, F.lit(0)).otherwise(F.pmod(x["a"], x["b"])).cast("bigint").alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["a"]  # Euclid's steps of 64-bit numbers are fewer
    return F.when(n % d == 0, (n / d).cast("bigint").cast("string")).otherwise(F.concat((n / gcd).cast("bigint").cast("string"), F.lit("/"), (d / gcd).cast("bigint").cast("string")))


def corpus(spark: SparkSession, per_file: int = 750, grades: int = 6) -> DataFrame:
    """(subject, grade, track, n, text, digest): 3 subjects, `grades` grades, 3 tracks, per_file exercises each; no two texts are the same."""
    rows = spark.range(3 * grades * 3 * per_file).select(
        (F.col("id") % per_file).alias("n"), (F.floor(F.col("id") / per_file) % 3).alias("track"), (F.floor(F.col("id") / (3 * per_file)) % grades + 1).alias("grade"), F.floor(F.col("id") / (3 * per_file * grades)).alias("s")
    )
    a, b = F.col("n") + 11 * F.col("grade"), F.col("n") % 97 + F.col("grade") + 2
    sums = F.when(F.col("track") == 0, F.format_string("%d + %d = %d", a, b, a + b)).when(F.col("track") == 1, F.format_string("%d × %d = %d", a, b, a * b)).otherwise(F.concat(F.format_string("%d : %d = ", a, b), fraction(a, b)))
    hour, minute = F.floor(F.col("n") / 60) % 24, F.col("n") % 60
    clock = F.concat(F.format_string("Track %d, grade %d, no. %d: a walk begins at %02d:%02d and takes %d minutes.", F.col("track"), F.col("grade"), F.col("n"), hour, minute, b))
    reading = F.format_string("第%d册第%d组第%d题：把第%d段读两遍，再用自己的话说一说。", F.col("grade"), F.col("track") + 1, F.col("n") + 1, b)
    text = F.when(F.col("s") == 0, F.format_string("%d年级练习%d：", F.col("grade"), F.col("n") + 1)).otherwise("")
    text = F.concat(text, F.when(F.col("s") == 0, sums).when(F.col("s") == 1, reading).otherwise(clock))
    subject = F.element_at(F.array(F.lit("数学"), F.lit("语文"), F.lit("英语")), (F.col("s") + 1).cast("int"))
    return rows.select(subject.alias("subject"), F.col("grade").cast("int").alias("grade"), F.col("track").cast("int").alias("track"), F.col("n").cast("int").alias("n"), text.alias("text"), F.sha2(text, 256).alias("digest"))


def corpus_report(rows: DataFrame) -> DataFrame:
    """(subject, files, records, duplicates) of a generated corpus: a file for each grade and track, duplicates by digest."""
    return rows.groupBy("subject").agg(
        F.count_distinct("grade", "track").cast("int").alias("files"), F.count(F.lit(1)).cast("int").alias("records"), (F.count(F.lit(1)) - F.count_distinct("digest")).cast("int").alias("duplicates")
    )
