from pyspark.sql import functions as F

from lodeline.llm import catalog, mixing


def setup(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None, 10 + i % 5, 0.5 if i % 2 else 1.0) for i in range(3000)] + [(9000, "d", 40, 1.0), (9001, "d", None, None)], "doc_id long, source string, size long, weight double")
    plans = spark.createDataFrame([(1, 100), (2, 50), (1, 100), (9, 10)], "mix_id int, size_pct int")
    targets = spark.createDataFrame([(1, "a", 5000, 3), (1, "b", 3000, 1), (1, "d", 1000, 5), (1, "none", 1000, 9), (2, "a", 10000, 1), (2, "a", 10000, 1)], "mix_id int, source string, target_bp int, max_repeats int")
    return docs, plans, targets


def test_targets_and_repeats(spark):
    docs, plans, targets = setup(spark)
    rows = {(r.mix_id, r.source): r for r in mixing.mix_report(docs, plans, targets, bucket_docs=100).collect()}
    whole = docs.filter("source IN ('a', 'b', 'd')").agg(F.sum("size")).first()[0]
    a = rows[1, "a"]
    assert a.reachable and abs(a.mixed_tokens - whole * 0.5) <= 14 and a.most_repeats <= 3
    assert not rows[1, "d"].reachable and rows[1, "d"].mixed_tokens == 200 and rows[1, "d"].most_repeats == 5
    assert not rows[1, "none"].reachable and rows[1, "none"].mixed_tokens == 0
    assert abs(rows[2, "a"].mixed_tokens * 2 - docs.filter("source = 'a'").agg(F.sum("size")).first()[0]) <= 28
    assert len(rows) == 5


def test_complete_epochs_come_first(spark):
    docs, plans, targets = setup(spark)
    used = mixing.mix(docs, plans, targets, bucket_docs=100).filter("mix_id = 1 AND source = 'a'")
    n = docs.filter("source = 'a'").count()
    assert used.count() == n and used.agg(F.max("repeats") - F.min("repeats")).first()[0] <= 1


def test_buckets_do_not_change_the_choice(spark):
    docs, plans, targets = setup(spark)
    one = mixing.mix(docs, plans, targets, bucket_docs=10**9)
    many = mixing.mix(docs, plans, targets, bucket_docs=50)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_heavier_documents_come_sooner(spark):
    docs, plans, targets = setup(spark)
    used = mixing.mix(docs, plans, targets).filter("mix_id = 2").join(docs.select("doc_id", "weight"), "doc_id")
    by = {r.weight: r.n for r in used.groupBy("weight").agg(F.count("*").alias("n")).collect()}
    assert by[1.0] > 1.2 * by[0.5]


def test_empty(spark):
    docs, plans, targets = setup(spark)
    assert mixing.mix(docs.limit(0), plans, targets).count() == 0 and mixing.mix(docs, plans.limit(0), targets).count() == 0
    assert mixing.mix_report(docs.limit(0), plans, targets).filter("mixed_tokens > 0").count() == 0
    df = spark.createDataFrame([("字 a1",), ("   ",), (None,)], "t string")
    assert [round(r[0], 3) for r in df.select(mixing.quality_weight(F.col("t"))).collect()] == [0.667, 0.05, 0.05]


def test_room_is_filled_past_what_does_not_fit(spark):
    sf = "/root/testdata/sf0.01"
    report = {(r.mix_id, r.source): r for r in catalog.p7_report(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).filter("size > 0").toPandas()
    used = catalog.p7_mix(spark, sf).toPandas()
    for (mix_id, source), r in report.items():
        mine = docs[docs["source"] == source]
        if r.reachable and len(mine):
            epochs = r.target_tokens // mine["size"].sum()
            taken = used[(used["mix_id"] == mix_id) & (used["source"] == source) & (used["repeats"] > epochs)]["doc_id"]
            spare = mine[~mine["doc_id"].isin(taken)]["size"]
            left = r.target_tokens - r.mixed_tokens
            assert left >= 0 and (len(spare) == 0 or left < spare.min()), (mix_id, source, left, spare.min())


def test_light_documents_share_the_buckets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(3).alias("size"), F.when(F.col("id") % 50 == 0, 1.0).otherwise(0.05).alias("weight"))
    plans, targets = spark.createDataFrame([(1, 50)], "mix_id int, size_pct int"), spark.createDataFrame([(1, "a", 10000, 1)], "mix_id int, source string, target_bp int, max_repeats int")
    one, many = mixing.mix(docs, plans, targets), mixing.mix(docs, plans, targets, bucket_docs=500)
    assert one.agg(F.sum("size")).first()[0] == many.agg(F.sum("size")).first()[0] == 30_000
    assert one.exceptAll(many).count() == 0


def test_unreached_follows_the_mix(spark, monkeypatch):
    docs, plans, targets = setup(spark)
    rows = mixing.unreached(docs, plans, targets)
    assert {tuple(r) for r in rows.collect()} == {(1, "d"), (1, "none")} and rows.count() == 2
    found = catalog.p7_found(spark, "/root/testdata/sf0.001")
    assert "xxhash64" in found._jdf.queryExecution().optimizedPlan().toString()
    whole = mixing._mixed
    monkeypatch.setattr(mixing, "_mixed", lambda *a, **how: whole(*a, **how).filter("source != 'd'"))
    assert {tuple(r) for r in mixing.unreached(docs, plans, targets).collect()} == {(1, "none")}
