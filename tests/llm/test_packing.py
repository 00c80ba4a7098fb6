import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_first_fit_like_a_scan(sizes):
    sizes = sorted(sizes, reverse=True)
    room, want = [], []
    for x in sizes:
        k = next((i for i, r in enumerate(room) if r >= x), len(room))
        if k == len(room):
            room.append(30)
        room[k] -= x
        want.append(k)
    assert packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 30).tolist() == want


def test_whole_and_within_capacity(spark):
    docs = spark.createDataFrame([(i, (i * 37) % 90, "x") for i in range(500)] + [(900, 250, "x"), (901, 0, "x"), (902, None, "x"), (None, 5, "x"), (7, 259 % 90, "x")], "k long, n long, capacity_id string")
    caps = spark.createDataFrame([(1, 100), (2, 64), (2, 64), (3, 0)], "capacity_id int, capacity_tokens int")
    out = packing.pack(docs, "k", F.col("n"), caps, group_items=100).cache()
    assert out.filter("bin_no IS NULL OR group_no IS NULL").count() == 0
    bins = out.join(caps.distinct(), "capacity_id").groupBy("capacity_id", "group_no", "bin_no").agg(F.sum("part_tokens").alias("used"), F.max("capacity_tokens").alias("most"))
    assert bins.filter("used > most").count() == 0
    for c in (1, 2):
        rows = out.filter(F.col("capacity_id") == c)
        assert rows.select("doc_id").distinct().count() == docs.select("k").distinct().count()
        assert rows.agg(F.sum("part_tokens")).first()[0] == docs.agg(F.sum("n")).first()[0]
        assert rows.filter("parts > 1").select("doc_id").distinct().count() == docs.filter(F.col("n") > (100 if c == 1 else 64)).select("k").distinct().count()
    assert all(r.left_over < 0.1 for r in packing.fill_report(out, caps.filter("capacity_tokens > 0")).collect())
    assert packing.pack(docs.limit(0), "k", F.col("n"), caps).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([("aé字",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(packing.token_size(F.col("t"))).collect()] == [6, 0, 0]
