import os

import pytest
from pyspark.sql import functions as F

from lodeline import config
from lodeline.functions import calc, text
from lodeline.operators import backend, dense, fusion, index, lexical, search
from lodeline.plans import sqlapi
from lodeline.sources.tables import shared_dir

ROWS = "source string, file_hash string, chunk_id string, text string"


def test_refresh_writes_only_touched_buckets(spark, tmp_path):
    store = index.SnapshotStore(spark, str(tmp_path / "s"))
    rows = [(f"f{i}", "1", f"c{i}", "x") for i in range(40)]
    first = spark.createDataFrame(rows, ROWS)
    assert index.refresh(store, first, {}, lambda df: df, buckets=8)["rows"] == 40
    before = store.current()["parts"]
    second = spark.createDataFrame([("f0", "2", "c0b", "y"), *rows[1:39], ("new", "1", "n", "z")], ROWS)
    out = index.refresh(store, second, {}, lambda df: df, buckets=8)
    assert (out["updated"], out["added"], out["removed"], out["unchanged"], out["rows"]) == (1, 1, 1, 38, 40)
    after = store.current()["parts"]
    assert 0 < sum(before[k] == after.get(k) for k in before) < len(before)
    assert store.read().exceptAll(second).count() == 0 and second.exceptAll(store.read()).count() == 0
    assert index.refresh(store, second, {}, lambda df: df, buckets=8)["unchanged"] == 40 and store.current()["parts"] == after
    assert index.rebuild(store, first, {}, lambda df: df, buckets=8)["rows"] == 40 and store.read().count() == 40


def test_pointer(spark, tmp_path):
    store = index.SnapshotStore(spark, str(tmp_path / "p"))
    assert store.current() is None and not store.is_ready("d")
    with pytest.raises(RuntimeError):
        store.read()
    store.commit(spark.range(3), "d")
    assert store.is_ready("d") and store.read("d").count() == 3
    with pytest.raises(RuntimeError):
        store.read("other")
    with pytest.raises(RuntimeError):
        store.commit(spark.range(5), "e", check=lambda df: df.count() == 4)
    assert store.read("d").count() == 3
    (tmp_path / "p" / "CURRENT").write_text("{")
    for crc in (tmp_path / "p").glob(".CURRENT*.crc"):
        os.remove(crc)
    with pytest.raises(RuntimeError):
        store.current()


def test_copy_and_sets(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int")
    copy = index.copy_verified(rows, index.SnapshotStore(spark, str(tmp_path / "c")), ["k"], "x")
    assert copy.count() == 3
    diff = {tuple(r) for r in index.copy_differences(rows, spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int"), ["k"], ["k", "v"]).collect()}
    assert diff == {("a", "missing"), ("b", "missing"), ("c", "extra")}
    ids = rows.select(F.col("k").alias("chunk_id"))
    index.assert_same_ids(ids, ids)
    with pytest.raises(ValueError):
        index.assert_same_ids(ids, ids.filter("chunk_id = 'a'"))
    assert index.property_issues({"dimension": "3"}, {"dimension": "4"}) and not index.property_issues({"a": "1"}, {"a": "1", "b": "2"})


def test_refused_at_run_time(spark):
    vec = spark.createDataFrame([("c", "1", [1.0, 2.0], '{"chunk_id": "2"}')], "collection_name string, chunk_id string, embedding array<float>, metadata_json string")
    held = vec.drop("metadata_json")
    with pytest.raises(Exception, match="metadata names another chunk"):
        index.upsert_vectors(held, vec).collect()
    old, new = (spark.createDataFrame([("f", h, "c", "x")], ROWS) for h in "12")
    with pytest.raises(Exception, match="not current"):
        index.keyword_sync_plan(index.manifest(old), index.manifest(new), old.filter("false")).collect()
    with pytest.raises(Exception, match="can't be used"):
        spark.createDataFrame([([1.0, float("nan")],)], "v array<float>").select(dense.usable_or_raise(F.col("v"), F.lit("x"))).collect()
    with pytest.raises(TypeError):
        dense.matches(F.col("m"), {"a": 1.5})
    with pytest.raises(Exception, match="no JSON"):
        spark.sql("SELECT named_struct('x', double('NaN')) AS s").select(text.metadata_json(F.col("s"))).collect()
    with pytest.raises(Exception, match="blank chunk id"):
        fusion.reciprocal_ranks([spark.createDataFrame([(1, " ", 1)], "query_id int, chunk_id string, rank int")], [1.0], 5).collect()


def test_parquet_index(spark, tmp_path):
    store = backend.ParquetIndex(spark, str(tmp_path), "talk", 2)
    rows = spark.createDataFrame([("a", [1.0, 0.0], '{"subject": "x"}'), ("b", [0.0, 1.0], '{"subject": "y"}')], "chunk_id string, embedding array<float>, metadata_json string")
    assert store.count() == 0 and store.upsert(rows) == 2 and store.upsert(rows) == 2
    asked = spark.createDataFrame([(1, [1.0, 0.2])], "query_id int, query_vec array<float>")
    assert [r.chunk_id for r in store.search(asked, 1).collect()] == ["a"] and [r.chunk_id for r in store.search(asked, 5, {"subject": "y"}).collect()] == ["b"]
    assert store.search(asked, 0).count() == 0
    with pytest.raises(ValueError):
        store.upsert(rows.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")))
    assert store.delete(rows.filter("chunk_id = 'a'").select("chunk_id")) == 1 and [r[0] for r in store.ids().collect()] == ["b"]
    with pytest.raises(ValueError):
        backend.ParquetIndex(spark, str(tmp_path), "talk", 3)
    store.reset()
    assert store.count() == 0


def test_search_guards(spark):
    docs = spark.createDataFrame([("n", "1", "red apple", "x", "s"), ("n", "2", "red pear", "y", "s"), ("n", "3", "", "x", "s")], "namespace string, chunk_id string, text string, subject string, source string")
    vectors = spark.createDataFrame([("c", "1", "x", [1.0, 0.0]), ("c", "2", "y", [0.9, 0.1])], "collection_name string, chunk_id string, subject string, embedding array<float>")
    asked = spark.createDataFrame([(1, "n", "c", "red", [1.0, 0.0], "综合"), (2, "n", "c", "red", [1.0, 0.0], "y"), (3, "n", "c", "red", [1.0, 0.0], None)], "query_id int, namespace string, collection_name string, query string, query_vec array<float>, subject string")
    held = lexical.word_index(docs)
    for k in (0, True, 1.5):
        with pytest.raises(ValueError):
            search.search(asked, held, vectors, k=k)
    with pytest.raises(RuntimeError):
        search.search(asked, held, vectors, ready=lambda: False)
    got = {}
    for r in search.search(asked, held, vectors, k=2).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {1: {"1", "2"}, 2: {"2"}, 3: {"1", "2"}}
    answers = spark.createDataFrame([(1, '{"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}]}')], "query_id int, answer string")
    first = [r.chunk_id for r in search.search(asked.filter("query_id = 1"), held, vectors, k=1, answers=answers).collect()]
    assert first == ["2"]


def test_scorer_that_fails_keeps_the_order(spark):
    cands = spark.createDataFrame([(1, "q", str(i), i, "t" * i) for i in range(1, 5)], "query_id int, query string, chunk_id string, rank int, text string")

    def broken(_, __):
        raise OSError("down")

    assert [r.chunk_id for r in fusion.score_candidates(cands, 2, broken).orderBy("final_rank").collect()] == ["1", "2"]
    assert [r.chunk_id for r in fusion.score_candidates(cands, 2, lambda q, t: [len(x) for x in t]).orderBy("final_rank").collect()] == ["4", "3"]
    assert fusion.score_candidates(cands, 4, broken).filter("rerank_score IS NOT NULL").count() == 0


def test_heights_of_sums():
    assert calc.calculate("+".join("1" * 20)) == "20" and calc.calculate("(" * 30 + "7" + ")" * 30) == "7"
    for bad in ("+".join("1" * 22), "-" * 25 + "1"):
        with pytest.raises(ValueError):
            calc.calculate(bad)


def test_settings(tmp_path):
    assert config.settings({"rerank": "yes", "results": 3}).rerank
    for bad in ({"chunk_overlap": 500}, {"results": 0}, {"results": True}, {"dense_weight": -1.0}, {"nope": 1}, {"rerank": "perhaps"}, {"dense_weight": 0, "lexical_weight": 0}, {"results": 30}):
        with pytest.raises(ValueError):
            config.settings(bad)
    (tmp_path / "a.json").write_text('{"pool": 40}')
    assert config.load(str(tmp_path / "a.json")).pool == 40


def test_sql_functions(spark):
    sqlapi.register(spark)
    row = spark.sql("SELECT safe_calc('2 × (3+4)').value AS a, tokens('Ａ12 三角') AS b, hide_stored('打13812345678') AS c").first()
    assert (row.a, row.b, row.c) == ("14", ["a12", "三", "角", "三角"], "打[手机号已隐藏]")


def test_shared_dir_of_a_local_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
