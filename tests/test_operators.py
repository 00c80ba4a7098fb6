import pytest
from pyspark.sql import functions as F

from lodeline.operators import context, dense, fusion, guard, index, lexical, memory
from lodeline.sources import files


def test_bm25_index_equals_candidates_over_whole_scope(spark):
    docs = spark.createDataFrame([("n", f"c{i}", t, "s", "f") for i, t in enumerate(["ratio ratio fraction", "fraction", "other words", "", "ratio and more"])], "namespace string, chunk_id string, text string, subject string, source string")
    asked = spark.createDataFrame([(1, "n", "ratio ratio")], "query_id int, namespace string, query string")
    a = {r.chunk_id: r.bm25 for r in lexical.bm25(asked, lexical.word_index(docs)).collect()}
    cands = docs.crossJoin(asked.select("query_id", "query"))
    b = {r.chunk_id: r.bm25 for r in lexical.bm25_candidates(cands).collect() if r.bm25 > 0}
    assert a == b and set(a) == {"c0", "c4"}


def ranks(spark, *routes):
    return [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(r)], "query_id int, chunk_id string, rank long") for r in routes]


def fused(spark, routes, weights, k=10):
    return [r.chunk_id for r in fusion.reciprocal_ranks(ranks(spark, *routes), weights, k).orderBy("rank").collect()]


def test_rrf(spark):
    assert fused(spark, (["a", "b"], ["b", "a"]), [0.75, 0.25])[0] == "a"
    assert fused(spark, (["a", "b"], ["b", "a"]), [0.25, 0.75])[0] == "b"
    assert fused(spark, (["dense", "shared"], ["lexical", "shared"]), [0.5, 0.5]) [0] == "shared"
    assert set(fused(spark, (["a"], ["b"]), [1.0, 0.0])) == {"a"}
    assert fused(spark, (["a", "a", "b"], ["b"]), [0.5, 0.5]) == fused(spark, (["a", "b"], ["b"]), [0.5, 0.5])
    for bad in ([0.0, 0.0], [-1.0, 2.0], [float("nan"), 1.0], [1.0]):
        with pytest.raises(ValueError):
            fusion.reciprocal_ranks(ranks(spark, ["a"], ["b"]), bad, 5)
    with pytest.raises(ValueError):
        fusion.reciprocal_ranks(ranks(spark, ["a"]), [1.0], 5, constant=True)


def test_linear(spark):
    df = spark.createDataFrame([(1, "x", 1.0, 0.0), (1, "y", 0.8, 5.0)], "query_id int, chunk_id string, cosine double, bm25 double")
    assert [r.chunk_id for r in fusion.linear(df, 5, 0.65, 0.35).orderBy("rank").collect()] == ["y", "x"]
    assert fusion.candidate_size(2) == 8


def test_rerank(spark):
    cands = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(["first", "second", "third"])] + [(2, "only", 1)], "query_id int, chunk_id string, rank long")
    good = '{"output": {"results": [{"index": 0, "relevance_score": 0.2}, {"index": 1, "relevance_score": 0.9}, {"index": 2, "relevance_score": 0.5}, {"index": 7, "relevance_score": 1}]}}'
    answers = spark.createDataFrame([(1, good), (2, "broken")], "query_id int, answer string")
    rows = fusion.rerank(cands, answers, 2).orderBy("query_id", "final_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in rows] == [(1, "second"), (1, "third"), (2, "only")]
    rows = fusion.rerank(cands, spark.createDataFrame([(1, "{}")], "query_id int, answer string"), 2).orderBy("query_id", "final_rank").collect()
    assert [r.chunk_id for r in rows] == ["first", "second", "only"]


def test_dense_edges(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", [1.0, 0.0, 0.0]), ("f", None)], "id string, vec array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<float>")
    assert [(r.id, round(r.cosine, 4)) for r in dense.dense_top_k(q, v, 5).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.8), ("c", 0.0)]
    assert dense.dense_top_k(q, v, 0).count() == 0
    assert v.filter("id = 'b'").select(dense.cosine(F.col("vec"), F.col("vec")).alias("x")).first()["x"] == pytest.approx(1.0)


def test_compaction(spark):
    m = spark.createDataFrame([("t", i, "user", f"message-{i}") for i in range(12)], "thread_id string, id long, speaker string, content string")
    rows = context.compaction(m, trigger_messages=10, keep=6).orderBy("id").collect()
    assert [r.retained for r in rows] == [False] * 6 + [True] * 6


def test_budget_like_a_loop(spark):
    said = ["很长的一句话" * 6, "", "好", "中等长度的回答在这里", "短"]
    m = spark.createDataFrame([("t", i, "user", s) for i, s in enumerate(said)], "thread_id string, id long, speaker string, content string")
    for budget in (1, 4, 9, 20, 40, 100):
        used, want = 0, []
        for s in reversed(said):
            if not s:
                continue
            line = "学生：" + s
            left = budget - used - bool(want)
            if left < 1:
                break
            if len(line) > left:
                if not want:
                    want.append("…" if left == 1 else line[: left - 1] + "…")
                break
            used += len(line) + bool(want)
            want.append(line)
        got = [r.line for r in context.within_budget(m, 12, budget).orderBy(F.desc("id")).collect()]
        assert got == want, budget


def test_summary(spark):
    df = spark.createDataFrame([("旧摘要", "新的内容" * 500), ("无", "无")], "p string, o string")
    a, b = [r["x"] for r in df.select(context.plain_summary(F.col("p"), F.col("o"), 200).alias("x")).collect()]
    assert a.startswith("此前：旧摘要\n新增：…") and len(a) <= 200 and b == "无"


def test_trust_and_domains(spark):
    assert guard.clean_domains(["https://A.com/x", "a.com", " .b.org. ", ""]) == ["a.com", "b.org"]
    urls = ["https://a.com/x", "http://sub.a.com", "https://nota.com", "ftp://a.com", "https://a.com.evil.net", "nonsense", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r["x"] for r in df.select(guard.is_trusted(F.col("u"), ["a.com"]).alias("x")).collect()] == [True, True, False, False, False, False, False]


def test_consistency(spark):
    df = spark.createDataFrame([(True, [], "ok"), (True, ["violence"], "no"), (False, [], "no"), (False, ["violence"], "why"), (False, ["odd"], "why"), (True, [], "  "), (None, [], "x")], "p boolean, r array<string>, f string")
    assert [r["x"] for r in df.select(guard.is_consistent(F.col("p"), F.col("r"), F.col("f"), ["violence"]).alias("x")).collect()] == [True, False, False, True, False, False, False]


def test_candidates(spark):
    rows = [("t", i, "数学", "题", k, s, c, p) for i, (k, s, c, p) in enumerate([("preference", "英语", "喜欢 图", "0.9"), ("profile", "综合", "男孩", "1"), ("learning_topic", "数学", "x", "2"), ("preference", "综合", "  ", "1"), ("preference", "综合", "好", "bad"), ("preference", "综合", "sixth", "1")])]
    got = memory.screen_candidates(spark.createDataFrame(rows, "turn_id string, pos int, turn_subject string, question string, memory_type string, subject string, content string, confidence string")).orderBy("pos").collect()
    assert [(r.memory_type, r.subject, r.content, r.confidence) for r in got] == [("preference", "数学", "喜欢 图", 0.9), ("learning_topic", "数学", "学生曾询问：题", 1.0)]


def test_turn_messages(spark):
    t = spark.createDataFrame([("u", "t", "打13912345678", "好", "2026-01-01")], "turn_id string, thread_id string, question string, answer string, created_at string")
    assert [r.content for r in memory.turn_messages(t).orderBy("part").collect()] == ["打[手机号已隐藏]", "好"]


def chunk_rows(spark, sources):
    return spark.createDataFrame([(s, h, f"{s}-{h}-{i}", f"text {s} {h} {i}") for s, h in sources for i in range(2)], "source string, file_hash string, chunk_id string, text string")


def test_refresh_equals_rebuild(spark, tmp_path):
    store, settings, build = index.SnapshotStore(spark, str(tmp_path / "a")), {"size": 500}, lambda df: df
    first = chunk_rows(spark, [("a", "1"), ("b", "1"), ("c", "1")])
    assert index.refresh(store, first, settings, build)["added"] == 3
    again = index.refresh(store, first, settings, build)
    assert again["unchanged"] == 3 and again["added"] == 0
    second = chunk_rows(spark, [("a", "1"), ("b", "2"), ("d", "1")])
    r = index.refresh(store, second, settings, build)
    assert (r["added"], r["updated"], r["removed"], r["unchanged"]) == (1, 1, 1, 1)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, second.collect()))
    with pytest.raises(RuntimeError):
        store.read("other digest")
    store.invalidate()
    with pytest.raises(RuntimeError):
        store.read()


def test_replace_source(spark):
    docs = spark.createDataFrame([("n", "1", "a"), ("n", "2", "b")], "namespace string, chunk_id string, source string")
    new = spark.createDataFrame([("n", "3", "a")], docs.schema)
    assert sorted(r.chunk_id for r in index.replace_source(docs, "a", new).collect()) == ["2", "3"]
    with pytest.raises(Exception, match="in use"):
        index.replace_source(docs, "a", spark.createDataFrame([("n", "2", "a")], docs.schema)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "数学基础.TXT").write_bytes("第一行\r\n第二行".encode())
    (tmp_path / "sub" / "x.md").write_text("no")
    rows = files.list_files(spark, str(tmp_path))
    chunks = files.knowledge_chunks(files.load_text(rows), ["数学", "语文"]).collect()
    assert [(c.source, c.subject, c.chunk_index, c.text) for c in chunks] == [("数学基础.TXT", "数学", 0, "第一行\n第二行")]
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception, match="not UTF-8"):
        files.load_text(files.list_files(spark, str(tmp_path))).collect()


def test_plans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/lexical_documents.parquet").select("namespace", "chunk_id", "text", "subject", "source")
    asked = docs.limit(3).select(F.monotonically_increasing_id().alias("query_id"), "namespace", F.col("text").alias("query"))
    plan = lexical.bm25(asked, lexical.word_index(docs), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
