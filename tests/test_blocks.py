import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeline.functions.text import tokenize
from lodeline.operators import dense, lexical
from lodeline.plans import catalog, stored


def made(spark, many=240):
    """Documents of two namespaces and three subjects with words of all frequencies, with copies and without subject, and queries: long, repeated, blank, of unknown words."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=draw.randint(0, 25))) for _ in range(many)]
    texts[7:10] = [texts[6]] * 3
    docs = [("n" + str(i % 5 > 0), f"c{draw.random():.9f}", t, ("x", "y", None)[i % 3], "f") for i, t in enumerate(texts)]
    asked = [(f"q{i}", "n1", "xy"[i % 2], texts[i * 3] + " w3 w3") for i in range(30)] + [("blank", "n1", "x", ""), ("unknown", "n1", "x", "other"), ("nowhere", "n2", "x", "w1"), ("none", "n0", None, "w1 w2")]
    return (
        docs, asked, spark.createDataFrame(docs, "namespace string, chunk_id string, text string, subject string, source string"),
        spark.createDataFrame(asked, "query_id string, namespace string, subject string, query string"),
    )


def looped(docs, asked, k, by_subject):
    out = {}
    for q, namespace, subject, query in asked:
        own = [(c, Counter(tokenize(t))) for n, c, t, s, _ in docs if n == namespace and (not by_subject or subject is not None and s == subject)]
        mean = sum(sum(w.values()) for _, w in own) / max(1, len(own)) or 1.0
        df = Counter(t for _, w in own for t in w)
        scored = []
        for c, w in own:
            score = sum(math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.5 / (w[t] + 1.5 * (0.25 + 0.75 * sum(w.values()) / mean)) for t in set(tokenize(query)) if t in w)
            if round(score, 6) > 0:
                scored.append((-round(score, 6), c))
        out |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("by_subject", [False, True])
@pytest.mark.parametrize("sizes", [{}, {"COLUMNS": 0}, {"DENSE": 10**9, "SUB": 4}, {"EXPANDED": 50, "ENTRIES": 40, "PASS_TERMS": 90}])
def test_bm25_like_a_loop(spark, monkeypatch, by_subject, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    docs, asked, d, q = made(spark)
    for k in (7, 200):
        rows = lexical.bm25(q, lexical.word_index(d), k, by_subject).collect()
        want = looped(docs, asked, k, by_subject)
        assert {(r.query_id, r["rank"]): r.chunk_id for r in rows} == {x: c for x, (c, _) in want.items()}
        assert all(r.bm25 == pytest.approx(want[r.query_id, r["rank"]][1], abs=2e-6) for r in rows)
    assert lexical.bm25(q, lexical.word_index(d), 0, by_subject).count() == 0


def shuffled(df, name="shuffleRecordsWritten"):
    """Rows that its exchanges wrote, or another of their metrics, after it ran."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        metric = node.metrics().get(name)
        total += metric.get().value() if metric.isDefined() and node.nodeName() == "Exchange" else 0
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("by_subject", [False, True])
def test_bm25_shuffles_no_pairs(spark, by_subject):
    """bm25_topk and bm25_subject_topk: what is shuffled is the best of each task and the documents, not each query with each document."""
    docs = spark.range(3_000).select(F.lit("n").alias("namespace"), F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("red w"), F.col("id") % 7).alias("text"), F.lit("x").alias("subject"), F.lit("f").alias("source"))
    asked = docs.limit(40).select(F.col("chunk_id").alias("query_id"), "namespace", "subject", F.col("text").alias("query"))
    df = lexical.bm25(asked, lexical.word_index(docs), 5, by_subject)
    assert df.count() == 200 and shuffled(df) < 40_000  # 120 000 pairs


def test_stored_index_is_narrow(spark, tmp_path):
    """bm25_subject_topk: the stored index repeats neither the texts nor the words of a document, and holds copies once."""
    rows = [("n", str(i % 50), "一句很长的话" * 200 + str(i % 50), "x", "f") for i in range(100)]
    spark.createDataFrame(rows, "namespace string, chunk_id string, text string, subject string, source string").write.parquet(f"{tmp_path}/lexical_documents.parquet")
    held = stored.word_index(spark, str(tmp_path))
    assert set(held.documents.columns) == {"doc", "namespace", "chunk_id", "subject", "source", "length", "terms", "tfs"}
    got = held.documents.orderBy("doc").collect()
    assert [r.chunk_id for r in got] == sorted(str(i) for i in range(50)) and all(len(set(r.terms)) == len(r.terms) == len(r.tfs) < 15 and sum(r.tfs) == r.length for r in got)
    assert held.sizes.first()["n_docs"] == 50 and held.texts.count() == 100


def test_counted_words():
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2, 3], "words": pa.array([["a", "b", "a"], [], ["b"]], pa.list_(pa.string()))})
    out = next(lexical._counted(iter([batch, batch.slice(1)]))).to_pylist()
    assert [dict(zip(r["terms"], r["tfs"], strict=True)) for r in out] == [{"a": 2, "b": 1}, {}, {"b": 1}] and [r["length"] for r in out] == [3, 0, 1]
    out = list(lexical._counted(iter([batch.slice(1)])))[0].to_pylist()
    assert [r["terms"] for r in out] == [[], ["b"]]


def test_vectors_stay_where_they_lie(spark):
    """search_scoped: neither comparing vectors nor removing their copies shuffles them."""
    rows = spark.range(4_000).select(F.lit("c").alias("collection_name"), (F.col("id") % 3_900).cast("string").alias("chunk_id"), F.transform(F.sequence(F.lit(1), F.lit(200)), lambda x: (x * (F.col("id") % 3_900)).cast("float")).alias("embedding"))
    vectors = dense.one_vector(rows)
    assert vectors.count() == 3_900 and shuffled(vectors, "dataSize") < 500_000  # bytes, of 3 200 000
    asked = vectors.limit(10).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    df = dense.dense_top_k(asked, rows.filter("length(chunk_id) > 0").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec")), 5)
    assert df.count() == 50 and shuffled(df) < 1_000


def test_least_usable_vector(spark):
    rows = [("c", "1", [2.0]), ("c", "1", [1.0]), ("c", "1", [float("nan")]), ("c", "2", [float("inf")]), ("c", None, [4.0]), ("c", None, [3.0]), ("b", "1", [9.0]), ("c", "3", None)]
    df = spark.createDataFrame(rows, "collection_name string, chunk_id string, embedding array<float>")
    assert sorted((r[0], r[1] or "", r[2][0]) for r in dense.one_vector(df).collect()) == [("b", "1", 9.0), ("c", "", 3.0), ("c", "1", 1.0)]
    found = dense.vectors_of(spark.createDataFrame([("1",), ("2",), ("4",)], "chunk_id string"), df).collect()
    assert [(r.chunk_id, r.collection_name, r.embedding[0]) for r in found] == [("1", "b", 9.0)]


@pytest.mark.parametrize("block", [20_000, 6])
def test_dense_like_a_loop(spark, monkeypatch, block):
    """Many equal vectors, so that ties are cut by id, in more blocks and passes than one."""
    monkeypatch.setattr(dense, "SUB", 3)
    draw = np.random.default_rng(3)
    vectors = [(f"v{i:03}", ["a", "b"][i % 2], [float(x) for x in draw.integers(-1, 2, 2 + (i % 7 == 0))]) for i in draw.permutation(150)]
    v = spark.createDataFrame(vectors, "id string, s string, vec array<float>")
    q = v.filter("id < 'v020'").select(F.col("id").alias("query_id"), "s", F.col("vec").alias("query_vec"))
    got = {(r.query_id, r["rank"]): (r.id, round(r.cosine, 6)) for r in dense.dense_top_k(q, v.repartition(5), 9, scope="s", block=block).collect()}
    want = {}
    for name, scope, x in vectors:
        if name < "v020":
            near = []
            for other, s, y in vectors:
                if s == scope and len(x) == len(y):
                    size = float(np.linalg.norm(x) * np.linalg.norm(y))
                    near.append((-round(float(np.dot(x, y)) / size, 6) if size else 0.0, other))
            want |= {(name, n + 1): (o, -c) for n, (c, o) in enumerate(sorted(near)[:9])}
    assert got == want


@pytest.mark.parametrize("name", ["rrf_fuse", "search_rendered", "search_topk"])
def test_search_reads_each_route_once(spark, name):
    """Both routes of a search keep the best in the tasks that read; neither deals rows out to pairs of blocks nor sums pairs of a query and a document behind an exchange."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "CoGroups" not in plan and "query_id#" in plan and ", doc#" in plan
