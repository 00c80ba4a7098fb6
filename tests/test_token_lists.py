from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeline.functions import text
from lodeline.operators import lexical

ODD = ["三角形 Area Ａ12。", "", None, "角", "İstanbul K2 ℃ Straße ẞ ²³¹ºª", "a.b-c'd_e..f -g- １２．５", "一\n二三 a\nb", "㐀䶿䷀一鿿ꀀ𠀀二", "x" * 50 + "水" * 50, "\U0001f600三\x00四"]


def test_token_lists_equal_tokens(spark):
    """bm25_topk: what the index reads of texts is what the native expression reads, odd characters and neighbouring texts included."""
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", F.coalesce(text.tokens(F.col("t")), F.array().cast("array<string>")).alias("words")).toPandas()
    assert [Counter(w) for w in text.token_lists(pa.array(df["t"], pa.string())).to_pylist()] == [Counter(w) for w in df["words"]]
    assert text.token_lists(pa.array([], pa.string())).to_pylist() == [] and text.token_lists(pa.array([None, ""], pa.string())).to_pylist() == [[], []]


@pytest.mark.parametrize("col,name", [("text", "documents"), ("text", "lexical_documents"), ("content", "education_messages")])
def test_token_lists_equal_tokens_of_tables(spark, col, name):
    df = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").filter(F.col(col).isNotNull()).select(F.col(col).alias("t"), text.tokens(F.col(col)).alias("words")).toPandas()
    assert [Counter(w) for w in text.token_lists(pa.array(df["t"], pa.string())).to_pylist()] == [Counter(w) for w in df["words"]]


def test_batches_of_texts_are_cut(monkeypatch):
    monkeypatch.setattr(lexical, "TEXTS", 20)
    texts = ["ab cd " * 9, "", None, "ef", "gh ij" * 3, None]
    out = list(lexical._counted(lexical._worded(iter([pa.RecordBatch.from_pydict({"doc": list(range(6)), "text": pa.array(texts)})]))))
    assert len(out) > 1 and [r["doc"] for b in out for r in b.to_pylist()] == list(range(6))
    assert [r["length"] for b in out for r in b.to_pylist()] == [18, 0, 0, 1, 4, 0]


def test_index_takes_texts_by_batches(spark):
    """bm25_topk: texts are tokenised as they come in Arrow batches, not by an expression that builds every token as a string."""
    docs = spark.createDataFrame([("n", "c", "a b a", "x", "f")], "namespace string, chunk_id string, text string, subject string, source string")
    made = lexical.index_documents(docs)
    assert "regexp_extract_all" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.length, dict(zip(r.terms, r.tfs, strict=True))) for r in made.collect()] == [(3, {"a": 2, "b": 1})]
