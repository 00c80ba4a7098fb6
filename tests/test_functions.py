import math
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline.functions import calc, embed, keys, splitter, text


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="三角形 Area Ａ12。") == ["三", "角", "形", "三角", "角形", "area", "a12"]
    assert one(spark, text.tokens(F.col("t")), t="") == []
    assert one(spark, text.tokens(F.col("t")), t="角") == ["角"]
    assert one(spark, text.tokens(F.col("t")), t=None) is None


@pytest.mark.parametrize("table,col", [("documents", "text"), ("lexical_documents", "text"), ("education_messages", "content")])
def test_native_tokens_equal_exact(spark, table, col):
    df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").filter(F.col(col).isNotNull())
    assert df.filter(~text.tokens(F.col(col)).eqNullSafe(text.tokens_exact(F.col(col)))).count() == 0


def test_stored_length_counts_tokens(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lexical_documents.parquet").filter("text IS NOT NULL")
    assert df.filter(F.size(text.tokens(F.col("text"))) != F.col("length")).count() == 0


def test_bigrams(spark):
    assert one(spark, text.bigram_set(F.col("t")), t="A b　c") == ["ab", "bc"]
    assert one(spark, text.bigram_set(F.col("t")), t="x") == ["x"]
    assert one(spark, text.bigram_set(F.col("t")), t="  ") == []


def test_redaction(spark):
    assert one(spark, text.hide_stored(F.col("t")), t="打13912345678或a@b.cn，证11010119900101123X") == "打[手机号已隐藏]或[邮箱已隐藏]，证[证件号已隐藏]"
    out = one(spark, text.hide_outgoing(F.col("t")), t="最近会话开始x最近会话结束。我叫小明  ，ｍｙ mail is q@r.com student_id=abc")
    assert "小明" not in out and "q@r.com" not in out and "abc" not in out and "最近会话" not in out
    assert one(spark, text.hide_outgoing(F.col("t")), t="背景 学生当前问题:什么是分数") == "什么是分数"


def test_truncation(spark):
    assert one(spark, text.keep_start(F.col("t"), 5), t="  abcd efgh ") == "abcd…"
    assert one(spark, text.keep_end(F.col("t"), 5), t="abcd efgh") == "…efgh"
    assert one(spark, text.keep_start(F.col("t"), 1), t="abc") == "…"
    assert one(spark, text.one_line(F.col("t"), 4, "…"), t=" a \n b  cdef") == "a b …"


def test_json_and_front_matter(spark):
    assert one(spark, text.json_body(F.col("t")), t='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, text.without_guide(F.col("t")), t="<!-- x\ny -->\nbody") == "body"
    assert one(spark, text.front_matter(F.col("t"), "name"), t="---\nname: sums\n---\nbody") == "sums"


@pytest.mark.parametrize("e,v", [("(25 + 15) * 3", "120"), ("7 ÷ 2", "3.5"), ("2^3 + 1", "9"), ("10 % 3", "1"), ("-7 // 2", "-4"), ("-7 % 3", "2"), ("-2 ** 2", "-4"), ("2 ** -1", "0.5"), ("1e3", "1000")])
def test_calculate(e, v):
    assert calc.calculate(e) == v


@pytest.mark.parametrize("e", ["", None, "1 / 0", "__import__('os')", "2 ** 9", "1" * 121, "9" * 13, "-" * 25 + "1", "1 +", "1 2", "a"])
def test_calculate_refuses(e):
    with pytest.raises(ValueError):
        calc.calculate(e)


@settings(max_examples=200, deadline=None)
@given(st.integers(-999, 999), st.integers(-999, 999), st.sampled_from(["+", "-", "*", "//", "%"]))
def test_calculate_like_python(a, b, op):
    if b == 0 and op in "//%":
        return
    assert calc.calculate(f"({a}) {op} ({b})") == str(eval(f"({a}) {op} ({b})"))


def test_safe_calc(spark):
    df = spark.createDataFrame([("1 + 2",), ("1 / 0",), (None,)], "e string")
    assert [(r.v, r.err is None) for r in df.select(calc.safe_calc("e").alias("r")).select(F.col("r.value").alias("v"), F.col("r.error").alias("err")).collect()] == [("3", True), (None, False), (None, False)]


def test_name_uuid(spark):
    for name in ("a", "chunk:1", "三角形"):
        assert one(spark, keys.name_uuid(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_hash_embedding(spark):
    a = one(spark, embed.hash_embedding(F.col("t"), 1024), t="三角形 area")
    assert len(a) == 1024 and math.isclose(np.linalg.norm(a), 1, rel_tol=1e-6) and a == one(spark, embed.hash_embedding(F.col("t"), 1024), t="三角形 area")
    assert not any(one(spark, embed.hash_embedding(F.col("t"), 128), t="。"))
    with pytest.raises(ValueError):
        embed.hash_embedding(F.col("t"), 64)


def test_splitter():
    assert splitter.split_recursive("abcdefghijklmnopqrstuvwx", 12, 0, [""]) == ["abcdefghijkl", "mnopqrstuvwx"]
    assert splitter.split_recursive("", 10, 2) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。，\n.", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splitter_bounds(t, size, overlap):
    chunks = splitter.split_recursive(t, size, overlap)
    assert all(c == c.strip() and 0 < len(c) <= size for c in chunks)
    assert set("".join(chunks)) >= set("".join(t.split())) - set(" ")
