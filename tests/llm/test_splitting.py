import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline.llm import splitting


def tiled(text, pieces):
    return "".join(text[s + shared : e] for s, e, shared, _ in pieces) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n。，#-字é́", max_size=400), st.integers(4, 60), st.integers(0, 3))
def test_pieces_tile_and_overlap(text, most, overlap):
    pieces = splitting.split_text(text, most, overlap)
    assert tiled(text, pieces) and all(0 <= s < e <= len(text) and e - s <= most for s, e, *_ in pieces if text)
    for (_, e, _, kind), (s, _, shared, _) in zip(pieces, pieces[1:]):
        assert e - s == shared <= overlap
        if kind == "soft":
            assert re.match(r"[\W_]|\s", text[e - 1]) or re.match(r"[\W_]|\s", text[e])
    if len(text) > most:
        unbroken = max((len(m) for m in splitting.RUN.findall(text)), default=0)
        assert any(k == "hard" for *_, k in pieces) == (unbroken > most)


def test_structure_first():
    text = "# One\n\n" + "a b. " * 8 + "\n\n# Two\n\n" + "c d. " * 8
    pieces = splitting.split_text(text, 60, 0)
    assert [text[s:e].startswith("# ") for s, e, *_ in pieces] == [True, True]


def test_wrapped_lines_do_not_beat_sentences():
    prose = " ".join(f"This is sentence number {i} of a page with many small words in it." for i in range(60))
    wrapped = re.sub(r"(.{1,58}) ", r"\1\n", prose)
    pieces = splitting.split_text(wrapped, 501, 40)
    assert len(pieces) > 8 and all(wrapped[:e].rstrip().endswith(".") for _, e, *_ in pieces)


def test_lists_nest():
    items = "".join(f"- item {i}\n" + "".join(f"  - part {i}.{k} with some words\n" for k in range(4)) for i in range(8))
    pieces = splitting.split_text("Things:\n" + items, 250, 0)
    assert all(("Things:\n" + items)[s:].startswith("- item") for s, *_ in pieces[1:])
    deep = splitting.split_text("- a\n" + "".join(f"  - b{k} some words here. And more\n" for k in range(30)), 200, 0)
    assert all(x[0] == 0 or ("- a\n" + "".join(f"  - b{k} some words here. And more\n" for k in range(30)))[x[0] :].startswith("  - b") for x in deep)


def test_headings_have_depths():
    text = "".join(f"第{c}章 头\n\n" + "".join(f"第{n}节 名\n\n" + "字句。" * 12 + "\n\n" for n in "一二三") for c in "一二三四")
    pieces = splitting.split_text(text, 150, 0)
    assert [text[s:][:3] for s, *_ in pieces] == ["第一章", "第二章", "第三章", "第四章"]
    assert len(splitting.split_text("<p>" + "word " * 30 + "</p><p>" + "term " * 30 + "</p>", 160, 0)) == 2


def test_runs_too_long_to_share():
    text = "x" * 95 + " " + "y" * 95
    pieces = splitting.split_text(text, 100, 20)
    assert tiled(text, pieces) and all(k == "soft" for *_, k in pieces) and len(pieces) == 2 and pieces[1][2] == 5
    assert [k for *_, k in splitting.split_text("z" * 250, 100, 20)] == ["hard", "hard", "hard", "soft"]


def test_edges(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", "", 2), ("e", "a b c d e f", 3), ("e", "a b c d e f", 3)], "piece string, t string, extra int")
    rows = splitting.split_oversized(df, "t", ["piece"], 5, 1).collect()
    assert rows[0].piece_key == "k" and rows[0].piece == "" and len(rows) == 1 + 2 * len(splitting.split_text("a b c d e f", 5, 1))
    assert splitting.split_oversized(df.limit(0), "t", ["piece"], 5, 1).count() == 0
    assert splitting.cut_kinds(df, "t", ["extra"], 5, 1).collect() == [(3, "soft")]
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "t", ["piece"], 5, 5)


def test_very_long(spark):
    df = spark.createDataFrame([(1, "字" * 2_000_000), (2, "ab " * 700_000)], "id int, t string")
    got = {r.id: r.n for r in splitting.split_oversized(df, "t", ["id"], 500, 60).groupBy("id").agg(F.sum(F.length("piece") - F.col("shared_chars")).alias("n")).collect()}
    assert got == {1: 2_000_000, 2: 2_100_000}
