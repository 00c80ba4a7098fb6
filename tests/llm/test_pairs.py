import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeline.llm import pairs

Q = "老师，水洒在地上，过一会儿为什么不见了？"
A = "水并没有消失，它变成了看不见的水汽。这个过程叫做蒸发，太阳晒得越热，水干得越快。"
EN = "The water is not gone, it has turned into vapour that we cannot see."


@pytest.mark.parametrize(
    "prompt,reply,want",
    [
        (Q, None, "empty"), (Q, " 　", "empty"), (Q, "答：", "empty"), (Q, "N/A", "empty"), (Q, "{}", "empty"), (Q, "……", "empty"), (Q, "​", "empty"),
        (Q, A, None), (Q, "76", None), (Q, "73 × 2 = 146", None), (Q, "146 cm²\n✅", None), (Q, A + "\n答案：50", None), (Q, A + " 加油😊", None), (Q, A + "\n（完）", None),
        (Q, A[:-9], "truncated"), (Q, A[:20] + "，", "truncated"), (Q, "先比整数部分。\n1. 再比十分\n2.", "truncated"), (Q, "长方形的面积等于长乘宽。把数代进去得到27 × 6 = 162", "truncated"),
        (Q, "对不起，这个请求我无法处理。", "refusal"), (Q, "同学你好，恕难从命，请谅解。我们聊点别的吧。", "refusal"), (Q, "我不能替你把作业全写完，不过可以一起想。" + A, None), (Q, "小狐狸嘴上说“对不起，我不能帮你”，心里却一直放不下。", None),
        (Q, Q, "echo"), (Q, "你的问题是：" + Q, "echo"), (Q, "水洒 在地上 过一会儿 为什么不见了", "echo"), (Q, f"{Q}\n{Q}", "echo"), (Q, f"“{Q}”这个问题很好。{A}", None),
        (Q, EN, "other_language"), ("请用英语回答：" + Q, EN, None), ("Why does a puddle disappear after a while?", "El agua no se pierde, se convierte en un vapor que no vemos.", "other_language"),
        ("帮我用 because 造一个英语句子。", "可以写：I took the umbrella because it was raining. 意思是“因为下雨，我带了伞”。", None), (None, A, None),
    ],
)
def test_defects(prompt, reply, want):
    assert pairs.defect_of(prompt, reply) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs_like_a_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert pairs.lcs(a, b) == t[-1][-1] == pairs.lcs(a, b, 0, 3)


def test_edges(spark):
    long = A * 5_000
    df = spark.createDataFrame([(1, Q, None, "x"), (2, None, A, "x"), (3, Q, long, "x"), (3, Q, "N/A", "x"), (3, Q, "N/A", "x")], "defect long, p string, r string, extra string")
    rows = sorted(map(tuple, pairs.pair_defects(df, "p", "r", ["defect"]).collect()))
    assert rows == [(1, "empty"), (3, "empty"), (3, "empty")]
    assert pairs.pair_defects(df.limit(0), "p", "r", ["defect"]).count() == 0
    assert os.path.basename(pairs.__file__) == "pairs.py"


def test_long_refusals():
    assert pairs.is_refusal("", "I'm sorry, but I can't help with that. " * 12)
    assert not pairs.is_refusal("", "I'm sorry, but I can't help with that. " + "The area of the square is the product of its two sides. " * 12)


@pytest.mark.parametrize(
    "reply",
    [
        "I must refuse to answer.", "Sorry, that's not something I can do for you.", "I can’t discuss that topic. Perhaps your teacher knows.", "Mi dispiace, non posso aiutarti con questo.", "Ik kan je daar niet mee helpen.",
        "申し訳ありませんが、その質問にはお答えできません。", "很抱歉，这个问题我不方便回答。", "죄송하지만 그 질문에는 답변해 드릴 수 없습니다.", "Das kann ich leider nicht beantworten.", "Não posso responder a essa pergunta.", "К сожалению, я не могу ответить на этот вопрос.",
    ],
)
def test_refusals_in_other_words(reply):
    assert pairs.defect_of("How long is the river?", reply) == "refusal"


@pytest.mark.parametrize(
    "reply",
    [
        "I can't write it all for you, but we can think: 3 + 4 = 7.", "The fox cannot help him. He is too small.", "You cannot divide by zero, because no number times zero gives five.", "He says “I cannot help you” and runs away.",
        "No puedo darte la solución, pero sumamos los dos números: primero las decenas y luego las unidades.",
    ],
)
def test_help_is_no_refusal(reply):
    assert pairs.defect_of("How does it go on?", reply) != "refusal"


@pytest.mark.parametrize("times", [1, 2, 3, 4, 5, 6, 8, 40])
def test_echo_any_number_of_times(times):
    assert pairs.defect_of(Q, Q * times) == "echo" and pairs.defect_of("ab", "ab" * times * 3) == "echo"


@pytest.mark.parametrize("text", ["2+3=?", "Why?", "7", "为什么？"])
def test_short_echo(text):
    assert pairs.defect_of(text, text) == "echo"
    assert pairs.defect_of(text, "5") is None


def test_banded_alignment_is_exact_where_it_matters():
    import random

    pick = random.Random(3)
    for _ in range(300):
        a = "".join(pick.choices("abcde", k=pick.randrange(1, 90)))
        b = "".join(c for c in a if pick.random() > 0.1) + "".join(pick.choices("abcde", k=pick.randrange(4)))
        full = pairs.lcs(a, b)
        for least in (0, full - 3, full, full + 1):
            got = pairs.lcs(a, b, least, block=7)
            assert got == full if least <= full else got < least
    long = "".join(pick.choices("abcdefgh", k=60_000))
    assert pairs.is_copy(long, long[:30_000] + "x" + long[30_000:])


@pytest.mark.parametrize(
    "text,want",
    [("Der Hund läuft schnell nach Hause", "de"), ("De hond loopt snel naar huis", "nl"), ("The cat sleeps under the table", "en"), ("El gato duerme en la casa", "es"), ("Le chat dort à la maison", "fr"), ("Il gatto dorme nella casa", "it"), ("今天天气很好", "zh"), ("今日はとても良い天気です", "ja"), ("ab", None)],
)
def test_language(text, want):
    assert pairs.language(text) == want


def test_labels_are_empty():
    assert {pairs.defect_of(Q, t) for t in ("La réponse :", "Answer: ", "参考答案：", "[no answer]", "—")} == {"empty"}
