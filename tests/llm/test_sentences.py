import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeline.llm import sentences, train_sentences


def units(text):
    return [text[a:b] for a, b in sentences.sentence_units(text)]


@pytest.mark.parametrize(
    "want",
    [
        ["Dr. Quill lives in the U.K. now.", "He has 3.5 apples!", "Why?"],
        ["“快来看，云散开了！”团团喊道，大家都抬起头。", "阿梨问：“这是第几题？是第4题吗？”", "为什么影子中午最短呢？"],
        ["『第11题怎么做？』『看图。』小竹和同桌一问一答。", "她想了想……还是把3写在了横线上。"],
        ["Am 2. Mai begegnet Frieda Frau Dr. Halm im Garten.", "„Ist das Nr. 5? Oder Nr. 6?“, fragt Emmo.", "Warum ist der Schatten kurz?"],
        ["Mme. Vasseur dit : « Lis d'abord. Écris ensuite. »", "Il y a 82 cartes dans la boîte."],
        ["La Dra. Olmo dice: «Lee. Luego escribe».", "—¿Es el núm. 5? ¿O el 6? —pregunta Vera.", "¡Qué buena idea!"],
        ["कक्षा में पेन, काग़ज़ आदि. रखे हैं।", "पाठ में तीन क्रियाएँ ढूँढो।", "बहुत बढ़िया!"],
        ["د. هالة تكتب في ص. 18 من الدفتر.", "أحسنت!"],
        ["음... 다온은 다시 생각했습니다.", "참 잘했어요!"],
        ["ขวดหนัก 7.62 กิโลกรัมพอดี", "ขีดเส้นใต้คำกริยาในเรื่องที่อ่าน", "คุณครูนัดเวลา 9.33 น. ที่แปลงผัก"],
    ],
)
def test_sentences(want):
    assert units((" " if want[0].isascii() or any(ord(c) < 0x3000 for c in want[0]) else "").join(want)) == want


def test_layout():
    text = "\nLesson 4: Numbers\r\n\r\n1. Read the question. Then write\r\n2. Check it!\r\n\r\nA line\r\nthat goes on. And more.\n \n"
    assert units(text) == ["Lesson 4: Numbers", "1. Read the question. Then write", "2. Check it!", "A line\r\nthat goes on.", "And more."]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1.!?。！“”\"'()「」…， \n\t　-•ก字", max_size=120))
def test_every_character_belongs_to_one_unit(text):
    spans = sentences.sentence_units(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(c.isspace() or i in covered for i, c in enumerate(text))


def test_viterbi_like_brute_force():
    import itertools
    import random

    pick = random.Random(1)
    w = {f"f{i}": pick.uniform(-2, 2) for i in range(6)} | {f"T{a}1{n}f{i}": pick.uniform(-2, 2) for a in "01" for n in "012" for i in range(6)}
    for _ in range(50):
        chain = [[pick.choice(list("abc")), f"f{pick.randrange(6)}", f"f{pick.randrange(6)}"] for _ in range(5)]
        gaps = [pick.randrange(20) for _ in chain]

        def score(tags):
            total = 0.0
            for i, t in enumerate(tags):
                if t:
                    total += sum(w.get(f, 0) for f in chain[i]) + (w.get(f"T{tags[i - 1]}1{sentences._near(gaps[i])}{chain[i][2]}", 0) if i else 0)
            return total

        best = max(itertools.product((0, 1), repeat=5), key=score)
        assert abs(score(sentences.viterbi(chain, gaps, w)) - score(best)) < 1e-9


def test_held_out_accuracy():
    import pyarrow.parquet as pq

    texts = [t for t in dict.fromkeys(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()) if t and not sentences.THAI.search(t)]
    right = wrong = 0
    for text in texts:
        for s, e, item in sentences.blocks(text):
            part = text[s:e]
            found = sentences.places(part, sentences.NEVER)
            if item or not found or found[0][1][0] == "B":
                continue
            gold = {x for (x, _), y in zip(found, train_sentences.silver(part)) if y and part[x:].strip()}
            got = set(sentences.tag_paragraph(part))
            right += len(gold & got)
            wrong += len(gold ^ got)
    assert right > 5_000 and wrong / right < 0.01


BARE = "今天天气很好我们去公园玩小明带了风筝我带了面包大家玩得很开心后来下雨了我们就回家了妈妈说明天再去"


def test_unpunctuated_stretches_are_cut_whatever_marks_stand_elsewhere():
    text = "种子需要水空气和合适的温度小满把数字圈了出来这道题先求出总数再平均分成六份为什么影子中午最短呢做完以后记得写上单位也要写答句"
    for whole in (text, BARE, BARE[:38]):
        assert len(units(whole)) > 2 and "".join(units(whole)) == whole
        assert units(whole + "。") == [*units(whole)[:-1], units(whole)[-1] + "。"]
        assert units("好的。" + whole + "。")[0] == "好的。"


def test_abbreviations_beyond_a_list_and_other_scripts():
    assert units("Gen. Lee met Capt. Jones at Ft. Sumter. He left.") == ["Gen. Lee met Capt. Jones at Ft. Sumter.", "He left."]
    assert units("Brg. Moll saw the children. He waved.") == ["Brg. Moll saw the children.", "He waved."]
    assert units("Это г. Москва. Он большой.") == ["Это г. Москва.", "Он большой."]
    assert units("ကျွန်တော် ကျောင်းသွားတယ်။ သူ အိမ်မှာ နေတယ်။") == ["ကျွန်တော် ကျောင်းသွားတယ်။", "သူ အိမ်မှာ နေတယ်။"]
    assert units("ሰላም ነው። ደህና ነኝ።") == ["ሰላም ነው።", "ደህና ነኝ።"] and units("Բարև ձեզ։ Լավ եմ։") == ["Բարև ձեզ։", "Լավ եմ։"]


def test_unclosed_marks_are_linear_and_long_quotations_are_whole():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.time()
        sentences.sentence_units("“(" * n + "a. " * n)
        took.append(time.time() - began)
    assert took[1] < 12 * max(took[0], 0.05)
    inner = " ".join("‘Yes.’ ‘No.’" for _ in range(80))
    spans = sentences._pairs("«" + inner + "»")[1]
    assert (0, len(inner) + 1) in spans
    assert len(units("He said: «" + inner + " Go.» Then he left.")) == 2


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n　", 0), (4, "The first one. The second one.", 0), (4, "The first one. The second one.", 0), (None, "x", 0), (5, "长" * 200_000 + "。", 0)], "doc_id long, text string, start_pos int")
    rows = [tuple(r) for r in sentences.split_sentences(df).collect()]
    assert sorted(r for r in rows if r[0] == 4) == [(4, 0, 14), (4, 0, 14), (4, 15, 30), (4, 15, 30)]
    assert (None, 0, 1) in rows and (5, 0, 200_001) in rows and len(rows) == 6
    assert sentences.split_sentences(df.limit(0)).count() == 0
