from collections import Counter

import numpy as np

from lodeline.llm import pii, train_pii


def found(text):
    return [(k, text[s:e]) for s, e, k in pii.find_spans([text])[0]]


#: Written by hand, with frames, names and addresses that the training does not hold; N, E, P, I and A mark what must be found.
BY_HAND = """
Good morning, <N:Margaret Okafor> speaking, could you explain fractions once more?
We are the family of <N:Daniel Whitcombe> and he missed class today.
You can write to <E:m.okafor77@brightmail.org> or phone <P:020 7946 0812> after five.
If lost, return to <A:14 Harrow Hill Road, Kelby>, it is my only copy.
The card number on it is <I:AB123456C> and I cannot read the rest.
Signed with love, <N:Peter Lindgren>
Reach us on <P:+44 161 496 0345>, thank you.
My cousin <N:Aisha Rahman> solved it differently.
Please mail the sheet to <E:tom_baker@school-post.net>.
Our flat is <A:Flat 9, 22 Mill Lane, Ashby>.
老师您好，我是<N:赵明轩>，今天的作业我没听懂。
孩子叫<N:林晓彤>，请老师多关照，电话<P:13812345678>。
请把资料寄到<A:长春市南关区人民大街88号3单元502室>，谢谢。
我的邮箱是<E:xiaolin2015@example.cn>，晚上能收到。
报名要写<I:110105201203154321>，对吗？
<N:周雨桐>问这道题怎么做。
我和<N:孙浩然>都算出来是十二。
有问题请打<P:010-62345678>。
家在<A:青云县河口镇石桥村18号>，离学校很远。
——<N:吴佳怡>
Bonjour, c'est <N:Mathilde Garnier>, j'ai une question sur les angles.
Mon papa <N:Julien Fabre> ne sait pas non plus.
Envoyez la fiche au <A:8 rue des Lilas, 69003 Lyon> s'il vous plaît.
On peut m'appeler au <P:06 12 34 56 78> ce soir.
Voici mon adresse : <E:lea.garnier@poste.example>
Guten Tag, mein Name ist <N:Friedrich Baumann> und ich verstehe die Aufgabe nicht.
Wir sind zu Hause in der <A:Lindenstraße 27, 50674 Köln>.
Meine Oma <N:Helga Schuster> hilft mir sonst.
Ruft uns bitte unter <P:0221 4567890> zurück.
Schreib mir an <E:f.baumann@schule.example> bitte.
Buenas, soy <N:Valentina Cordero> y no entiendo el problema.
Mi abuela <N:Rosa Quintero> dice que está bien.
Estamos en la <A:Calle Mayor 45, 28013 Madrid>.
El teléfono de casa es <P:912 345 678>.
Mi DNI es el <I:12345678Z>, ¿lo apunto?
How many legs do seven spiders have?
Why does the wolf in the story blow down the house?
What is 4815162342 divided by 2?
长方形的周长怎么求？
小红有12个苹果，小明有8个，一共有多少个？
Read page 214 of the book 978-3-16-148410-0.
Combien font 125 fois 8 ?
Wie spät ist es, wenn der Zeiger auf der 6 steht?
¿Cuántos lados tiene un hexágono?
圆的面积公式是什么？
""".strip().split("\n")
KINDS = {"N": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}


def by_hand():
    import re

    out = []
    for line in BY_HAND:
        text, spans = "", set()
        for part in re.split(r"(<[NEPIA]:[^>]*>)", line):
            if part.startswith("<"):
                spans.add((len(text), len(text) + len(part) - 4, KINDS[part[1]]))
                part = part[3:-1]
            text += part
        out.append((text, spans))
    return out


def test_held_out_by_hand():
    rows = by_hand()
    hit = Counter()
    for (text, want), got in zip(rows, pii.find_spans([t for t, _ in rows]), strict=True):
        for kind in pii.TYPES:
            a, b = {x for x in got if x[2] == kind}, {x for x in want if x[2] == kind}
            hit[kind, "both"] += len(a & b)
            hit[kind, "extra"] += len(a - b)
            hit[kind, "missed"] += len(b - a)
            for s, e, _ in b - a:
                print("missed", kind, text[s:e], "|", text)
            for s, e, _ in a - b:
                print("extra", kind, text[s:e], "|", text)
    print({k: {w: hit[k, w] for w in ("both", "extra", "missed")} for k in pii.TYPES})
    both, extra, missed = (sum(hit[k, w] for k in pii.TYPES) for w in ("both", "extra", "missed"))
    assert both / (both + missed) > 0.55 and both / (both + extra) > 0.65


def test_made_anew():
    import random

    pick = random.Random(404)
    maker = train_pii.Maker({k: ["这里有一道题。" if k == "zh" else "Here is a task."] for k in train_pii.FRAMES}, pick)
    rows = [maker.message() for _ in range(600)]
    both = want = got = 0
    for (_, spans), mine in zip(rows, pii.find_spans([t for t, _ in rows]), strict=True):
        both, want, got = both + len(set(spans) & set(mine)), want + len(spans), got + len(mine)
    assert both / want > 0.85 and both / got > 0.85


def test_windows_decide_globally():
    text = "这道题怎么做？" * 40 + "我的邮箱是anna.lee@example.com，谢谢！" + "再讲一遍好吗？" * 40
    assert ("email", "anna.lee@example.com") in found(text)
    assert found("") == [] and found("。") == []


def test_trimming_only_cuts_or_completes_words():
    text = "（我叫 Anna Lee，）"
    assert [text[slice(*pii.trimmed(text, a, b))] for a, b in ((3, 13), (5, 11), (0, 13))] == ["Anna Lee", "Anna Lee", "我叫 Anna Lee"]
    assert pii.trimmed("，。", 0, 2)[0] >= pii.trimmed("，。", 0, 2)[1]


def test_numpy_network_matches_its_gradient():
    """The loss falls along the negative gradient."""
    rng = np.random.default_rng(0)
    net = train_pii.Net(list("abc0"), rng)
    ids, cls = rng.integers(0, 5, (6, 3)), rng.integers(0, 16, (6, 3))
    y = np.zeros((6, 3), np.int64)
    y[2], y[3] = 1, 2
    losses = [net.step(ids, cls, y, np.array([6, 5, 4]), 5e-3) for _ in range(30)]
    assert losses[-1] < 0.5 * losses[0]


def test_gradients():
    rng = np.random.default_rng(0)
    net = train_pii.Net(list("abcd"), rng)
    ids = rng.integers(0, 5, (5, 2))
    length, y = np.array([5, 3]), rng.integers(0, len(pii.TAGS), (5, 2))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    emit = rng.standard_normal((5, 2, len(pii.TAGS)))
    loss, grad, g = net.crf(emit, y, length)
    for t, b, k in ((0, 0, 1), (2, 1, 3), (4, 0, 0)):
        shifted = emit.copy()
        shifted[t, b, k] += 1e-5
        assert abs((net.crf(shifted, y, length)[0] - loss) / 1e-5 - grad[t, b, k]) < 1e-3
    assert grad[4, 1].sum() == 0 and ids.shape == (5, 2)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \u3000", "x"), (4, "mail me at bob.day@example.org", "x"), (4, "mail me at bob.day@example.org", "x"), (5, "字" * 50_000, "x")], "id int, t string, pii_type string")
    rows = [(r.id, r.pii_type, r.pii_text) for r in pii.find_pii(df, "t", ["id"]).collect()]
    assert [r for r in rows if r[0] == 4] == [(4, "email", "bob.day@example.org")] * 2 and not [r for r in rows if r[0] < 4]
    hidden = {r.id: r.t for r in pii.redact(df, "t").collect()}
    assert hidden[1] is None and hidden[2] == "" and hidden[4] == "mail me at <EMAIL>"
    assert pii.find_pii(df.limit(0), "t", ["id"]).count() == 0
