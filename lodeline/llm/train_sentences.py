"""Training of the sentence model: python -m lodeline.llm.train_sentences DIR [OUT].

Labels come from a careful reading of the punctuation (`silver`) over at most
SAMPLE_DOCS documents. For scripts without end marks the paragraphs' edges
tell how sentences begin and end, and text of unspaced scripts is
stripped of its punctuation after it was labelled. The model is an averaged
structured perceptron over the chains the operator decodes.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from lodeline.llm import sentences as S

SAMPLE_DOCS, ROUNDS, SEED = 6_000, 6, 17
TALK_ROUNDS = 250
#: Labelled by hand: talks of sentences in order. {A} stands for an abbreviation that a name follows, {N} for a name.
TALKS = """
{A} {N} met {A} {N} at {A} {N}.|He left.|It was late.
We saw {A} {N}.|She waved.|Then it rained.
{A} {N} and {A} {N} live on {N} Rd. near the lake.|Do you know them?
The parcel came from {N} Ltd. in {N}.|Nobody opened it.
I like {N}.|He sings.|We all do.
We met {N}.|He ran home.|Have you seen {N}?|No.
The captain, {A} {N}, called {A} {N}.|They sailed to Ft. {N}.|She came too.
My friend is called {N}.|{N} is ten.|She reads a lot.
Read vol. 3 first.|Then see p. 14 and fig. 2 there.|That is all.
It weighs approx. 5 kg.|That is a lot.
The shop opens at 9 a.m. on Mondays.|It closes at 6 p.m.|Come early.
Bring pens, paper, etc.|We start soon.
He was born in {N} in 1990.|In 1998 he moved.
Это г. {N}.|Он большой.|Мы живём на ул. {N}.
Он родился в 1990 г. в деревне.|Потом он уехал.
Мы купили хлеб, сыр и т. д.|Потом пошли домой.
Проф. {N} читает лекцию.|Её слушают все.|Это интересно.
У нас было 5 тыс. рублей.|Этого мало.
Il sig. {N} abita in via {N}.|La dott. {N} è sua vicina.|Sono amici.
Ho letto il cap. 4.|Era bello.|Poi ho dormito.
O sr. {N} mora na av. {N}.|A dra. {N} é a vizinha.|Eles são amigos.
Li o cap. 2.|Gostei muito.
Dhr. {N} woont in de {N}str. in {N}.|Hij is aardig.|Zijn kat ook.
Dat kost ca. 5 euro.|Dat is niet veel.
Herr Dipl. {N} wohnt in {N}.|Er ist nett.|Das ist z. B. wichtig.
Wir treffen uns am 3. Mai in {N}.|Danach gehen wir heim.
Sie hat ca. 20 Hefte.|Die sind neu.
M. {N} et Mme {N} habitent av. {N}.|Ils sont gentils.
Voir p. 12 et suiv. pour la suite.|Merci.
El Lic. {N} vive en la c. {N}.|Es amable.|Tiene aprox. 40 años.
La Sra. {N} llegó con el Ing. {N}.|Comieron juntos.
""".strip().split("\n")
#: Abbreviations before a name, besides random ones.
TITLES = "Gen Capt Ft Lt Sgt Maj Col Cpl Adm Rev Hon Mt St Gov Sen Rep Dr Prof Mr Mrs Ms Fr Br Sr Supt Insp Cmdr Pres Esq Msgr Dir Mgr Mlle Mme Hr Frl Sig Avv Ing Arq Lic Dra Sra Dña".split()
SYLLABLES = "ba be bo da de di fa ga go ha he ja jo ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve wi za".split()
#: Abbreviations that stand before something, and those that may end a sentence.
BEFORE = set(
    "dr prof mrs mr ms st no nos nr p pp s abb fig figs ch chap cf vs e.g i.e approx avg b z d ca pág págs núm n.º sr sra srta dra m mme mlle mm av janv févr sept oct nov dec déc jan feb apr aug hr fr frau j k ee ص د पृ डॉ ver vol ed eds ej ex ext tel est art kap bd evtl ggf vgl bsp inkl sog u.a z.b d.h gen col sgt capt rev hon mt ft st. p.ej p.ex v al आदि".split()
)
MAY_END = set("etc usw u.k u.s u.s.a uu a.m p.m a.m. co inc ltd jr bzw kg cm ff".split())
ORDINAL_BEFORE = set("am die der den dem das in vom zum zur im des ab bis seit".split())


def silver(text: str) -> list[int]:
    """Labels of the places of a paragraph that has end marks."""
    back, spans = S._pairs(text)
    out, last = [], 0
    for e, _ in S.places(text, S.NEVER):
        s = e
        while s > last and (text[s - 1] in S.END or s - 1 in back or text[s - 1] in S.CLOSERS or text[s - 1] in "   "):
            s -= 1
        label = _is_end(text, s, e, back, spans, last)
        out.append(int(label))
        last = e if label else last
    return out


def _is_end(text: str, s: int, e: int, back: dict, spans: list, last: int) -> bool:
    mark, rest = text[s:e].strip(), text[e:].lstrip()
    ends = [c for c in mark if c in S.END]
    if not ends:
        return False
    first = next(i for i in range(s, e) if text[i] in S.END)
    if any(o < first and c >= e for o, c in spans):
        return False
    if rest[:1] in set(",，、;；:：)»") or rest[:1] in "—–" and rest[1:2].isspace():
        return False
    if not rest:
        return True
    closed = [back[i] for i in range(first, e) if i in back]
    if closed and mark[-1] not in S.END:
        o = closed[0]
        if text[o] in "《〈":
            return False
        led = text[last:o].strip()[-1:]
        if not led:
            return text[o] in "（(" and not any(text[x] not in "（(" for x in closed)
        return led in ":：，," or text[o] in "（(" and led in S.END
    if closed and text[closed[0]] in "《" and mark[-1] not in S.END:
        return False
    since = text[last:first].strip()
    if "…" in mark or ".." in mark:
        return not (len(since) <= 6 or len(since) <= 12 and len(since.split()) <= 2 or rest[:1].islower() and rest[:1].isascii() or "…" in mark and S.UNSPACED.match(rest) and not S._shape(text[first - 1]) == "0" and len(since) <= 6)
    if any(c in S.STRONG for c in mark):
        return True
    word = S.left_word(text, first).lower()
    tight = e < len(text) and not text[e].isspace()
    nxt = rest[:1]
    if word in BEFORE or word.strip(".") in BEFORE or re.fullmatch(r"\(?[^\W\d_]", word) or re.search(r"(?:^|[^\w.])(?:e\.g|i\.e|z\.b|dr|no|ver|p|ch|fig|nr|vol|v)$", re.sub(r"[^\x00-\x7f]", " ", word)):
        return False
    if word.strip(".") in MAY_END or re.fullmatch(r"(?:[a-z]\.)+[a-z]", word):
        return nxt.isupper() and rest[1:2].islower() if tight else not nxt.islower() or rest[1:2].isupper()
    if tight:
        if nxt.isdigit() or nxt.islower() and nxt.isascii() and not rest[1:2].isupper():
            return False
        return not re.fullmatch(r"[a-z]?", word) or True
    if word.isdigit() and nxt.isupper():
        prior = text[last:first].split()
        lead = prior[-2].lower().strip("(") if len(prior) > 1 else ""
        if lead in ORDINAL_BEFORE and re.search(r"\b(?:der|die|das|und|ist|Uhr|begegnet|kommt|Mai|Stunde)\b", text):
            return False
    if nxt.islower() and nxt.isascii() and not rest[1:2].isupper():
        return len(word) > 3
    return True


def talk(line: str, pick: random.Random) -> tuple[str, set[int]]:
    """A text of hand-labelled sentences, with names and abbreviations put in, and where its sentences end."""

    def name(_: re.Match) -> str:
        word = "".join(pick.choices(SYLLABLES, k=pick.choice([1, 2, 2, 3]))) + pick.choice(["", "", "n", "r", "l", "s", "ck", "th"])
        return word.title() if len(word) > 2 else word.title() + "b"

    def short(_: re.Match) -> str:
        return (pick.choice(TITLES) if pick.random() < 0.6 else "".join(pick.choices("bcdfghklmnprstvwz", k=pick.choice([2, 2, 3]))).title()) + "."

    text, ends = "", set()
    for sentence in line.split("|"):
        text += (" " if text else "") + re.sub(r"\{A\}", short, re.sub(r"\{N\}", name, sentence))
        ends.add(len(text))
    return text, ends


def usual_stretch(docs: list[str]) -> int:
    """The length that all but one in a thousand stretches between marks have at most, in paragraphs of unspaced scripts that are written with marks."""
    lengths = []
    for text in docs:
        for s, e, _ in S.blocks(text):
            if S.UNSPACED.search(text[s:e]) and S.CLUSTER.search(text[s:e]):
                lengths += [len(m[0]) for m in S.STRETCH.finditer(text[s:e]) if len(S.UNSPACED.findall(m[0])) > 0.6 * len(m[0])]
    lengths.sort()
    return lengths[int(0.999 * (len(lengths) - 1))] if lengths else 40


def edges(docs: list[str]) -> tuple[Counter, Counter]:
    """How paragraphs of scripts without end marks begin and end."""
    begin, end = Counter(), Counter()
    for text in docs:
        for s, e, item in S.blocks(text):
            part = S.DIGITS.sub("0", text[s:e].strip())
            if not item and S.THAI.match(part) and len(part) > 15:
                begin[part[:5]] += 1
                end[part[-5:]] += 1
    return begin, end


def spaced_labels(text: str, begin: Counter, end: Counter) -> list[int]:
    """Labels of a paragraph of a script without end marks: a place between a usual end and a usual beginning is a boundary."""
    marked, out = dict(zip([e for e, _ in S.places(text, S.NEVER)], silver(text), strict=True)), []
    back, spans = S._pairs(text)
    for e, feats in S.places(text, S.NEVER):
        if feats[0] != "S":
            out.append(marked[e])
            continue
        left, right = S.DIGITS.sub("0", text[:e].rstrip())[-5:], S.DIGITS.sub("0", text[e:].lstrip())
        thai_left, thai_right = bool(S.THAI.match(left[-1:])), bool(S.THAI.match(right[:1]))
        inside = any(o < e <= c for o, c in spans)
        ends, begins = end[left] >= 2 or not thai_left, begin[right[:5]] >= 2 or not thai_right and right[:1].isupper()
        out.append(int(not inside and ends and begins and (thai_left or thai_right) and not left[-1:].isdigit()))
    return out


def stripped(text: str) -> tuple[str, list[int]] | None:
    """A paragraph of an unspaced script without its punctuation, and the labels of its places."""
    cuts, chars, ends = set(e for (e, _), y in zip(S.places(text, S.NEVER), silver(text), strict=True) if y), [], set()
    for i, c in enumerate(text):
        if i in cuts:
            ends.add(len(chars))
        if c.isalnum():
            chars.append(c)
    bare = "".join(chars)
    found = S.places(bare, 0)
    return (bare, [int(e in ends) for e, _ in found]) if found and found[0][1][0] == "B" else None


def train(chains: list[tuple[list[list[str]], list[int], list[int]]]) -> dict[str, float]:
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    rng, step = random.Random(SEED), 1
    for r in range(ROUNDS):
        rng.shuffle(chains)
        wrong = n = 0
        for feats, gaps, gold in chains:
            guess = S.viterbi(feats, gaps, w)
            n += len(gold)
            if guess != gold:
                wrong += sum(a != b for a, b in zip(guess, gold, strict=True))
                for tags, sign in ((gold, 1.0), (guess, -1.0)):
                    for i, t in enumerate(tags):
                        if not t:
                            continue
                        near = S._near(gaps[i]) + feats[i][2]
                        for f in [*feats[i], *([f"T{tags[i - 1]}1{near}"] if i and not set(feats[i][2]) & set(S.STRONG) else [])]:
                            w[f] += sign
                            total[f] += sign * step
            step += 1
        print(f"round {r + 1}: {wrong} of {n} places wrong", flush=True)
    return {f: round(v - total[f] / step, 3) for f, v in w.items() if abs(v - total[f] / step) >= 0.05}


def main(data: str, out: str = str(S.MODEL)) -> None:
    texts = [t for t in dict.fromkeys(pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist()) if t and t.strip()]
    random.Random(SEED).shuffle(texts)
    held, docs = texts[SAMPLE_DOCS : SAMPLE_DOCS + 1_500], texts[:SAMPLE_DOCS]
    begin, end = edges(docs)
    usual = usual_stretch(docs)
    pick = random.Random(SEED)
    talks = []
    for _ in range(TALK_ROUNDS):
        for line in TALKS:
            text, ends = talk(line, pick)
            found = S.places(text, S.NEVER)
            talks.append(([f for _, f in found], [b - a for a, b in zip([0] + [x for x, _ in found], [x for x, _ in found], strict=False)], [int(e in ends) for e, _ in found]))

    def chains_of(some: list[str]) -> list:
        chains = []
        for text in some:
            for s, e, item in S.blocks(text):
                part = text[s:e]
                found = [] if item else S.places(part, usual)
                if not found:
                    continue
                marked = [e for e, _ in S.places(part, S.NEVER)]
                yes = {e for e, y in zip(marked, spaced_labels(part, begin, end) if S.THAI.search(part) else silver(part), strict=True) if y}
                gold = [int(e in yes) for e, _ in found]
                chains.append(([f for _, f in found], [b - a for a, b in zip([0] + [x for x, _ in found], [x for x, _ in found], strict=False)], gold))
                if S.UNSPACED.search(part) and len(part) < 400 and (bare := stripped(part)):
                    found = S.places(bare[0], 0)
                    chains.append(([f for _, f in found], [1] * len(found), bare[1]))
        return chains

    w = train(chains_of(docs) + talks) | {S.BARE_KEY: usual}
    with open(out, "w", encoding="utf-8") as file:
        json.dump(dict(sorted(w.items())), file, ensure_ascii=False, separators=(",", ":"))
    right = tp = fp = fn = 0
    for feats, gaps, gold in chains_of(held):
        guess = S.viterbi(feats, gaps, w)
        right += guess == gold
        for g, y in zip(guess, gold, strict=True):
            tp, fp, fn = tp + (g & y), fp + (g & (1 - y)), fn + ((1 - g) & y)
    print(f"{len(w)} weights; held out: boundaries precision {tp / max(1, tp + fp):.4f}, recall {tp / max(1, tp + fn):.4f}")


if __name__ == "__main__":
    main(*sys.argv[1:])
