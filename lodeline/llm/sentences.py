"""Problem 8: sentence boundaries across languages and scripts.

Method: every character is tagged as boundary (a unit ends behind it) or inside
by a linear-chain model decoded with Viterbi. A character that can't end a
unit (no end mark, closing mark or space behind it) is inside whatever its
neighbours are, so runs of them fold into one step of the chain and only
the open places are scored. For scripts written without end marks the places
are the spaces. In scripts written without spaces every character of a stretch
that is longer than stretches between marks are, whatever marks stand elsewhere,
is a place; their weights are trained on text with its punctuation stripped, and
the usual length of stretches is learned there too.

The layout fixes the rest: blank lines end a unit, list items are one unit each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = Path(__file__).with_name("models") / "sentences.json"
#: End marks of the scripts trained on, and those of all others in Unicode, which count like a danda.
KNOWN_END = ".!?。！？｡．؟।॥…‥۔"
END = KNOWN_END + "".join(c for c in map(chr, range(0x10000)) if c not in KNOWN_END and regex.match(r"\p{STerm}", c))
AS_DANDA = str.maketrans({c: "।" for c in END[len(KNOWN_END) :]})
STRONG = "".join(c for c in END if c not in ".…‥")
PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "„": "“", "‹": "›", "»": "«"}
MARK = re.compile("[" + re.escape("\"'—–" + "".join(PAIRS) + "".join(PAIRS.values())) + "]")
CLOSERS = "”’」』»）)]】》〉›"
CLUSTER = re.compile(f"[{re.escape(END)}]+(?:[   ]?[{re.escape(END)}]+)*")
SOUTHEAST = "฀-໿"  # Thai and Lao, which write no end marks
AS_THAI = {c: c - 0x80 for c in range(0x0E80, 0x0F00)}  # the two blocks run in parallel
SPACED = re.compile(f"(?<=[{SOUTHEAST}”\"»)0-9A-Za-z])\\s+(?=[^\\s])")
THAI = re.compile(f"[{SOUTHEAST}]")
UNSPACED = re.compile("[぀-ヿ㐀-鿿]")
STRETCH = regex.compile(r"[^\s\p{P}\p{S}]+")
BARE_KEY, NEVER = "#bare", float("inf")
ITEM = re.compile(r"\s*(?P<mark>[-–—•*·◦▪●○■□]|(?P<open>[（(]?)(?P<no>\d{1,3}|[一二三四五六七八九十]{1,3}|[a-zA-Z]|[ivxIVX]{1,4})(?P<close>[.)）．、])|[①-⑳㈠-㈩⒈-⒛])(?P<gap>\s*)")
WORD_LEFT = re.compile(r"[^\s“”„«»\"'‘’（）()\[\]【】《》「」『』。！？!?…,，;；:：、]*$")
WORD_RIGHT = re.compile(r"[^\s.!?。！？…,，;；:：“”„«»\"'‘’（）()、।؟]+")
VOWEL = re.compile("[aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüýаеёиоуыэюяіїєαεηιουω]")
DIGITS = re.compile(r"\d+")
NEXT = re.compile(r"\S")
LINE = re.compile(r"[^\r\n]+")
BREAK = re.compile(r"\r\n|\r|\n")


GLUED = re.compile(r"(?:[^\W_]{3,}|\d)[.!?]+([^\W\d_].*)$")


def left_word(text: str, end: int) -> str:
    """Word before a mark; where a sentence follows the last without a space, only what belongs to it."""
    word = WORD_LEFT.search(text, max(0, end - 24), end)[0]
    glued = GLUED.search(word)
    return glued[1] if glued else word


def _near(gap: int) -> str:
    return "0" if gap < 6 else "1" if gap < 14 else "2"


def _shape(c: str) -> str:
    if not c:
        return "$"
    if c.isdigit():
        return "0"
    if UNSPACED.match(c):
        return "C"
    if THAI.match(c):
        return "T"
    if c.isalpha():
        return "U" if c.isupper() else "l" if c.islower() else "L"
    return c


def _pairs(text: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Closing position -> opening position, and all (open, close) spans, for quotes, brackets and dialogue dashes. Linear: every opening is put on the stack and taken off once."""
    stack: list[tuple[str, int]] = []
    depths: dict[str, list[int]] = {}  # of each awaited closer, the depths it stands at
    back: dict[int, int] = {}

    def close(i: int, depth: int) -> None:
        back[i] = stack[depth][1]
        while len(stack) > depth:
            depths[stack.pop()[0]].pop()

    def await_(c: str, i: int) -> None:
        depths.setdefault(c, []).append(len(stack))
        stack.append((c, i))

    for m in MARK.finditer(text):
        i, c = m.start(), m[0]
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        top = depths[c][-1] if depths.get(c) else None
        if c in "\"'":
            if top is not None and (c == '"' or not after.isalnum()):
                close(i, top)
            elif c == '"' or (not before.isalnum() and after.isalnum()):
                await_(c, i)
        elif c in "—–":
            if top is not None and before.isspace() and not after.isspace():
                close(i, top)
            elif (i == 0 or before.isspace()) and after and not after.isspace():
                await_(c, i)
        elif top is not None:
            close(i, top)
        elif c in PAIRS and not (c == "»" and before.isspace() is False and before != "" and after.isspace()):
            await_(PAIRS[c], i)
    return back, sorted((o, c) for c, o in back.items())


def places(text: str, bare: float | None = None) -> list[tuple[int, list[str]]]:
    """Open places of a paragraph: (end of a possible unit, features), in order. `bare` is the length beyond which every character of a stretch of an unspaced script is a place (by default the learned one)."""
    if not text:
        return []
    bare = weights()[BARE_KEY] if bare is None else bare
    back, spans = _pairs(text)
    found: list[tuple[int, str, int]] = []  # end, kind, start of the cluster
    for m in CLUSTER.finditer(text):
        s, e = m.span()
        if m[0] in ".．" and s and text[s - 1].isdigit() and text[e : e + 1].isdigit():
            continue
        while True:
            if e < len(text) and (e in back or text[e] in CLOSERS) and text[e] not in "—–":
                e += 1
            elif e + 1 < len(text) and text[e] in "   " and text[e + 1] == "»" and e + 1 in back:
                e += 2
            else:
                break
        while e < len(text) and text[e] in END:
            e += 1
        if found and found[-1][0] >= e:
            continue
        found.append((e, "end", s))
    if THAI.search(text):
        taken = {e for e, _, _ in found}
        found += [(m.start(), "space", m.start()) for m in SPACED.finditer(text) if m.start() not in taken and (THAI.match(text[m.start() - 1]) or THAI.match(text[m.end()]))]
        found.sort()
    elif UNSPACED.search(text):
        taken = {e for e, _, _ in found}
        for m in STRETCH.finditer(text):
            if m.end() - m.start() > bare and len(UNSPACED.findall(m[0])) > 0.6 * len(m[0]):
                found += [(i, "bare", i) for i in range(m.start() + 2, m.end() - 1) if i not in taken]
        found.sort()
    out, last, at, reach = [], 0, 0, -1
    for e, kind, s in found:
        while at < len(spans) and spans[at][0] < s:  # spans come by their opening, so the furthest closing so far tells
            reach = max(reach, spans[at][1])
            at += 1
        out.append((e, _bare(text, e) if kind == "bare" else _features(text, s, e, kind, reach >= e, back, last)))
        last = last if kind == "bare" else e
    return out


def _features(text: str, s: int, e: int, kind: str, inside: bool, back: dict[int, int], last: int) -> list[str]:
    shown = NEXT.search(text, e)
    at = shown.start() if shown else len(text)
    rest = text[at : at + 40]
    gap = "n" if "\n" in text[e:at] else "s" if at > e else "-"
    right = _shape(rest[:1]) + (_shape(rest[1:2]) if rest[:1].isalpha() and rest[:1].isascii() else "")
    if kind == "space":
        left, ahead = DIGITS.sub("0", text[max(last, e - 14) : e]).translate(AS_THAI), DIGITS.sub("0", rest[:14]).translate(AS_THAI)
        out = ["S", f"S in{inside}", f"S{_shape(left[-1:])}{right}"]
        out += [f"SL{n}{left[-n:]}" for n in (2, 4, 6, 9)] + [f"SR{n}{ahead[:n]}" for n in (2, 4, 6, 9)]
        return out + [f"SX{left[-3:]}|{ahead[:3]}"]
    mark = text[s:e]
    ends = "".join(dict.fromkeys(c for c in mark.translate(AS_DANDA) if c in END))
    if "..." in mark or len(ends) == 1 and ends == "." and mark.count(".") > 1:
        ends = "…"
    word = left_word(text, s)
    low = DIGITS.sub("0", word.lower())[-10:]
    before = text[max(0, s - len(word) - 12) : s - len(word)].split()
    earlier = DIGITS.sub("0", before[-1].lower())[-6:] if before else "^"
    ahead = WORD_RIGHT.match(rest)
    ahead = DIGITS.sub("0", ahead[0].lower())[:8] if ahead else rest[:1]
    since = text[last:s].strip()
    length = "0" if len(since) <= 6 else "1" if len(since) <= 12 and len(since.split()) <= 2 else "2"
    closed = [back[i] for i in range(s, e) if i in back]
    out = ["E", f"E in{inside}", f"E{ends}", f"E{ends}|{gap}|{right}", f"E{ends}|{length}", f"E{ends}|{length}|{right}"]
    if closed:
        o = closed[-1]
        led = text[max(0, o - 40) : o].rstrip()[-1:]
        opening = "^" if not text[last:o].strip() else ":" if led in ":：," else "，" if led in "，、" else "w"
        many = "2" if s - o > 0 and any(c in END for c in text[o:s]) else "1"
        out += [f"Q{text[e - 1]}{opening}", f"Q{text[o]}{opening}|{right[:1]}", f"Q{opening}{gap}{right}", f"Q{opening}|{ahead}", f"Q{opening}{many}", f"Q{mark[-1] in END}{opening}"]
    elif "." in ends and not inside:
        shape = "".join(dict.fromkeys(_shape(c) for c in word[-6:])) + ("1" if len(word) == 1 else "2" if len(word) <= 3 else "3")
        out += [f".{low}", f".{low}|{right}", f".{shape}|{gap}{right}", f".{shape}", f".{low}|{ahead}", f".{earlier}|{shape}|{right[:1]}", f".{'d' if '.' in word else '-'}{shape}|{gap}{right}"]
        sound = "n" if not VOWEL.search(low) else "c" if not VOWEL.search(low[-2:]) else "v"
        out += [f".{sound}{shape}|{right}", f".{sound}{shape}{'^' if not since[: -len(word)].strip() else ''}"]
    return out


def _bare(text: str, i: int) -> list[str]:
    """Features of a place in text without end marks or spaces."""
    return ["B"] + [f"BL{text[max(0, i - n) : i]}" for n in (1, 2, 3, 4)] + [f"BR{text[i : i + n]}" for n in (1, 2, 3, 4)] + [f"BX{text[i - 1 : i + 1]}"]


@cache
def weights() -> dict[str, float]:
    return json.loads(MODEL.read_text(encoding="utf-8"))


def viterbi(chain: list[list[str]], gaps: list[int], w: dict[str, float]) -> list[int]:
    """Best tags (1: boundary) of a chain of places; `gaps` are the characters between them."""
    inside, edge, back = 0.0, float("-inf"), []
    first = True
    for feats, gap in zip(chain, gaps, strict=True):
        score = sum(w.get(f, 0.0) for f in feats)
        near = _near(gap) + feats[2]
        if first:
            to_edge = score
            back.append((0, 0))
            inside, edge, first = 0.0, to_edge, False
            continue
        bb, ib = w.get(f"T11{near}", 0.0), w.get(f"T01{near}", 0.0)
        from_edge, from_inside = edge + bb, inside + ib
        back.append((int(edge > inside), int(from_edge > from_inside)))
        inside, edge = max(inside, edge), max(from_edge, from_inside) + score
    tags = []
    tag = int(edge > inside)
    for b in reversed(back):
        tags.append(tag)
        tag = b[tag]
    return tags[::-1]


def tag_paragraph(text: str, w: dict[str, float] | None = None) -> list[int]:
    """Ends of the units inside a paragraph, without its own end."""
    found = places(text)
    ends = [e for e, _ in found]
    tags = viterbi([f for _, f in found], [b - a for a, b in zip([0, *ends], ends, strict=False)], weights() if w is None else w)
    return [e for e, t in zip(ends, tags, strict=True) if t and text[e:].strip()]


def _kind(m: re.Match | None) -> tuple[str, str] | None:
    if m is None:
        return None
    if m["no"] is None:
        return ("m", m["mark"]) if m["gap"] or m["mark"] in "•◦▪●○■□①②③④⑤⑥⑦⑧⑨⑩" else None
    if m["open"] == "" and m["close"] == "." and not m["gap"]:
        return None
    if not m["no"].isdigit() and m["close"] == "." and len(m["no"]) > 1:
        return None
    return ("d" if m["no"].isdigit() else "a", m["open"] + m["close"])


def _paragraphs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of lines that aren't blank, as (start, end) of each line."""
    held: list[tuple[int, int]] = []
    for m in LINE.finditer(text):
        if held and len(BREAK.findall(text, held[-1][1], m.start())) > 1:
            yield held
            held = []
        if m[0].isspace():
            if held:
                yield held
            held = []
        else:
            held.append(m.span())
    if held:
        yield held


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Paragraphs and list items of a text: (start, end, is an item).

    A line starts an item if its paragraph's first line has a mark of the same kind, or if the line before ends in a colon.
    """
    for lines in _paragraphs(text):
        kinds = [_kind(ITEM.match(text, a, b)) for a, b in lines]
        listed, start, item = kinds[0], lines[0][0], kinds[0] is not None and (kinds[0][0] != "a" or len(lines) > 1 and kinds[0] in kinds[1:])
        if not item:
            listed = None
        for (a, _), kind, (_, prev) in zip(lines[1:], kinds[1:], lines[:-1], strict=True):
            if kind and (kind == listed or listed is None and text[:prev].rstrip()[-1:] in ":：" and kinds.count(kind) > 1):
                yield start, prev, item
                start, item, listed = a, True, kind
        yield start, lines[-1][1], item


def sentence_units(text: str) -> list[tuple[int, int]]:
    """Units (start, end) of a text in characters, without white space at either end."""
    out = []
    for s, e, item in blocks(text):
        cuts = [] if item else [s + c for c in tag_paragraph(text[s:e])]
        for a, b in zip([s, *cuts], [*cuts, e], strict=True):
            part = text[a:b]
            if core := part.strip():
                a += len(part) - len(part.lstrip())
                out.append((a, a + len(core)))
    return out


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row id, start_pos, end_pos for each sentence unit, in characters from 0, end exclusive.

    Every character that is not white space belongs to exactly one unit. Null, empty and blank texts give no rows; repeated rows give repeated units; texts of any length are read whole. Columns besides the two
    are left out; a null id is kept as it is. `partitions` spreads the rows over that many tasks.
    """
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_text")).filter(F.col("_text").isNotNull())
    rows = rows.repartition(partitions) if partitions else rows
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, found = [], []
            for i, text in zip(pdf["_id"], pdf["_text"], strict=True):
                spans = sentence_units(text)
                at += [i] * len(spans)
                found += spans
            yield pd.DataFrame({id_col: pd.Series(at, dtype=pdf["_id"].dtype), "start_pos": [a for a, _ in found], "end_pos": [b for _, b in found]})

    return rows.mapInPandas(units, schema)
