"""Problem 1: cutting oversized texts at natural boundaries.

Method: structure-tree packing. A text over the limit is parsed into a tree:
sections nested by the depth of their headings, blocks parted by blank lines or
markup, lists with items nested by indentation, then sentences, lines, clauses
and words. Subtrees that fit are units; adjacent sibling units are merged from
the left up to the limit; only oversized nodes are descended into. Inside a run
without any separator that alone exceeds the largest piece there is no natural
place, and the cut is `hard`.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.common import keyed, renamed

HEADING = regex.compile(
    r"""^[^\S\n]*(?:(?P<hash>\#{1,6})[^\S\n]+\S
    |<h(?P<tag>[1-6])[\s>]
    |第[\d一二三四五六七八九十百]+(?P<han>[课課章节節单單部回])[^。！？\n]{0,40}$
    |(?P<count>[一二三四五六七八九十]+)、[^。！？\n]{0,40}$
    |(?P<word>part|partie|teil|parte|unit|chapter|chapitre|kapitel|cap[íi]tulo|tema|lesson|le[çc]on|lektion|lecci[óo]n|บทที่|पाठ|الدرس)\s*\d+[^\n.!?。！？]{0,60}$
    |(?P<dots>\d+(?:\.\d+)+)\s+[^\n.!?。！？]{1,60}$)""",
    regex.X | regex.M | regex.I,
)
#: Depths of headings that state their kind; numbers such as 1.1 lie below them.
DEPTH = dict.fromkeys("部", 1) | dict.fromkeys("单單章", 2) | dict.fromkeys("课課回", 3) | dict.fromkeys("节節", 4)
PARTS, CHAPTERS = ("part", "partie", "teil", "parte"), ("unit", "chapter", "chapitre", "kapitel", "capítulo", "capitulo", "tema")
ITEM = regex.compile(r"^(?P<indent>[^\S\n]*)(?:[-*+•◦▪●○■□–—·]|[(（]?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4}|[一二三四五六七八九十]{1,3})[.)）．、]|[①-⑳])[^\S\n]*\S", regex.M)
#: Indents of lists are told apart up to this many characters.
DEEPEST = 64
BLOCK = regex.compile(r"\n[^\S\n]*\n\s*|</(?:p|li|ul|ol|div|section|article|table|tr|h[1-6]|blockquote|pre)>\s*|<(?:br|hr)\s*/?>\s*", regex.I)
LINE = regex.compile(r"\n+")
SENTENCE = regex.compile(r"""(?:[。！？｡．…؟।॥]+|[.!?]+(?=[\s"'”’」』»)\]）]))["'”’」』»)\]）]*\s*""")
CLAUSE = regex.compile(r"""[,;:，、；：،؛—–]+["'”’」』»)\]）]*\s*""")
WORD = regex.compile(r"[\s\p{P}\p{Z}]+")
RUN = regex.compile(r"[^\s\p{P}\p{Z}]+")

OUT = ("piece_no", "start_pos", "end_pos", "shared_chars", "cut_kind", "piece")


def _depth(m: regex.Match) -> int:
    if m["hash"] or m["tag"]:
        return len(m["hash"] or "") or int(m["tag"])
    if m["han"]:
        return DEPTH[m["han"]]
    if m["word"]:
        word = m["word"].casefold()
        return 1 if word in PARTS else 2 if word in CHAPTERS else 3
    return 3 + m["dots"].count(".") if m["dots"] else 5


class _Text:
    """A text with its headings and list items, found once."""

    def __init__(self, text: str) -> None:
        self.text = text
        heads = [(m.start(), _depth(m)) for m in HEADING.finditer(text)]
        items = [(m.start(), min(len(m["indent"]), DEEPEST)) for m in ITEM.finditer(text)]
        self.nested = [([p for p, _ in marks], [d for _, d in marks]) for marks in (heads, items)]

    def outer(self, which: int, s: int, e: int) -> list[int]:
        """Starts of the outermost headings or items inside a node, without its own first line."""
        at, depth = self.nested[which]
        lo, hi = bisect_right(at, s), bisect_left(at, e)
        top = min(depth[lo:hi], default=0)
        return [at[i] for i in range(lo, hi) if depth[i] == top]

    def ends(self, pattern: regex.Pattern, s: int, e: int) -> list[int]:
        return [m.end() for m in pattern.finditer(self.text, s, e) if m.end() < e]


#: Ways to cut a node, from the outside in, and whether what they yield may be cut the same way again.
LEVELS: list[tuple[Callable[[_Text, int, int], list[int]], bool]] = [
    (lambda t, s, e: t.outer(0, s, e), True), (lambda t, s, e: t.ends(BLOCK, s, e), False), (lambda t, s, e: t.outer(1, s, e), True),
    *((lambda t, s, e, p=p: t.ends(p, s, e), False) for p in (SENTENCE, LINE, CLAUSE, WORD)),
]


def _units(t: _Text, s: int, e: int, level: int, limit: int, most: int) -> list[tuple[int, int, bool]]:
    """Packed units (start, end, ends in a hard cut) that tile [s, e)."""
    if e - s <= limit:
        return [(s, e, False)]
    while level < len(LEVELS):
        cuts = LEVELS[level][0](t, s, e)
        if cuts:
            break
        level += 1
    else:
        return _leaf(t.text, s, e, limit, most)
    again = level if LEVELS[level][1] else level + 1
    packed: list[tuple[int, int, bool]] = []
    for a, b in zip([s, *cuts], [*cuts, e], strict=True):
        for unit in _units(t, a, b, again, limit, most):
            if packed and not packed[-1][2] and unit[1] - packed[-1][0] <= limit:
                packed[-1] = (packed[-1][0], unit[1], unit[2])
            else:
                packed.append(unit)
    return packed


def _leaf(text: str, s: int, e: int, limit: int, most: int) -> list[tuple[int, int, bool]]:
    """A run without separators, maybe with separators behind it."""
    if e - s <= most:
        return [(s, e, False)]
    run = RUN.match(text, s, e)
    mid = run.end() if run else s
    out: list[tuple[int, int, bool]] = []
    if mid - s > most:
        a = s
        while mid - a > limit:
            b = a + limit
            while b > a + 1 and unicodedata.category(text[b])[0] == "M":  # keep marks with their letter
                b -= 1
            if b == a + 1:
                b = a + limit
            out.append((a, b, True))
            a = b
        out.append((a, mid, False))
    elif mid > s:
        out.append((s, mid, False))
    out.extend((a, min(a + limit, e), False) for a in range(mid, e, limit))
    return out


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces (start, end, characters shared with the piece before, cut kind of the end)."""
    if len(text) <= max_chars:
        return [(0, len(text), 0, "soft")]
    pieces = []
    for s, e, hard in _units(_Text(text), 0, len(text), 0, max_chars - overlap, max_chars):
        shared = min(overlap, max_chars - (e - s), s)
        pieces.append((s - shared, e, shared, "hard" if hard else "soft"))
    return pieces


def split_oversized(df: DataFrame, text_col: str, keys: Sequence[str], max_chars: int, overlap_chars: int) -> DataFrame:
    """One row for each piece of each text.

    Columns: `keys`, piece_no from 0, start_pos and end_pos in characters (end exclusive), shared_chars, cut_kind of the
    piece's end (`hard` only inside a run of more than max_chars characters without a natural boundary) and piece. Pieces have at most max_chars characters;
    each shares overlap_chars characters with the one before, fewer only where an uncuttable run leaves less room. Without the shared
    parts the pieces of a text tile it. A text within the limit, the empty one too, is one piece; a null text gives none. Repeated input
    rows give repeated pieces. Columns that are no keys are left out; see `keyed` for clashing names. Raises ValueError unless 0 <= overlap_chars < max_chars.
    """
    if not 0 <= overlap_chars < max_chars:
        raise ValueError("overlap_chars must be at least 0 and less than max_chars")
    inner, names = keyed(df.filter(df[text_col].isNotNull()), keys, OUT, _text=df[text_col])
    schema = T.StructType([f for f in inner.schema.fields if f.name != "_text"] + T._parse_datatype_string("piece_no int, start_pos int, end_pos int, shared_chars int, cut_kind string, piece string").fields)
    cols = [n for n, _ in names]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, rows = [], []
            for i, text in enumerate(pdf["_text"]):
                for n, (s, e, shared, kind) in enumerate(split_text(text, max_chars, overlap_chars)):
                    at.append(i)
                    rows.append((n, s, e, shared, kind, text[s:e]))
            out = pdf[cols].iloc[at].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=list(OUT))], axis=1)

    return renamed(inner.mapInPandas(pieces, schema), names)


def cut_kinds(df: DataFrame, text_col: str, keys: Sequence[str], max_chars: int, overlap_chars: int) -> DataFrame:
    """`keys` and cut_kind of every text over the limit: `hard` if one of its pieces ends in a hard cut, else `soft`."""
    long = df.filter(F.length(text_col) > max_chars)
    return split_oversized(long, text_col, keys, max_chars, overlap_chars).groupBy(*keys).agg(F.min("cut_kind").alias("cut_kind"))


def rebuilt(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, chars, sha256, longest: each text put together again from its pieces without what they share, its length and digest, and the length of its longest piece."""
    own = F.struct("piece_no", F.expr("substring(piece, shared_chars + 1)").alias("own"))
    whole = pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "").alias("text"), F.max(F.length("piece")).cast("long").alias("longest"))
    return whole.select(*keys, F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"), "longest")
