"""Language of short texts by script and by character n-grams.

The n-grams of languages in Latin letters and their weights are trained by
`python -m lodeline.llm.train_language DIR`; the rest is told by script.
"""

from __future__ import annotations

import json
import re
from functools import cache, lru_cache
from pathlib import Path

MODEL = Path(__file__).with_name("models") / "language.json"
SCRIPTS = {"ja": r"[぀-ヿ]", "ko": r"[가-힯]", "th": r"[฀-๿]", "ar": r"[؀-ۿ]", "hi": r"[ऀ-ॿ]", "ru": r"[Ѐ-ӿ]", "el": r"[Ͱ-Ͽ]", "he": r"[֐-׿]"}
SCRIPT_RE = {k: re.compile(v) for k, v in SCRIPTS.items()}
OTHER = re.compile("|".join(SCRIPTS.values()))
HAN = re.compile(r"[㐀-鿿]")
LATIN = re.compile(r"[^\W\d_]+")
MAIL = re.compile(r"\S*[@＠]\S*|https?://\S+")
#: Log likelihood a word by which the better language must lead before two texts count as of different languages.
LEAD = 0.6
LONGEST = 4


def grams(word: str) -> list[str]:
    """Character n-grams of a word with its edges, up to four characters."""
    w = f" {word} "
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


@cache
def model() -> dict[str, dict[str, float]]:
    return json.loads(MODEL.read_text(encoding="utf-8"))


@lru_cache(20_000)
def word_scores(word: str) -> tuple[float, ...]:
    gs = grams(word)
    return tuple(sum(table.get(g, table[""]) for g in gs) / len(gs) for table in model().values())


def _words(text: str, han: int) -> list[str]:
    text = MAIL.sub(" ", text) if "@" in text or "＠" in text or "://" in text else text
    return LATIN.findall(HAN.sub(" ", text) if han else text)


def script_of(text: str) -> str | None:
    """Language by script, `latin`, or None if there is too little to tell."""
    if OTHER.search(text):
        for name, pattern in SCRIPT_RE.items():
            if len(pattern.findall(text)) >= 4:
                return name
    han = len(HAN.findall(text))
    words = _words(text, han)
    if han >= 4 and han > 1.5 * len(words):
        return "zh"
    return "latin" if len(words) >= 3 else None


def scores(text: str) -> dict[str, float]:
    """Mean log likelihood of a word's n-grams under each language in Latin letters."""
    each = [word_scores(w[:40].casefold()) for w in _words(text, len(HAN.findall(text)))]
    return {lang: sum(col) / len(each) for lang, col in zip(model(), zip(*each, strict=True), strict=True)} if each else dict.fromkeys(model(), 0.0)


def language(text: str) -> str | None:
    """Language of a text; None if there is too little to tell."""
    kind = script_of(text)
    if kind != "latin":
        return kind
    found = scores(text)
    return max(found, key=found.get)


def differ(a: str, b: str) -> bool:
    """The texts are surely of different languages: by script, or each is likelier by LEAD under its own language than under the other's."""
    one, two = script_of(a), script_of(b)
    if one is None or two is None:
        return False
    if one != two:
        return True
    if one != "latin":
        return False
    x, y = scores(a), scores(b)
    p, q = max(x, key=x.get), max(y, key=y.get)
    return p != q and x[p] - x[q] >= LEAD * 0.5 and y[q] - y[p] >= LEAD * 0.5 and (x[p] - x[q]) + (y[q] - y[p]) >= LEAD
