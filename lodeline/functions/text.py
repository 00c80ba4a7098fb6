"""Text expressions: word index tokens, bigrams, redaction, markers, truncation, salvage."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The token and CJK patterns of the word index.
TOKEN = r"[a-z0-9]+(?:[._'-][a-z0-9]+)*|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
CJK = r"^[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+$"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "²³¹ºª"
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "231oa"
#: Markers of questions about current matters.
TIME_MARKERS = ["最新", "现在", "当前", "今天", "今年", "近期", "最近", "本周", "本月", "实时", "新闻", "截至", "latest", "current", "today", "this year", "recent", "news"]
#: Key, words that show the preference, statement.
PREFERENCES = [
    ("preference:examples", ["举例", "例子", "举个例"], "学生偏好通过具体例子理解知识。"),
    ("preference:steps", ["步骤", "一步一步", "详细过程"], "学生偏好分步骤讲解。"),
    ("preference:simple", ["简单一点", "简单讲", "通俗"], "学生偏好简单、通俗的解释。"),
    ("preference:visual", ["画图", "图形", "示意图"], "学生偏好使用图形或示意方式理解知识。"),
]
#: Words of difficulty.
DIFFICULTY = "不懂|不会|不明白|搞不清|容易错|总是错|总弄混|分不清"
#: What is hidden before storing, in this order.
STORED_RULES = [(r"(?<!\d)1[3-9]\d{9}(?!\d)", "[手机号已隐藏]"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[邮箱已隐藏]"), (r"(?<!\d)\d{17}[\dXx](?!\d)", "[证件号已隐藏]")]
#: What is hidden before a text leaves for a search, in this order.
OUTGOING_RULES = [
    (r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[邮箱已隐藏]"),
    (r"(?U)(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)", "[电话已隐藏]"),
    (r"(?U)(?<!\d)\d{17}[\dXx](?!\d)", "[证件号已隐藏]"),
    (r"(?iU)\b(?:student_id|thread_id|turn_id)\s*[:=]\s*[^\s，。；;]+", "[内部编号已隐藏]"),
    (r"(?:我叫|我的名字是|姓名(?:是|为|[:：]))\s*[\x{3400}-\x{9fff}·]{2,8}", "[姓名已隐藏]"),
    (r"(?i)\b(?:my name is|i am)\s+[a-z][a-z .'-]{0,30}", "[姓名已隐藏]"),
    (r"(?:我(?:在|就读于)|我的学校是|学校[:：])[^，。！？!?\n]{1,40}?(?:小学|学校)", "[学校已隐藏]"),
    (r"(?:我住在|我的地址是|住址[:：]|地址[:：])[^，。！？!?\n]{1,80}", "[地址已隐藏]"),
]
#: What marks the question in a prompt, and the names of the blocks around it.
OUTGOING_MARK = "学生当前问题:"
OUTGOING_BLOCKS = ["最近会话", "相关长期学习记忆", "审核修改意见"]


def folded(text: Column) -> Column:
    """Lower case with the compatibility forms that occur in tokens made plain, within codegen.

    Equal to NFKC and case folding where the text has no other compatibility forms; `tokens_exact` covers those.
    """
    plain = F.translate(text, WIDE, PLAIN)
    for old, new in (("℃", "°c"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.lower(plain)


def tokens(text: Column) -> Column:
    """Word index tokens: Latin words and numbers whole; a CJK run gives its characters, then its bigrams. Null gives null."""
    found = F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))

    def parts(m: Column) -> Column:
        chars = F.split(m, "")
        pairs = F.transform(F.sequence(F.lit(1), F.length(m) - 1), lambda i: F.substring(m, i, 2))
        return F.when(m.rlike(CJK), F.when(F.length(m) > 1, F.concat(chars, pairs)).otherwise(F.array(m))).otherwise(F.array(m))

    return F.flatten(F.transform(found, parts))


_PY_TOKEN = re.compile(r"[a-z0-9]+(?:[._'-][a-z0-9]+)*|([㐀-䶿一-鿿]+)")


def tokenize(text: str) -> list[str]:
    """Tokens of one text by full NFKC and case folding."""
    out: list[str] = []
    for m in _PY_TOKEN.finditer(unicodedata.normalize("NFKC", text).casefold()):
        run = m[1]
        if run:
            out += [*run, *(a + b for a, b in zip(run, run[1:], strict=False))]
        else:
            out.append(m[0])
    return out


def _folded_bytes() -> np.ndarray:
    """For each code point of the basic plane the character of a Latin token that `folded` makes of it, 255 for a CJK character, a space for all others."""
    out = np.full(0x10000, 32, np.uint8)
    out[0x3400:0x4DC0] = out[0x4E00:0xA000] = 255
    for made in "abcdefghijklmnopqrstuvwxyz0123456789._'-":
        out[[ord(made), ord(made.upper())]] = ord(made)
    out[0x212A] = ord("k")
    out[[*map(ord, WIDE)]] = out[[*map(ord, PLAIN)]]
    return out


_BYTES = _folded_bytes()
_LATIN = re.compile(rb"[a-z0-9]+(?:[._'-][a-z0-9]+)*")


def token_lists(texts: pa.Array) -> pa.ListArray:
    """The tokens of many texts by the rules of `tokens`, as numbers of a dictionary: those of a text together, but CJK characters first, then bigrams, then Latin words. Null gives an empty list."""
    texts = pc.fill_null(texts, "")
    for old, new in (("℃", "°c"), ("ß", "ss"), ("İ", "i\u0307")):
        texts = pc.replace_substring(texts, old, new)
    points = np.frombuffer("\n".join([*texts.to_pylist(), ""]).encode("utf-32-le"), np.uint32)
    text = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False) + 1)
    kind = _BYTES[np.minimum(points, 0xFFFF)]
    at = np.nonzero(kind == 255)[0]
    char = points[at].astype(np.int64)
    pair = np.nonzero(np.diff(at) == 1)[0]
    latin = [(m.start(), m[0].decode()) for m in _LATIN.finditer(kind.tobytes())]
    words = pa.array([w for _, w in latin], pa.string()).dictionary_encode()
    groups = [(at, char), (at[pair], char[pair] << 16 | char[pair + 1]), (np.array([a for a, _ in latin], np.int64), words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + (1 << 32))]
    counts = [np.bincount(text[place], minlength=len(texts)) for place, _ in groups]
    ends = np.concatenate([[0], np.cumsum(sum(counts))])
    codes, start = np.empty(ends[-1], np.int64), ends[:-1]
    for (place, code), count in zip(groups, counts, strict=True):
        codes[np.arange(len(code)) + np.repeat(start - (np.cumsum(count) - count), count)] = code
        start = start + count
    coded = pa.array(codes).dictionary_encode()
    names = [chr(c) if c < 1 << 16 else chr(c >> 16) + chr(c & 0xFFFF) if c < 1 << 32 else words.dictionary[c - (1 << 32)].as_py() for c in coded.dictionary.to_pylist()]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.DictionaryArray.from_arrays(coded.indices, pa.array(names, pa.string())))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_exact(text: pd.Series) -> pd.Series:
    """Tokens by full NFKC and case folding, Arrow-batched."""
    return text.map(tokenize, na_action="ignore")


def bigram_set(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of the text in lower case without white space; a single character is its own term."""
    dense = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    pairs = F.transform(F.sequence(F.lit(1), F.length(dense) - 1), lambda i: F.substring(dense, i, 2))
    return F.when(F.length(dense) >= 2, F.array_distinct(pairs)).when(F.length(dense) == 1, F.array(dense)).otherwise(F.array().cast("array<string>"))


def hide_stored(text: Column) -> Column:
    for pattern, mark in STORED_RULES:
        text = F.regexp_replace(text, pattern, mark.replace("$", r"\$"))
    return text


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def hide_outgoing(text: Column, max_chars: int = 200, normalise: bool = True) -> Column:
    """What may leave of a question: the part behind the last question mark-up, or the text without context blocks, hidden by rules and cut."""
    value = nfkc(F.coalesce(text, F.lit(""))) if normalise else F.coalesce(text, F.lit(""))
    asked = OUTGOING_MARK
    blocks = value
    for name in OUTGOING_BLOCKS:
        blocks = F.regexp_replace(blocks, f"(?s){name}开始.*?{name}结束[。.]?", " ")
    value = F.when(value.contains(asked), F.substring_index(value, asked, -1)).otherwise(blocks)
    value = F.btrim(F.regexp_replace(value, r"(?U)\s+", " "))
    for pattern, mark in OUTGOING_RULES:
        value = F.regexp_replace(value, pattern, mark)
    return F.btrim(F.left(value, F.lit(max(1, max_chars))))


def is_time_sensitive(text: Column) -> Column:
    return folded(text).rlike("|".join(TIME_MARKERS))


def one_line(text: Column, limit: int | None = None, mark: str = "") -> Column:
    """White space collapsed; beyond `limit` characters cut there and `mark` added."""
    flat = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    return flat if limit is None else F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit)), F.lit(mark)))


def keep_start(text: Column, n: Column | int) -> Column:
    """At most n characters: the start and an ellipsis."""
    n = F.lit(n) if isinstance(n, int) else n
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(clean) <= n, clean).otherwise(F.concat(F.regexp_replace(F.left(clean, n - 1), r"(?U)\s+$", ""), F.lit("…")))


def keep_end(text: Column, n: Column | int) -> Column:
    """At most n characters: an ellipsis and the end."""
    n = F.lit(n) if isinstance(n, int) else n
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(clean) <= n, clean).otherwise(F.concat(F.lit("…"), F.regexp_replace(F.right(clean, n - 1), r"(?U)^\s+", "")))


def text_blocks(content: Column) -> Column:
    """Text of a list of typed blocks: those of type text, joined."""
    return F.btrim(F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), ""))


def json_body(text: Column) -> Column:
    """The outermost braces of a text that may be fenced or surrounded by words; the text itself if it has none."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(F.btrim(text))


def salvaged(text: Column, schema: str) -> Column:
    """The JSON object in a text as a struct of `schema`; null where it isn't a valid object."""
    body = json_body(text)
    return F.when(body.startswith("{") & F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def subject_or_general(subject: Column, known: list[str], general: str = "综合") -> Column:
    """A known subject, else the general one."""
    return F.when(F.btrim(subject).isin(known), F.btrim(subject)).otherwise(general)


def metadata_json(fields: Column) -> Column:
    """A struct as JSON; a number that isn't finite fails the job, as JSON has no way to write it."""
    text = F.to_json(fields)
    return F.when(text.rlike(r':"(?:NaN|-?Infinity)"'), F.raise_error(F.concat(F.lit("no JSON for: "), text)).cast("string")).otherwise(text)


def truth(value: str) -> bool:
    """A setting as a truth value; ValueError for what is neither yes nor no."""
    name = value.strip().lower()
    if name in ("1", "true", "yes", "on"):
        return True
    if name in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"neither yes nor no: {value}")


def without_guide(text: Column) -> Column:
    """A text without the comment that leads it."""
    return F.regexp_replace(text, r"(?s)\A\s*<!--.*?-->\s*", "")


def front_matter(text: Column, field: str) -> Column:
    """A field of the block between the two --- lines that lead a text."""
    return F.btrim(F.regexp_extract(F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1), rf"(?m)^{field}:(.*)$", 1))
