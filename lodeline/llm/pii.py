"""Problem 4: personal information inside free text.

Method: a character-level bidirectional LSTM with CRF transitions, trained in
numpy from labelled spans (see train_pii). Texts are read in overlapping
windows; where windows overlap, their scores are blended by how central a
character is, and one Viterbi pass over the whole text decides globally, so no
span is cut at a window's edge. What was found is trimmed, and no more.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.common import keyed, renamed

MODEL = Path(__file__).with_name("models") / "pii.npz"
TYPES = ("name", "email", "phone", "id_number", "address")
TAGS = ["O"] + [f"{a}-{t}" for t in TYPES for a in "BI"]
WINDOW, STRIDE = 160, 112
HAN_DIGITS = "〇零一二三四五六七八九十百"
CLASSES = 16


@cache
def char_class(c: str) -> int:
    """Coarse class of a character, for those the vocabulary lacks."""
    if c in HAN_DIGITS:
        return 1
    if c.isdigit():
        return 2 if c.isascii() else 3
    kind = unicodedata.category(c)
    if kind == "Lo":
        return 4 if "㐀" <= c <= "鿿" else 5
    if kind[0] == "L":
        return 6 if c.isupper() else 7
    if c == "\n":
        return 8
    if c.isspace():
        return 9
    if c in "@＠":
        return 10
    if kind in ("Ps", "Pi"):
        return 11
    if kind in ("Pe", "Pf"):
        return 12
    if kind == "Pd":
        return 13
    return 14 if kind[0] == "P" else 15


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(inputs: np.ndarray, recur: np.ndarray) -> np.ndarray:
    """Hidden states (T, B, H) from projected inputs (T, B, 4H); gates in the order in, forget, out, new."""
    steps, batch, wide = inputs.shape
    h = wide // 4
    out = np.empty((steps, batch, h), np.float32)
    hidden, cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
    for t in range(steps):
        z = inputs[t] + hidden @ recur
        np.tanh(z, out=z)  # the gates' weights are halved beforehand, so that this is their sigmoid but for scale
        gates = z[:, : 3 * h] * 0.5 + 0.5
        cell = gates[:, h : 2 * h] * cell + gates[:, :h] * z[:, 3 * h :]
        hidden = gates[:, 2 * h :] * np.tanh(cell)
        out[t] = hidden
    return out


class Tagger:
    """The trained network: vocabulary, tables of projected inputs, recurrences, output layer and CRF transitions."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.index = {chr(c): i + 1 for i, c in enumerate(weights["vocabulary"].tolist())}  # 0: unknown
        wide = weights["recur_f"].shape[1]
        half = np.ones(wide, np.float32)
        half[: 3 * wide // 4] = 0.5
        emb, cls = weights["chars"], weights["classes"]
        known = np.array([0, *map(lambda c: char_class(chr(c)), weights["vocabulary"].tolist())])
        table = np.concatenate([emb + cls[known], emb[:1] + cls])  # known characters, then the unknown by class
        self.tables = [(table @ weights[f"in_{d}"] + weights[f"bias_{d}"]).astype(np.float32) * half for d in "fb"]
        self.recur = [weights[f"recur_{d}"].astype(np.float32) * half for d in "fb"]
        self.out, self.out_bias = weights["out"].astype(np.float32), weights["out_bias"].astype(np.float32)
        trans = weights["trans"].astype(np.float32).copy()
        start = weights["start"].astype(np.float32).copy()
        for j, tag in enumerate(TAGS):
            if tag[0] == "I":
                start[j] = -1e4
                for i, before in enumerate(TAGS):
                    if before[2:] != tag[2:]:
                        trans[i, j] = -1e4
        self.trans, self.start, self.end = trans, start, weights["end"].astype(np.float32)
        self.unknown = len(emb)

    def codes(self, text: str) -> np.ndarray:
        get, unknown = self.index.get, self.unknown
        return np.array([get(c) or unknown + char_class(c) for c in text], np.int32)

    def scores(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Emission scores of each row of codes; rows of like length are best."""
        size = max(map(len, rows))
        ids = np.zeros((size, len(rows)), np.int32)
        back = np.zeros((size, len(rows)), np.int32)
        for j, r in enumerate(rows):
            ids[: len(r), j] = r
            back[: len(r), j] = r[::-1]
        ahead = lstm(self.tables[0][ids], self.recur[0])
        behind = lstm(self.tables[1][back], self.recur[1])
        h = ahead.shape[2]
        left, right = ahead @ self.out[:h] + self.out_bias, behind @ self.out[h:]
        return [left[: len(r), j] + right[: len(r), j][::-1] for j, r in enumerate(rows)]

    def decode(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each row of emissions, by one Viterbi pass over the batch."""
        size, k = max(map(len, rows)), len(TAGS)
        emit = np.zeros((size, len(rows), k), np.float32)
        length = np.array([len(r) for r in rows])
        for j, r in enumerate(rows):
            emit[: len(r), j] = r
        best = self.start + emit[0]
        back = np.zeros((size, len(rows), k), np.int8)
        final = np.where((length == 1)[:, None], best + self.end, 0)
        for t in range(1, size):
            step = best[:, :, None] + self.trans
            back[t] = step.argmax(axis=1)
            best = np.take_along_axis(step, back[t][:, None, :].astype(np.int64), 1)[:, 0] + emit[t]
            final = np.where((length == t + 1)[:, None], best + self.end, final)
        tags = np.zeros((size, len(rows)), np.int8)
        now = final.argmax(axis=1)
        each = np.arange(len(rows))
        for t in range(size - 1, -1, -1):
            now = np.where(length - 1 == t, final.argmax(axis=1), now)
            tags[t] = now
            now = np.where(t <= length - 1, back[t][each, now], now)
        return [tags[: len(r), j] for j, r in enumerate(rows)]

    def tag(self, texts: Sequence[str], batch: int = 256) -> list[np.ndarray]:
        """Tags of each text, in the order given."""
        codes = [self.codes(t) for t in texts]
        pieces = []  # (text, start, codes of the window)
        for i, c in enumerate(codes):
            if len(c) <= WINDOW:
                pieces += [(i, 0, c)] if len(c) else []
            else:
                last = len(c) - WINDOW
                pieces += [(i, s, c[s : s + WINDOW]) for s in [*range(0, last, STRIDE), last]]
        pieces.sort(key=lambda p: len(p[2]))
        emit: list[np.ndarray | None] = [None] * len(texts)
        weight: dict[int, np.ndarray] = {}
        for s in range(0, len(pieces), batch):
            part = pieces[s : s + batch]
            for (i, at, c), e in zip(part, self.scores([p[2] for p in part]), strict=True):
                if len(codes[i]) <= WINDOW:
                    emit[i] = e
                    continue
                if emit[i] is None:
                    emit[i], weight[i] = np.zeros((len(codes[i]), len(TAGS)), np.float32), np.zeros(len(codes[i]), np.float32)
                near = np.minimum(np.arange(1, len(c) + 1), np.arange(len(c), 0, -1)).astype(np.float32)
                emit[i][at : at + len(c)] += e * near[:, None]
                weight[i][at : at + len(c)] += near
        for i, w in weight.items():
            emit[i] /= w[:, None]
        order = sorted((i for i in range(len(texts)) if emit[i] is not None), key=lambda i: len(emit[i]))
        tags: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        at = 0
        while at < len(order):  # long texts in smaller batches
            many = max(1, min(512, 200_000 // len(emit[order[min(at + 511, len(order) - 1)]])))
            part = order[at : at + many]
            for i, t in zip(part, self.decode([emit[i] for i in part]), strict=True):
                tags[i] = t
            at += many
        return tags


@cache
def tagger() -> Tagger:
    with np.load(MODEL) as z:
        return Tagger(dict(z))


EDGE = " \t\r\n　,，.。;；:：!！?？、\"'“”‘’「」『』《》<>[]【】—–-_*…"
WORDY = re.compile(r"[A-Za-z0-9０-９]+|[^\W\d_㐀-鿿]+")


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """A span of the network without the marks around it: an edge inside a word or number moves to that word's nearer end, marks and brackets without their partner are cut off."""
    for m in WORDY.finditer(text, max(0, s - 40), min(len(text), s + 40)):
        if m.start() < s < m.end():
            s = m.start() if m.end() - s >= s - m.start() else m.end()
            break
    for m in WORDY.finditer(text, max(s, e - 40), min(len(text), e + 40)):
        if m.start() < e < m.end():
            e = m.end() if e - m.start() >= m.end() - e else m.start()
            break
    while s < e and (text[s] in EDGE or text[s] in "）)" or text[s] in "（(" and text.find("）" if text[s] == "（" else ")", s, e) < 0):
        s += 1
    while s < e and (text[e - 1] in EDGE or text[e - 1] in "（(" or text[e - 1] in "）)" and text.rfind("（" if text[e - 1] == "）" else "(", s, e) < 0):
        e -= 1
    while e - s > 1 and text[s] in "（(" and text[e - 1] in "）)" and text.find(text[e - 1], s, e) == e - 1:  # brackets around the whole
        s, e = s + 1, e - 1
    return s, e


def find_spans(texts: Sequence[str], model: Tagger | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of personal information in each text, in order and without overlaps."""
    out = []
    for text, tags in zip(texts, (model or tagger()).tag(texts), strict=True):
        spans: list[tuple[int, int, str]] = []
        hits = np.flatnonzero(tags)
        i = 0
        while i < len(hits):
            s = int(hits[i])
            kind = TAGS[tags[s]][2:]
            e = s + 1
            while e < len(tags) and TAGS[tags[e]] == f"I-{kind}":
                e += 1
            while i < len(hits) and hits[i] < e:
                i += 1
            s, e = trimmed(text, s, e)
            if s < e and (not spans or s >= spans[-1][1]):
                spans.append((s, e, kind))
        out.append(spans)
    return out


def _each(texts: pd.Series) -> dict[str, list[tuple[int, int, str]]]:
    once = [t for t in texts.dropna().unique() if t.strip()]
    return dict(zip(once, find_spans(once), strict=True)) if once else {}


def find_pii(df: DataFrame, text_col: str, keys: Sequence[str]) -> DataFrame:
    """`keys`, pii_type, pii_text, start_pos, end_pos (characters, end exclusive) of each stretch of personal information.

    Null, empty and blank texts give no rows, texts of any length are read whole, repeated rows give repeated results, an empty table gives none. Columns that are no keys are left out.
    """
    inner, names = keyed(df.filter(df[text_col].isNotNull()), keys, ("pii_type", "pii_text", "start_pos", "end_pos"), _text=df[text_col])
    cols = [n for n, _ in names]
    schema = T.StructType([f for f in inner.schema.fields if f.name in cols] + T._parse_datatype_string("pii_type string, pii_text string, start_pos int, end_pos int").fields)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = _each(pdf["_text"])
            at, rows = [], []
            for i, text in enumerate(pdf["_text"]):
                for s, e, kind in spans.get(text, ()):
                    at.append(i)
                    rows.append((kind, text[s:e], s, e))
            yield pd.concat([pdf[cols].iloc[at].reset_index(drop=True), pd.DataFrame(rows, columns=["pii_type", "pii_text", "start_pos", "end_pos"])], axis=1)

    return renamed(inner.mapInPandas(found, schema), names)


def redact(df: DataFrame, text_col: str) -> DataFrame:
    """`df` with personal information in text_col replaced by <NAME>, <EMAIL>, <PHONE>, <ID_NUMBER> and <ADDRESS>, all else unchanged, null texts too."""

    @F.pandas_udf(T.StringType())
    def hide(texts: pd.Series) -> pd.Series:
        spans = _each(texts)

        def one(text: str | None) -> str | None:
            for s, e, kind in reversed(spans.get(text, ())):
                text = f"{text[:s]}<{kind.upper()}>{text[e:]}"
            return text

        return texts.map(one, na_action="ignore")

    return df.withColumn(text_col, hide(df[text_col]))
