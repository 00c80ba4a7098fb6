"""Recursive splitting by a list of separators, with greedy merging and overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Separators, best first; the empty one means characters.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", "，", ",", " ", ""]


def _pieces(text: str, separator: str) -> list[str]:
    """Pieces of the text, each with the separator in front that led to it."""
    if not separator:
        return list(text)
    return [p for p in re.split(f"(?={re.escape(separator)})", text) if p]


def _merged(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held))
    return out


def split_recursive(text: str, size: int = 500, overlap: int = 60, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, stripped, empty ones dropped."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    rest = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for p in _pieces(text, separators[at]):
        if len(p) < size or not rest:
            short.append(p)
            continue
        out += _merged(short, size, overlap)
        short = []
        out += split_recursive(p, size, overlap, rest)
    return [c for c in (x.strip() for x in [*out, *_merged(short, size, overlap)]) if c]


def chunk_documents(docs: DataFrame, keys: Sequence[str], text_col: str, size: int = 500, overlap: int = 60, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """`keys`, chunk_index, chunk for each text. Null texts give no rows."""
    rows = docs.select(*keys, text_col).filter(docs[text_col].isNotNull())
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keys), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chunks = [split_recursive(t, size, overlap, separators) for t in pdf[text_col]]
            at = [i for i, c in enumerate(chunks) for _ in c]
            out = pdf[list(keys)].iloc[at].reset_index(drop=True)
            out["chunk_index"] = [n for c in chunks for n in range(len(c))]
            out["chunk"] = [x for c in chunks for x in c]
            yield out

    return rows.mapInPandas(split, schema)
