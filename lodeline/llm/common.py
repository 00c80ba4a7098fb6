"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters besides Unicode white space that show nothing: zero-width and direction marks, soft hyphen, BOM, fillers.
INVISIBLE = "\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180E\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F\\u2800\\u3164\\uFE00-\\uFE0F\\uFEFF\\uFFA0"
#: Java regular expression that matches a text of white space of any script and invisible characters only.
BLANK_RE = f"^[\\s\\p{{Z}}\\p{{Cc}}\\x{{E0000}}-\\x{{E0FFF}}{INVISIBLE}]*$"


def is_blank(text: Column) -> Column:
    """True for null and for texts of white space and invisible characters only."""
    return text.isNull() | text.rlike(BLANK_RE)


def keyed(df: DataFrame, keys: Sequence[str], out: Sequence[str], **inner: Column) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Narrow `df` to `keys` under internal names plus `inner` columns.

    Columns that are no keys are left out, whatever their names. Returns the
    frame and (internal, outer) names; a key named like one of the columns
    `out` the operator adds comes out as `<name>_key`.
    """
    names = [(f"_k{i}", f"{k}_key" if k in out else k) for i, k in enumerate(keys)]
    picked = [df[k].alias(n) for k, (n, _) in zip(keys, names, strict=True)]
    return df.select(*picked, *[c.alias(n) for n, c in inner.items()]), names


def renamed(df: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """Undo the internal names of `keyed`."""
    return df.withColumnsRenamed(dict(names))



#: Most rows of a table that may be broadcast or collected because it was counted first.
SMALL_ROWS = 50_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> tuple[DataFrame, int]:
    """`df`, marked for a broadcast if it has at most `most` rows, and its number of rows (most + 1 if there are more, in which case a join shuffles)."""
    rows = df.limit(most + 1).count()
    return (F.broadcast(df) if rows <= most else df), rows


def declared(df: DataFrame, *columns: str, most: int = SMALL_ROWS) -> list[tuple]:
    """The distinct rows of a table declared by hand, sorted. Raises ValueError if it has more than `most`, rather than leave some out."""
    rows = df.select(*columns).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows declared")
    return sorted(map(tuple, rows), key=repr)
