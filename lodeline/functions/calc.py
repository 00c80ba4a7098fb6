"""Safe arithmetic as an Arrow-batched function: a small recursive-descent parser, no evaluation of code."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest expression, largest magnitude, largest exponent, deepest nesting.
MAX_CHARS, MAX_VALUE, MAX_POWER, MAX_DEPTH = 120, 10**12, 8, 20
SIGNS = {"×": "*", "÷": "/", "−": "-", "^": "**"}
LEXEME = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\*\*|//|[-+*/%()]))")


class _Parser:
    def __init__(self, text: str) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = LEXEME.match(text, at)
            if not m:
                raise ValueError("malformed expression")
            self.items.append(("number", m[1]) if m[1] else ("sign", m[2]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] == "sign" else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise ValueError("malformed expression")
        self.at += 1
        return self.items[self.at - 1]

    def sums(self) -> tuple[float, int]:
        """Value and height of the operations below: a number has none, an operation one more than its higher side. Brackets add nothing, so a long sum is as high as it has signs."""
        value, high = self.products()
        while (sign := self.peek()) in ("+", "-"):
            self.take()
            other, right = self.products()
            value, high = _sane(value + other if sign == "+" else value - other), _higher(high, right)
        return value, high

    def products(self) -> tuple[float, int]:
        value, high = self.signed()
        while (sign := self.peek()) in ("*", "/", "//", "%"):
            self.take()
            other, right = self.signed()
            if sign != "*" and other == 0:
                raise ValueError("division by zero")
            value = _sane(value * other if sign == "*" else value / other if sign == "/" else value // other if sign == "//" else value % other)
            high = _higher(high, right)
        return value, high

    def signed(self) -> tuple[float, int]:
        if (sign := self.peek()) in ("+", "-"):
            self.take()
            value, high = self.signed()
            return (-value if sign == "-" else value), _higher(high, 0)
        return self.power()

    def power(self) -> tuple[float, int]:
        kind, text = self.take()
        if kind == "number":
            base, high = _sane(int(text) if text.isdigit() else float(text)), 0
        elif text == "(":
            base, high = self.sums()
            if self.take()[1] != ")":
                raise ValueError("malformed expression")
        else:
            raise ValueError("malformed expression")
        if self.peek() == "**":
            self.take()
            exponent, right = self.signed()
            if abs(exponent) > MAX_POWER:
                raise ValueError("exponent too large")
            if base == 0 and exponent < 0:
                raise ValueError("division by zero")
            base, high = _sane(base**exponent), _higher(high, right)
        return base, high


def _higher(left: int, right: int) -> int:
    high = max(left, right) + 1
    if high >= MAX_DEPTH:
        raise ValueError("nested too deeply")
    return high


def _sane(value: float) -> float:
    if isinstance(value, complex) or not math.isfinite(value) or abs(value) > MAX_VALUE:
        raise ValueError("out of range")
    return value


def calculate(expression: str | None) -> str:
    """Result of an expression as text; ValueError for anything else than small arithmetic."""
    if expression is None or not expression.strip():
        raise ValueError("empty expression")
    if len(expression) > MAX_CHARS:
        raise ValueError("expression too long")
    for old, new in SIGNS.items():
        expression = expression.replace(old, new)
    parser = _Parser(expression)
    value, _ = parser.sums()
    if parser.at != len(parser.items):
        raise ValueError("malformed expression")
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else format(value, ".12g")
    return str(value)


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
def safe_calc(expression: pd.Series) -> pd.DataFrame:
    """(value, null), or (null, what is wrong) for each expression."""
    rows = []
    for e in expression:
        try:
            rows.append((calculate(e), None))
        except (ValueError, OverflowError) as x:
            rows.append((None, str(x)))
    return pd.DataFrame(rows, columns=["value", "error"])
