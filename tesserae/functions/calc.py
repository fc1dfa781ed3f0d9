"""Arithmetic expressions.

`+ -` bind weakest; `* / ^` alike and from left to right; signs bind tightest. Names of functions and constants are
case-insensitive. A missing closing bracket and anything after a whole expression are ignored; division by zero, an
unknown name or an unexpected character make the expression invalid. Null is invalid.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

_TOKEN = re.compile(r"\s*(?:(?P<number>[0-9.]+)|(?P<name>[A-Za-z]+)|(?P<sign>.))", re.S)


def _quiet(f: Callable[[float], float]) -> Callable[[float], float]:
    """Outside its domain a function gives NaN, beyond the largest number infinity."""

    def g(x: float) -> float:
        try:
            return f(x)
        except OverflowError:
            return math.inf
        except ValueError:
            return math.nan

    return g


def _log(f: Callable[[float], float]) -> Callable[[float], float]:
    return lambda x: -math.inf if x == 0 else f(x)


CONSTANTS = {"pi": math.pi, "e": math.e, "phi": (1 + math.sqrt(5)) / 2, "inf": math.inf, "nan": math.nan}
_WHOLE = {"ceil": math.ceil, "floor": math.floor, "round": lambda x: math.copysign(math.floor(abs(x) + 0.5), x)}
FUNCTIONS: dict[str, Callable[[float], float]] = {
    "sqrt": math.sqrt, "cbrt": math.cbrt, "log": _log(math.log10), "ln": _log(math.log), "exp": math.exp, "abs": abs,
    "sign": lambda x: float((x > 0) - (x < 0)),
    **{k: (lambda x, f=f: float(f(x)) if math.isfinite(x) else x) for k, f in _WHOLE.items()},
}
_TURN = {"sin": math.sin, "cos": math.cos, "tan": math.tan}
_ARC = {"asin": math.asin, "acos": math.acos, "atan": math.atan}


class _Reader:
    def __init__(self, text: str, degrees: bool) -> None:
        self.tokens = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text.rstrip())]
        self.at, self.degrees = 0, degrees

    def sign(self, of: str) -> str:
        """The next token if it is one of the signs; takes it."""
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind == "sign" and value in of:
            self.at += 1
            return value
        return ""

    def sum(self) -> float:
        total = self.product()
        while s := self.sign("+-"):
            x = self.product()
            total = total + x if s == "+" else total - x
        return total

    def product(self) -> float:
        total = self.factor()
        while s := self.sign("*/^"):
            x = self.factor()
            if s == "*":
                total *= x
            elif s == "/":
                total /= x  # by zero: invalid
            else:
                total = _power(total, x)
        return total

    def factor(self) -> float:
        flips = 0
        while s := self.sign("+-"):
            flips += s == "-"
        value = self.atom()
        return -value if flips % 2 else value

    def atom(self) -> float:
        if self.sign("("):
            return self.closed()
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "number":
            m = re.match(r"[0-9]+\.?[0-9]*|\.[0-9]+", value)
            if not m:
                raise ValueError(value)
            return float(m.group())
        if kind == "name":
            name = value.lower()
            if self.sign("("):
                x = self.closed()
                if f := self.function(name):
                    return _quiet(f)(x)
            if name in CONSTANTS:
                return CONSTANTS[name]
        raise ValueError(value)

    def closed(self) -> float:
        value = self.sum()
        self.sign(")")
        return value

    def function(self, name: str) -> Callable[[float], float] | None:
        if f := _TURN.get(name):
            return (lambda x: f(x * math.pi / 180)) if self.degrees else f
        if f := _ARC.get(name):
            return (lambda x: f(x) * 180 / math.pi) if self.degrees else f
        return FUNCTIONS.get(name)


def _power(a: float, b: float) -> float:
    try:
        x = math.pow(a, b)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan
    return x


def evaluate(text: str | None, degrees: bool = False) -> tuple[bool, float | None, str | None]:
    """(valid, value, value as text)."""
    if text is None or not text:
        return False, None, None
    try:
        value = _Reader(text, degrees).sum()
    except (ValueError, ZeroDivisionError, RecursionError):
        return False, None, None
    if math.isfinite(value) and value == int(value) and abs(value) < 1e15:
        return True, value, str(int(value))
    return True, value, f"{value:g}"


def is_expression(text: str | None) -> bool:
    """Holds an operator, a bracket, or the name of a function or constant (a lone e included)."""
    names = (*_TURN, *_ARC, *FUNCTIONS, "pi", "e")
    return bool(text) and (any(c in "+-*/^()" for c in text) or any(n in text.lower() for n in names))


_RESULT = StructType().add("valid", BooleanType()).add("value", DoubleType()).add("text", StringType())


@F.pandas_udf(_RESULT)
def calculate(expression: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evaluate(x) for x in expression], columns=["valid", "value", "text"], index=expression.index)


@F.pandas_udf(_RESULT)
def calculate_degrees(expression: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evaluate(x, True) for x in expression], columns=["valid", "value", "text"], index=expression.index)


@F.pandas_udf(BooleanType())
def is_calculation(text: pd.Series) -> pd.Series:
    return text.map(is_expression).astype(bool)
