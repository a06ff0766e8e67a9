"""A small formula language (+ * **, brackets, decimal numbers, variables) that becomes a Column; and quantisation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)|(\*\*|[-+*()]))")
#: Longer formulas are refused.
MOST = 1000


class FormulaError(ValueError):
    """What is wrong, and at which character."""


def parse(text: str, variables: dict[str, Column]) -> Column:
    """The value of a formula in single precision: each step is rounded to a float. ** binds tightest and to the right."""
    tokens, at = [], 0
    while text[at:].strip():
        if not (m := _TOKEN.match(text, at)):
            raise FormulaError(f"character {at}: unexpected {text[at:].strip()[0]!r}")
        tokens.append((m.group().strip(), m))
        at = m.end()
    if not tokens or len(tokens) > MOST:
        raise FormulaError("empty, or too long")
    place = 0
    single = lambda c: c.cast("float")

    def peek():
        return tokens[place][0] if place < len(tokens) else None

    def take(expected=None):
        nonlocal place
        if place == len(tokens) or expected and tokens[place][0] != expected:
            raise FormulaError(f"character {tokens[place][1].start() if place < len(tokens) else len(text)}: expected {expected or 'a value'}")
        place += 1
        return tokens[place - 1][1]

    def total():
        x = product()
        while peek() == "+":
            take()
            x = single(x + product())
        return x

    def product():
        x = power()
        while peek() == "*":
            take()
            x = single(x * power())
        return x

    def power():
        x = atom()
        if peek() == "**":
            take()
            x = single(F.pow(x, power()))
        return x

    def atom():
        if peek() == "(":
            take()
            x = total()
            take(")")
            return x
        if peek() == "-":
            take()
            return single(-atom())
        m = take()
        if m[1]:
            return single(F.lit(float(m[1])))
        if m[2] and m[2] in variables:
            return single(variables[m[2]])
        raise FormulaError(f"character {m.start()}: unexpected {m.group().strip()!r}")

    x = total()
    if place < len(tokens):
        raise FormulaError(f"character {tokens[place][1].start()}: unexpected {tokens[place][0]!r}")
    return x


def quantised(value: Column, bits: int) -> Column:
    """A value cut to 0..1, rounded half up to 2^bits - 1 steps."""
    top = float((1 << bits) - 1)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * top + 0.5) / top
