"""Field expressions: a tokenizer and a precedence-climbing parser that build columns.

Grammar: numbers, names, parentheses, unary + and -, ** and ^ (right-associative), * /, + -, comparisons (1 or 0), `and`,
`or`, and calls of the functions in FUNCTIONS. User text never reaches the SQL parser.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellforge.functions import ieee

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|<=|>=|==|!=|[-+*/^()<>,]))")
_BINDING = {"or": 1, "and": 2, "<": 3, "<=": 3, ">": 3, ">=": 3, "==": 3, "!=": 3, "+": 4, "-": 4, "*": 5, "/": 5}
_POWER, _UNARY = 7, 6


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _true(c: Column) -> Column:
    return ieee.ne(c, 0.0)


def _log(base):
    def f(x: Column) -> Column:
        log = F.when(F.isnan(x) | (x < 0), F.lit(ieee.NAN)).otherwise(F.when(x == 0, F.lit(-ieee.INF)).otherwise(base(F.when(x > 0, x).otherwise(F.lit(1.0)))))
        return log

    return f


def _pick(first_if):
    # fmin and fmax: a NaN gives way to a number
    def f(a: Column, b: Column) -> Column:
        return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(first_if(a, b))

    return f


FUNCTIONS = {
    "sqrt": (1, F.sqrt), "exp": (1, F.exp), "log": (1, _log(F.log)), "log10": (1, _log(F.log10)),
    "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "asin": (1, F.asin), "acos": (1, F.acos), "atan": (1, F.atan), "atan2": (2, F.atan2),
    "sinh": (1, F.sinh), "cosh": (1, F.cosh), "tanh": (1, F.tanh), "abs": (1, F.abs),
    "floor": (1, lambda x: F.when(ieee.isfinite(x), F.floor(F.when(ieee.isfinite(x), x)).cast("double")).otherwise(x)),
    "ceil": (1, lambda x: F.when(ieee.isfinite(x), F.ceil(F.when(ieee.isfinite(x), x)).cast("double")).otherwise(x)),
    "fmod": (2, lambda a, b: F.when(b == 0, F.lit(ieee.NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))),
    "pow": (2, F.pow), "min": (2, _pick(F.least)), "max": (2, _pick(F.greatest)),
    "if": (3, lambda c, a, b: F.when(_true(c), a).otherwise(b)),
    "heaviside": (2, lambda x, h: F.when(ieee.lt(x, 0.0), F.lit(0.0)).when(ieee.eq(x, 0.0), h).otherwise(F.lit(1.0))),
}


class ExpressionError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:1]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


def _apply(op: str, a: Column, b: Column) -> Column:
    if op in ("and", "or"):
        return _flag((_true(a) & _true(b)) if op == "and" else (_true(a) | _true(b)))
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return ieee.div(a, b)
    return _flag(ieee.COMPARE[{"<": "lt", "<=": "le", ">": "gt", ">=": "ge", "==": "eq", "!=": "ne"}[op]](a, b))


def parse(text: str, variables: dict[str, Column]) -> Column:
    """The expression as a double column over the given variables."""
    tokens, at = _tokens(text), 0

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal at
        kind, value = tokens[at]
        if want is not None and value != want:
            raise ExpressionError(f"expected {want!r}, found {value or 'the end'!r}")
        at += 1
        return kind, value

    def operand() -> Column:
        kind, value = take()
        if value == "-":
            return climb(_UNARY) * F.lit(-1.0)
        if value == "+":
            return climb(_UNARY)
        if value == "(":
            inner = climb(0)
            take(")")
            return inner
        if kind == "number":
            return F.lit(float(value))
        if kind == "name" and tokens[at][1] == "(":
            if value not in FUNCTIONS:
                raise ExpressionError(f"unknown function {value!r}")
            take("(")
            args = [climb(0)]
            while tokens[at][1] == ",":
                take()
                args.append(climb(0))
            take(")")
            arity, build = FUNCTIONS[value]
            if len(args) != arity:
                raise ExpressionError(f"{value} takes {arity} arguments, not {len(args)}")
            return build(*args).cast("double")
        if kind == "name":
            if value == "pi" and value not in variables:
                return F.lit(math.pi)
            if value not in variables:
                raise ExpressionError(f"unknown variable {value!r}")
            return variables[value].cast("double")
        raise ExpressionError(f"unexpected {value or 'end'!r}")

    def climb(least: int) -> Column:
        left = operand()
        while True:
            _, op = tokens[at]
            if op in ("**", "^") and least <= _POWER:
                take()
                left = F.pow(left, climb(_UNARY))
            elif _BINDING.get(op, -1) > least:
                take()
                left = _apply(op, left, climb(_BINDING[op]))
            else:
                return left

    out = climb(0)
    if tokens[at][0] != "end":
        raise ExpressionError(f"unexpected {tokens[at][1]!r}")
    return out
