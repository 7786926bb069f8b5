"""The point engine's texts: NEARBY col lat lon radius_km [LIMIT n], WITHIN col minlat minlon maxlat maxlon [LIMIT n], and filters.

Filters compare texts of id and collection: == != > >= < <= ~ (contains) ^ (starts with), AND, OR, NOT, parentheses; unknown fields pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import search
from .areas import Words

MOST = 10_000
MAX_RADIUS_KM = 20037.50834


def run(points: DataFrame, text: str, default: int | None = 100) -> DataFrame:
    """The rows a text asks for; a text without LIMIT gets `default` rows, all of them if that is None."""
    words = Words(text.split())
    name, collection = words.take().upper(), words.take()
    rows = points.where(F.col("collection") == collection)
    if name == "NEARBY":
        lat, lon, km = words.number(-90, 90), words.number(-180, 180), words.number(0, MAX_RADIUS_KM)
        if km <= 0:
            raise ValueError("radius must be positive")
        out = search.radius_search(rows, lat, lon, km, limit=limit(words, default))
    elif name == "WITHIN":
        box = [words.number(-90, 90), words.number(-180, 180), words.number(-90, 90), words.number(-180, 180)]
        if box[0] > box[2]:
            raise ValueError("box is upside down")
        out = search.box_search(rows, *box, limit=limit(words, default))
    else:
        raise ValueError(f"unknown query {name!r}")
    if words.peek():
        raise ValueError(f"unexpected {words.peek()!r}")
    return out


def limit(words: Words, default: int | None = 100) -> int | None:
    if words.peek() != "LIMIT":
        return default
    words.take()
    return int(words.number(1, MOST))


def parse_filter(text: str, fields: tuple[str, ...] = ("id", "collection")) -> Column:
    tokens = re.findall(r"\(|\)|==|!=|>=|<=|[<>~^]|\"[^\"]*\"|[^\s()=!<>~^]+", text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("filter ends early")
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        left = both()
        while peek().upper() == "OR":
            take()
            left = left | both()
        return left

    def both() -> Column:
        left = one()
        while peek().upper() == "AND":
            take()
            left = left & one()
        return left

    def one() -> Column:
        if peek().upper() == "NOT":
            take()
            return ~one()
        if peek() == "(":
            take()
            inner = either()
            if take() != ")":
                raise ValueError("missing )")
            return inner
        name, op, value = take(), take(), take().strip('"')
        if len(value) > 4096:
            raise ValueError("value is too long")
        tests = {"==": lambda c: c == value, "!=": lambda c: c != value, ">": lambda c: c > value, ">=": lambda c: c >= value, "<": lambda c: c < value, "<=": lambda c: c <= value, "~": lambda c: c.contains(value), "^": lambda c: c.startswith(value)}
        if op not in tests:
            raise ValueError(f"unknown operator {op!r}")
        return tests[op](F.col(name).cast("string")) if name in fields else F.lit(True)

    out = either()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r}")
    return out
