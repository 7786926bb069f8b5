"""Wildcard patterns as regular expressions and key ranges."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def regex(pattern: str) -> str:
    """An anchored regular expression for * ? [set] and backslash escapes; an open set is an error."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"no end of set in {pattern!r}")
            body = pattern[i + 1 : end]
            sign = "^" if body[0] in "^!" else ""
            body = body[1:] if sign else body
            out.append(f"[{sign}{re.sub(r'([\[\]&^\\])', r'\\\1', body)}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def prefix(pattern: str) -> str:
    """Literal text before the first wildcard."""
    return re.match(r"[^*?\[\\]*", pattern)[0]


def matches(value: Column, patterns: list[str]) -> Column:
    """One of the patterns matches. A literal prefix is tested as well, which reaches the scan."""

    def one(p: str) -> Column:
        if p == "*":
            return F.lit(True)
        if not is_glob(p) and "\\" not in p:
            return value == p
        head = prefix(p)
        test = value.rlike(regex(p))
        return value.startswith(head) & test if head else test

    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(not patterns))
