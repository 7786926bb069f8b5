"""Expressions of WHERE clauses as Columns: || && == != < <= > >= =~ + - * / % ! ( ), literals, dotted paths and .match('glob').

Names are id, type, or members of a feature's properties first, then fields, else the number 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import globs, values

TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][-+]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>\|\||&&|===?|!==?|=~|<=|>=|[-<>+*/%!().\[\]]))")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad expression at {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


@dataclass
class Names:
    """Where names are found: the id column, a geometry type column, a JSON column with properties, a map of fields."""

    id: str = "id"
    type: str | None = None
    properties: str | None = None
    fields: str = "fields"

    def value(self, path: list[str]) -> Column:
        if path == ["id"]:
            return values.made(values.STRING, 0.0, F.col(self.id).cast("string"))
        if path == ["type"] and self.type:
            return values.made(values.STRING, 0.0, F.col(self.type))
        field = F.try_element_at(F.col(self.fields), F.lit(path[0]))
        if len(path) > 1:
            inner = F.get_json_object(field["data"], "$." + ".".join(path[1:]))
            field = values.let(inner, lambda x: F.when(x.isNotNull(), values.value_of(x)))
        if self.properties:
            member = F.get_json_object(F.col(self.properties), "$." + ".".join(path[1:] if path[0] == "properties" and len(path) > 1 else path))
            field = F.coalesce(values.let(member, lambda x: F.when(x.isNotNull(), values.value_of(x))), field)
        return F.coalesce(field, values.zero())


class Parser:
    def __init__(self, text: str, names: Names):
        self.tokens, self.at, self.names = tokens(text), 0, names

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (want and self.peek() != want):
            raise ValueError(f"expected {want or 'more'} in expression")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Column:
        out = truth(self.either())
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.peek()!r} in expression")
        return out

    def either(self) -> Column:
        left = self.both()
        while self.peek() == "||":
            self.take()
            left = boolean(truth(left) | truth(self.both()))
        return left

    def both(self) -> Column:
        left = self.equal()
        while self.peek() == "&&":
            self.take()
            left = boolean(truth(left) & truth(self.equal()))
        return left

    def equal(self) -> Column:
        left = self.ordered()
        while self.peek() in ("==", "===", "!=", "!==", "=~"):
            op = self.take()[1]
            if op == "=~":
                kind, raw = self.take()
                left = boolean(matched(left, raw[1:-1] if kind == "str" else raw))
            else:
                same = values.eq(left, self.ordered())
                left = boolean(same if op[0] == "=" else ~same)
        return left

    def ordered(self) -> Column:
        left = self.sum()
        while self.peek() in ("<", "<=", ">", ">="):
            op = self.take()[1]
            right = self.sum()
            left = boolean({"<": values.lt(left, right), "<=": values.le(left, right), ">": values.lt(right, left), ">=": values.le(right, left)}[op])
        return left

    def sum(self) -> Column:
        left = self.product()
        while self.peek() in ("+", "-"):
            op = self.take()[1]
            right = self.product()
            left = values.pair(left, right, added if op == "+" else lambda a, b: number(a["num"] - b["num"]))
        return left

    def product(self) -> Column:
        left = self.unary()
        while self.peek() in ("*", "/", "%"):
            op = self.take()[1]
            right = self.unary()
            left = values.pair(left, right, {"*": lambda a, b: number(a["num"] * b["num"]), "/": lambda a, b: number(F.try_divide(a["num"], b["num"])), "%": lambda a, b: number(F.try_mod(a["num"], b["num"]))}[op])
        return left

    def unary(self) -> Column:
        if self.peek() == "!":
            self.take()
            return boolean(~truth(self.unary()))
        if self.peek() == "-":
            self.take()
            return number(-self.unary()["num"])
        return self.primary()

    def primary(self) -> Column:
        kind, raw = self.take()
        if raw == "(":
            out = self.either()
            self.take(")")
            return out
        if kind == "num":
            return values.made(values.NUMBER, float(raw), raw)
        if kind == "str":
            return values.made(values.STRING, 0.0, re.sub(r"\\(.)", r"\1", raw[1:-1]))
        if kind != "name":
            raise ValueError(f"unexpected {raw!r} in expression")
        if raw in ("true", "false", "null"):
            return values.made({"true": values.TRUE, "false": values.FALSE, "null": values.NULL}[raw], float(raw == "true"), raw)
        path = [raw]
        while self.peek() == ".":
            self.take()
            name = self.take()[1]
            if name == "match":
                self.take("(")
                pattern = self.take()[1][1:-1]
                self.take(")")
                return boolean(self.names.value(path)["data"].rlike("(?i)" + globs.regex(pattern)))
            path.append(name)
        return self.names.value([p for p in path if p != "this"] or ["id"])


def added(a: Column, b: Column) -> Column:
    """Numbers add up; with a string on either side, texts are joined."""
    joined = values.made(values.STRING, 0.0, F.concat(a["data"], b["data"]))
    return F.when((a["kind"] == values.STRING) | (b["kind"] == values.STRING), joined).otherwise(number(a["num"] + b["num"]))


def number(x: Column) -> Column:
    return values.let(x, lambda n: values.made(values.NUMBER, F.coalesce(n, F.lit(float("nan"))), n.cast("string")))


def boolean(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), values.made(values.TRUE, 1.0, "true")).otherwise(values.made(values.FALSE, 0.0, "false"))


def truth(v: Column) -> Column:
    """True, a number but 0 and NaN, a string but the empty one, JSON."""

    def of(v: Column) -> Column:
        k = v["kind"]
        return F.when(k == values.NUMBER, (v["num"] != 0) & ~F.isnan(v["num"])).when(k == values.STRING, v["data"] != "").otherwise(k.isin(values.TRUE, values.JSON))

    return values.let(v, of)


def matched(v: Column, pattern: str) -> Column:
    """Regular expression match; one that is no expression matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return v["data"].rlike(pattern)


def parse(text: str, names: Names | None = None) -> Column:
    return Parser(text, names or Names()).whole()
