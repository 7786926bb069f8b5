"""Dynamic field values as struct<kind, num, data>, with a total order: null < false < number < string < true < JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, FALSE, NUMBER, STRING, TRUE, JSON = range(6)
VALUE = "struct<kind: int, num: double, data: string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Numbers as JSON writes them: no leading zeros, no sign but minus.
NUMERAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


def made(kind, num, data) -> Column:
    part = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(part(kind, "int").alias("kind"), part(num, "double").alias("num"), part(data, "string").alias("data"))


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


ZERO = (NUMBER, 0.0, "0")


def zero() -> Column:
    return made(*ZERO)


def constant(text: str) -> Column:
    """The value of a text that is known now."""
    t = text.strip()
    if re.match(NUMERAL, t):
        return made(NUMBER, float(t), t)
    if t in ("null", "false", "true"):
        return made({"null": NULL, "false": FALSE, "true": TRUE}[t], float(t == "true"), t)
    if t[:1] in ("[", "{", '"'):
        try:
            v = json.loads(t)
            return made(STRING, 0.0, v) if isinstance(v, str) else made(JSON, 0.0, json.dumps(v, separators=(",", ":"), ensure_ascii=False))
        except ValueError:
            return made(STRING, 0.0, t)
    if re.fullmatch(r"(?i)nan|[-+]?inf(inity)?", t):
        return made(NUMBER, float(t), t.lower())
    return made(STRING, 0.0, t)


def value_of(text) -> Column:
    """Kind from text: number, JSON literal, object, array or string, nan and inf, else a string as it stands."""

    def of(t: Column) -> Column:
        low = F.lower(t)
        special = F.when(low == "nan", F.lit(float("nan"))).when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
        parsed = F.try_parse_json(t)
        out = F.when(t.rlike(NUMERAL), made(NUMBER, t.try_cast("double"), t))
        out = out.when(t == "null", made(NULL, 0.0, t)).when(t == "false", made(FALSE, 0.0, t)).when(t == "true", made(TRUE, 1.0, t))
        out = out.when(t.rlike(r"^[\[{]") & parsed.isNotNull(), made(JSON, 0.0, F.to_json(parsed)))
        out = out.when(t.rlike('^"') & parsed.isNotNull(), made(STRING, 0.0, F.try_variant_get(parsed, "$", "string")))
        return out.when(special.isNotNull(), made(NUMBER, special, low)).otherwise(made(STRING, 0.0, t))

    return let(F.trim(text if isinstance(text, Column) else F.col(text)), of)


def folded(v: Column) -> Column:
    """Data of a value for comparing: strings without regard to ASCII case."""
    return F.when(v["kind"] == STRING, F.translate(v["data"], UPPER, LOWER)).otherwise(v["data"])


def sort_key(v: Column) -> Column:
    return F.struct(v["kind"], F.when(v["kind"] == NUMBER, v["num"]).otherwise(0.0), F.when(v["kind"].isin(STRING, JSON), folded(v)).otherwise(""))


def lt(a: Column, b: Column) -> Column:
    return pair(a, b, _lt)


def pair(a: Column, b: Column, f) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: f(s["a"], s["b"]))


def _lt(a: Column, b: Column) -> Column:
    numbers = (a["num"] < b["num"]) & ~F.isnan(a["num"]) & ~F.isnan(b["num"])
    inner = F.when(a["kind"] == NUMBER, numbers).when(a["kind"].isin(STRING, JSON), folded(a) < folded(b)).otherwise(False)
    return (a["kind"] < b["kind"]) | ((a["kind"] == b["kind"]) & inner)


def eq(a: Column, b: Column) -> Column:
    return pair(a, b, lambda x, y: ~_lt(x, y) & ~_lt(y, x))


def le(a: Column, b: Column) -> Column:
    return ~lt(b, a)


def field(name: str, fields: str = "fields") -> Column:
    """A field's value; one that is missing is the number 0."""
    return F.coalesce(F.try_element_at(F.col(fields), F.lit(name)), zero())


def is_zero(v: Column) -> Column:
    return (v["kind"] == NUMBER) & (v["num"] == 0)


def without_zeros(fields: Column) -> Column:
    """Fields as they are stored: those that are 0 are dropped."""
    return F.map_filter(fields, lambda _, v: ~is_zero(v))
