"""Writes into JSON texts by dotted paths, as Arrow-batched functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def inferred(text: str, raw: bool = False, string: bool = False):
    """Value of a text: JSON if raw, text if string, else numbers, booleans and null by their form."""
    if string:
        return text
    try:
        v = json.loads(text)
    except ValueError:
        if raw:
            raise
        return text
    return v if raw or isinstance(v, int | float | bool) or v is None else text


def placed(doc: str | None, path: str, value) -> str:
    """The document with a value at a path; missing steps become objects, or arrays where the step is 0."""
    root = json.loads(doc) if doc else None
    steps = path.split(".")

    def put(node, rest: list[str]):
        if not rest:
            return value
        step = rest[0]
        if isinstance(node, list) or node is None and step == "0":
            node = node or []
            at = len(node) if step == "-1" else int(step)
            node += [None] * (at + 1 - len(node))
            node[at] = put(node[at], rest[1:])
            return node
        node = node if isinstance(node, dict) else {}
        node[step] = put(node.get(step), rest[1:])
        return node

    return json.dumps(put(root, steps), separators=(",", ":"), ensure_ascii=False)


def removed(doc: str, path: str) -> str:
    """The document without a path; KeyError if it is not there."""
    root = json.loads(doc)
    *steps, last = path.split(".")
    node = root
    for s in steps:
        node = node[int(s)] if isinstance(node, list) else node[s]
    if isinstance(node, list):
        node.pop(int(last))
    else:
        del node[last]
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


def without(doc: str | None, path: str) -> str | None:
    """The document without a path; the same text if it is not there."""
    try:
        return None if doc is None else removed(doc, path)
    except (KeyError, IndexError, ValueError, TypeError):
        return doc


def json_set(doc: Column, path: str, text: str, raw: bool = False, string: bool = False) -> Column:
    value = inferred(text, raw, string)

    @F.pandas_udf("string")
    def change(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: placed(d, path, value))

    return change(doc)


def json_delete(doc: Column, path: str) -> Column:
    """Null where the path is absent."""

    @F.pandas_udf("string")
    def change(docs: pd.Series) -> pd.Series:
        def one(d):
            try:
                return None if d is None else removed(d, path)
            except (KeyError, IndexError, ValueError, TypeError):
                return None

        return docs.map(one)

    return change(doc)
