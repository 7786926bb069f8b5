"""Writes to an objects table (key, id, .., fields, expires) as DataFrame rewrites: each returns the table after the write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs, values

CONTENT = ("lat", "lon", "z", "value", "geom")


def put(table: DataFrame, changes: DataFrame, mode: str | None = None) -> DataFrame:
    """SET: changes (key, id, content, fields, expires; once for each object) replace content and expiry; fields are merged over the old ones,
    zeros removed. mode NX writes new objects only, XX existing ones only."""
    old = table.select([F.col(c).alias(f"old_{c}") for c in table.columns])
    both = old.join(changes, (F.col("old_key") == F.col("key")) & (F.col("old_id") == F.col("id")), "full_outer")
    was, new = F.col("old_id").isNotNull(), F.col("id").isNotNull()
    write = new & {"NX": ~was, "XX": was, None: F.lit(True)}[mode]
    none = F.create_map().cast(table.schema["fields"].dataType)
    merged = values.without_zeros(F.map_zip_with(F.coalesce("old_fields", none), F.coalesce("fields", none), lambda _, a, b: F.coalesce(b, a)))
    out = {c: F.when(write, F.col(c)).otherwise(F.col(f"old_{c}")) for c in table.columns if c not in ("fields", "expires")}
    out["fields"] = F.when(write, merged).otherwise(F.col("old_fields"))
    out["expires"] = F.when(write, F.coalesce("expires", F.lit(0))).otherwise(F.col("old_expires"))
    return both.where(was | write).select(*[out[c].alias(c) for c in table.columns])


def set_fields(table: DataFrame, changes: DataFrame) -> DataFrame:
    """FSET: changes (key, id, fields); expiry and content stay; unknown objects are passed over. Adds no rows."""
    new = changes.select("key", "id", F.col("fields").alias("new_fields"))
    merged = F.map_zip_with("fields", "new_fields", lambda _, a, b: F.coalesce(b, a))
    joined = table.join(new, ["key", "id"], "left")
    fields = F.when(F.col("new_fields").isNull(), F.col("fields")).otherwise(values.without_zeros(merged))
    return joined.withColumn("fields", fields).select(*table.columns)


def delete(table: DataFrame, key: str, ids: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """DEL by id, PDEL by pattern, DROP without either."""
    gone = F.col("key") == key
    if ids is not None:
        gone = gone & F.col("id").isin(ids)
    if patterns is not None:
        gone = gone & globs.matches(F.col("id"), patterns)
    return table.where(~gone)


def rename(table: DataFrame, key: str, to: str, only_new: bool = False) -> DataFrame:
    """RENAME replaces what the new key held; RENAMENX (only_new) keeps it and changes nothing. A missing key is an error."""
    if table.where(F.col("key") == key).isEmpty():
        raise ValueError("key not found")
    if only_new and not table.where(F.col("key") == to).isEmpty():
        return table
    return table.where(F.col("key") != to).withColumn("key", F.when(F.col("key") == key, to).otherwise(F.col("key")))


def expire(table: DataFrame, key: str, ids: list[str], at_ns: int | None) -> DataFrame:
    """EXPIRE at a time, or PERSIST with None."""
    hit = (F.col("key") == key) & F.col("id").isin(ids)
    return table.withColumn("expires", F.when(hit, F.lit(at_ns or 0).cast("long")).otherwise(F.col("expires")))


def live(table: DataFrame, now_ns: int) -> DataFrame:
    return table.where((F.col("expires") == 0) | (F.col("expires") > now_ns))
