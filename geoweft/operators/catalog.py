"""Catalog tables: record filters, layouts over areas, dependants, hook registry, Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs


def like(column: Column, pattern: str, any_case: bool = False) -> Column:
    """Equality, or LIKE where * or ? occur (for % and _)."""
    if not set(pattern) & set("*?%_"):
        return column == pattern if not any_case else F.lower(column) == pattern.lower()
    p = pattern.replace("*", "%").replace("?", "_")
    return column.ilike(p) if any_case else column.like(p)


def records(table: DataFrame, name: str | None = None, tags: dict[str, str | None] | None = None, start=None, end=None) -> DataFrame:
    """Records (id, name, datetime, tags) by name pattern, tags (a value pattern, or None: the key is there) and an inclusive time range."""
    if name:
        table = table.where(like(F.col("name"), name))
    for k, v in (tags or {}).items():
        table = table.where(F.map_contains_key("tags", F.lit(k)) if v is None else like(F.try_element_at(F.col("tags"), F.lit(k)), v))
    if start is not None:
        table = table.where(F.col("datetime") >= start)
    if end is not None:
        table = table.where(F.col("datetime") <= end)
    return table


def datasets(table: DataFrame, records: list | None = None, status: str | None = None, container: str | None = None, area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Datasets (record, container, status, min_x, min_y, max_x, max_y) of some records, of a status, in a container (pattern), that meet an area."""
    if records is not None:
        table = table.where(F.col("record").isin(records))
    if status is not None:
        table = table.where(F.col("status") == status)
    if container is not None:
        table = table.where(like(F.col("container"), container))
    if area is not None:
        table = table.where((F.col("min_x") <= area[2]) & (F.col("max_x") >= area[0]) & (F.col("min_y") <= area[3]) & (F.col("max_y") >= area[1]))
    return table


def listed(records: DataFrame, datasets: DataFrame, areas: DataFrame) -> DataFrame:
    """Records (id, aoi, datetime) with their datasets (record, dataset, box) where those meet the record's area (aoi, box a_min_x..): by time and id.

    Both joins are equi-joins on ids; the boxes are compared behind them.
    """
    meets = (F.col("min_x") <= F.col("a_max_x")) & (F.col("max_x") >= F.col("a_min_x")) & (F.col("min_y") <= F.col("a_max_y")) & (F.col("max_y") >= F.col("a_min_y"))
    rows = datasets.join(records.withColumnRenamed("id", "record"), "record").join(areas, "aoi").where(meets)
    return rows.orderBy("datetime", "record", "dataset")


def formats(datasets: DataFrame) -> DataFrame:
    """How many datasets have each data format (dtype, no_data, min_value, max_value)."""
    keys = ["dtype", "no_data", "min_value", "max_value"]
    return datasets.groupBy(*keys).agg(F.count("*").alias("n"))


def by_count(cells: DataFrame) -> DataFrame:
    """Buckets (cell, n), the fullest first, then by cell."""
    return cells.orderBy(F.desc("n"), "cell")


def by_expiry(objects: DataFrame) -> DataFrame:
    """Objects that expire, the next one first, then by id."""
    return objects.where("expires > 0").orderBy("expires", "key", "id")


def valid_entities(points: DataFrame) -> DataFrame:
    """Entities with an id, a collection, and coordinates on the globe."""
    on_globe = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return points.where(F.col("id").isNotNull() & (F.length(F.col("id").cast("string")) > 0) & (F.length("collection") > 0) & F.coalesce(on_globe, F.lit(False)))


def without_dependants(table: DataFrame, key: str, dependants: DataFrame, reference: str) -> DataFrame:
    """Rows that nothing refers to."""
    return table.join(dependants.select(F.col(reference).alias("__ref")), F.col(key) == F.col("__ref"), "left_anti")


def layout_cells(areas: DataFrame, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Cells "i/j" of a regular layout that areas (id, min_x, min_y, max_x, max_y) touch: id, cell, and the cell's box."""
    at = lambda c, i: F.floor((F.col(c) - origin[i]) / size).cast("long")
    xs, ys = F.sequence(at("min_x", 0), at("max_x", 0)), F.sequence(at("min_y", 1), at("max_y", 1))
    rows = areas.withColumn("i", F.explode(xs)).withColumn("j", F.explode(ys))
    x, y = F.col("i") * size + origin[0], F.col("j") * size + origin[1]
    return rows.select("id", F.concat_ws("/", "i", "j").alias("cell"), x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"))


def hooks(registry: DataFrame, pattern: str = "*") -> DataFrame:
    return registry.where(globs.matches(F.col("hook"), [pattern])).orderBy("hook")


def set_hooks(registry: DataFrame, new: DataFrame) -> DataFrame:
    """New hooks replace those of the same name."""
    return registry.join(new.select("hook"), "hook", "left_anti").select(*registry.columns).unionByName(new.select(*registry.columns))


def delete_hooks(registry: DataFrame, pattern: str) -> DataFrame:
    return registry.where(~globs.matches(F.col("hook"), [pattern]))


class Bloom:
    """A Bloom filter of a column: its words are gathered by bitwise or, so the driver holds `bits` bits whatever the rows."""

    def __init__(self, rows: DataFrame, column: str, expected: int, rate: float = 0.01):
        self.bits = max(64, math.ceil(-expected * math.log(rate) / math.log(2) ** 2 / 64) * 64)
        self.hashes = max(1, round(self.bits / max(1, expected) * math.log(2)))
        at = F.explode(F.array(*self.places(F.col(column))))
        words = rows.where(F.col(column).isNotNull()).select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))
        self.words = [0] * (self.bits // 64)
        for r in words.agg(F.bit_or(bit).alias("b")).collect():
            self.words[r["w"]] = r["b"]

    def places(self, x: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(x, F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def may_contain(self, x: Column) -> Column:
        table = F.from_json(F.lit(str(self.words)), "array<bigint>")
        out = F.lit(True)
        for p in self.places(x):
            word = F.get(table, F.shiftright(p, 6).cast("int"))
            out = out & (F.call_function("shiftright", word, p.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
        return out

    def false_positive_rate(self) -> float:
        """From the share of set bits."""
        return (sum((w & (1 << 64) - 1).bit_count() for w in self.words) / self.bits) ** self.hashes
