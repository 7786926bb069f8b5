"""The command language: a command's words become one DataFrame over an objects table.

objects: key, id, lat, lon, z, value, fields (map of values), geom (WKB or null for points and strings), expires (ns, 0 never).
Only the result's columns and the rows' filters are built here; the optimizer plans the rest. Commands that write give a new engine over
the rewritten table (`write`).
"""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, documents, geodesy, globs, overlay, values
from ..functions import geometry as geo
from ..operators import store
from . import areas, where

DEFAULT_LIMIT = 100
NO_LIMIT = (1 << 31) - 1  # a LIMIT of so many rows or more asks for all of them, so no task has to gather them
OUTPUTS = ("COUNT", "IDS", "OBJECTS", "POINTS", "HASHES", "BOUNDS")


@dataclass
class Plan:
    """What a search command asks for."""

    command: str
    key: str
    globs: list[str] = field(default_factory=list)
    tests: list[Column] = field(default_factory=list)
    cursor: int = 0
    limit: int | None = None
    descending: bool = False
    output: str = "OBJECTS"
    precision: int = 0
    fields: bool = True
    distance: bool = False
    sparse: int = 0
    clip: bool = False
    area: areas.Area | None = None


class Engine:
    """Runs commands over an objects table. predicates: named functions of rows' columns for WHEREEVAL."""

    def __init__(self, objects: DataFrame, predicates: dict[str, Callable[[list[str]], Column]] | None = None, now_ns: int | None = None):
        live = objects if now_ns is None else objects.where((F.col("expires") == 0) | (F.col("expires") > now_ns))
        self.objects, self.predicates, self.now = live, predicates or {}, now_ns

    def run(self, command: str | list[str]) -> DataFrame:
        words = areas.Words(shlex.split(command) if isinstance(command, str) else list(command))
        name = words.take().upper()
        if name in ("SCAN", "SEARCH", "NEARBY", "WITHIN", "INTERSECTS"):
            return self.execute(self.plan(name, words))
        plain = getattr(self, f"cmd_{name.lower()}", None)
        if plain is None:
            raise ValueError(f"unknown command {name!r}")
        out = plain(words)
        words.end()
        return out

    def write(self, command: str | list[str]) -> Engine:
        """The engine after a command that changes the table. Times are counted from `now_ns` (0 if unset)."""
        words = areas.Words(shlex.split(command) if isinstance(command, str) else list(command))
        name = words.take().upper()
        change = getattr(self, f"write_{name.lower()}", None)
        if change is None:
            raise ValueError(f"unknown command {name!r}")
        table = change(words)
        words.end()
        out = Engine(table, self.predicates)
        out.now = self.now
        return out

    def rows(self, *values_: tuple, kind: str) -> DataFrame:
        return self.objects.sparkSession.createDataFrame(list(values_), kind)

    def write_set(self, words: areas.Words) -> DataFrame:
        """SET key id [FIELD name value]... [EX seconds] [NX|XX] content."""
        key, id_, fields, expires, mode = words.take(), words.take(), [], 0, None
        while words.peek() in ("FIELD", "EX", "NX", "XX"):
            option = words.take().upper()
            if option == "FIELD":
                fields += [F.lit(words.take().lower()), values.constant(words.take())]
            elif option == "EX":
                expires = (self.now or 0) + int(words.number(0) * 1e9)
            else:
                mode = option
        kind, z, text, shape = words.take().upper(), 0.0, None, None
        if kind == "STRING":
            text = words.take()
        elif kind == "POINT":
            lat, lon = words.number(), words.number()
            z = words.number() if words.peek() else 0.0
            shape = {"type": "Point", "coordinates": [lon, lat]}
        elif kind in ("BOUNDS", "HASH"):
            box = [words.number() for _ in range(4)] if kind == "BOUNDS" else areas.hash_box(words.take())
            shape = geo.rectangle(box[1], box[0], box[3], box[2])
            if kind == "HASH":
                shape = {"type": "Point", "coordinates": [(box[1] + box[3]) / 2, (box[0] + box[2]) / 2]}
        elif kind == "OBJECT":
            shape = areas.geojson(words.take())
        else:
            raise ValueError(f"invalid argument {kind!r}")
        at = geo.bounds(shape) if shape else None
        row = self.rows((key, id_, *(((at[1] + at[3]) / 2, (at[0] + at[2]) / 2) if at else (None, None)), z, text, geo.to_wkb(shape) if shape and shape["type"] != "Point" else None, expires), kind="key string, id string, lat double, lon double, z double, value string, geom binary, expires bigint")
        held = F.create_map(*fields) if fields else F.create_map().cast(self.objects.schema["fields"].dataType)
        return store.put(self.objects, row.withColumn("fields", held.cast(self.objects.schema["fields"].dataType)), mode)

    def write_fset(self, words: areas.Words) -> DataFrame:
        """FSET key id [XX] name value...; without XX, an object that isn't there is an error."""
        key, id_ = words.take(), words.take()
        lenient = words.peek() == "XX" and bool(words.take())
        fields = []
        while words.peek():
            fields += [F.lit(words.take().lower()), values.constant(words.take())]
        if not fields:
            raise ValueError("wrong number of arguments")
        if not lenient and self.objects.where((F.col("key") == key) & (F.col("id") == id_)).isEmpty():
            raise ValueError("id not found")
        change = self.rows((key, id_), kind="key string, id string").withColumn("fields", F.create_map(*fields).cast(self.objects.schema["fields"].dataType))
        return store.set_fields(self.objects, change)

    def write_del(self, words: areas.Words) -> DataFrame:
        return store.delete(self.objects, words.take(), ids=[words.take()])

    def write_pdel(self, words: areas.Words) -> DataFrame:
        return store.delete(self.objects, words.take(), patterns=[words.take()])

    def write_drop(self, words: areas.Words) -> DataFrame:
        return store.delete(self.objects, words.take())

    def write_flushdb(self, words: areas.Words) -> DataFrame:
        return self.objects.where(F.lit(False))

    def write_rename(self, words: areas.Words) -> DataFrame:
        return store.rename(self.objects, words.take(), words.take())

    def write_renamenx(self, words: areas.Words) -> DataFrame:
        return store.rename(self.objects, words.take(), words.take(), only_new=True)

    def write_expire(self, words: areas.Words) -> DataFrame:
        key, id_ = words.take(), words.take()
        return store.expire(self.objects, key, [id_], (self.now or 0) + int(words.number(0) * 1e9))

    def write_persist(self, words: areas.Words) -> DataFrame:
        return store.expire(self.objects, words.take(), [words.take()], None)

    def write_jset(self, words: areas.Words) -> DataFrame:
        """JSET key id path value [RAW|STR] on an object's text; a missing object starts as {}."""
        key, id_, path, text = words.take(), words.take(), words.take(), words.take()
        form = words.take().upper() if words.peek() else ""
        if form not in ("", "RAW", "STR"):
            raise ValueError(f"invalid argument {form!r}")
        value = documents.inferred(text, form == "RAW", form == "STR")
        table = self.edited(key, id_, lambda doc: documents.placed(doc, path, value))
        if table is not None:
            return table
        row = self.rows((key, id_, 0.0, documents.placed("{}", path, value), 0), kind="key string, id string, z double, value string, expires bigint")
        return self.objects.unionByName(row.withColumn("fields", F.create_map().cast(self.objects.schema["fields"].dataType)), allowMissingColumns=True)

    def edited(self, key: str, id_: str, change: Callable[[str | None], str | None]) -> DataFrame | None:
        """The table with the object's text changed, or None if it isn't there. The text is changed here, so that a write adds one projection:
        a union of the object with all others would double the plan with every write."""
        here, value = (F.col("key") == key) & (F.col("id") == id_), F.col("value")
        texts = [r["value"] for r in self.objects.where(here).select("value").distinct().collect()]
        for text in texts:
            value = F.when(here & F.col("value").eqNullSafe(F.lit(text)), F.lit(change(text))).otherwise(value)
        return self.objects.withColumn("value", value) if texts else None

    def write_jdel(self, words: areas.Words) -> DataFrame:
        """JDEL key id path; a path that isn't there changes nothing."""
        key, id_, path = words.take(), words.take(), words.take()
        table = self.edited(key, id_, lambda doc: documents.without(doc, path))
        return self.objects if table is None else table

    def stored(self, key: str, id_: str) -> dict | None:
        row = self.objects.where((F.col("key") == key) & (F.col("id") == id_) & F.col("lat").isNotNull()).select("lat", "lon", "geom").first()
        if row is None:
            return None
        return geo.from_wkb(bytes(row["geom"])) if row["geom"] is not None else {"type": "Point", "coordinates": [row["lon"], row["lat"]]}

    def plan(self, name: str, words: areas.Words) -> Plan:
        p, seen = Plan(name, words.take()), set()

        def once(option: str) -> None:
            if option in seen:
                raise ValueError(f"duplicate argument {option!r}")
            seen.add(option)

        while True:
            option = words.peek()
            if option in ("CURSOR", "LIMIT", "SPARSE"):
                once(option)
                words.take()
                n = int(words.number(0 if option == "CURSOR" else 1, 16 if option == "SPARSE" else float(1 << 62)))
                setattr(p, option.lower(), n)
            elif option == "MATCH":
                words.take()
                p.globs.append(words.take())
            elif option in ("ASC", "DESC"):
                if name not in ("SCAN", "SEARCH"):
                    raise ValueError(f"{option} is not allowed for {name}")
                once("ASC")
                words.take()
                p.descending = option == "DESC"
            elif option == "WHERE":
                words.take()
                p.tests.append(self.range_test(words))
            elif option == "WHEREIN":
                words.take()
                v, n = values.field(words.take()), int(words.number(1))
                p.tests.append(any_of([values.eq(v, values.constant(words.take())) for _ in range(n)]))
            elif option == "WHEREEVAL":
                words.take()
                predicate, n = words.take(), int(words.number(0))
                if predicate not in self.predicates:
                    raise ValueError(f"unknown predicate {predicate!r}")
                p.tests.append(self.predicates[predicate]([words.take() for _ in range(n)]))
            elif option in ("NOFIELDS", "DISTANCE", "CLIP"):
                once(option)
                words.take()
                p.fields, p.distance, p.clip = p.fields and option != "NOFIELDS", p.distance or option == "DISTANCE", p.clip or option == "CLIP"
            elif option in OUTPUTS and not (option == "BOUNDS" and name in ("WITHIN", "INTERSECTS") and "output" in seen):
                if option == "BOUNDS" and name in ("WITHIN", "INTERSECTS") and len(words.words) - words.at == 5:
                    break  # the area itself
                once("output")
                words.take()
                p.output = option
                p.precision = int(words.number(1, 12)) if option == "HASHES" else 0
            else:
                break
        if name == "NEARBY":
            if words.take().upper() != "POINT":
                raise ValueError("NEARBY takes a POINT")
            lat, lon = words.number(-90, 90), words.number(-180, 180)
            meters = words.number(0) if words.at < len(words.words) else None
            p.area = areas.circle_area(lat, lon, meters if meters is not None else 1e12)
            p.area.meters = meters
            if p.sparse and meters is None:
                raise ValueError("SPARSE needs a radius")
        elif name in ("WITHIN", "INTERSECTS"):
            p.area = areas.area(words, self.stored)
            while words.peek() == "CLIPBY":
                words.take()
                by = areas.area(words, self.stored)
                p.area = areas.shape_area(geo.clip(p.area.shape, (by.box[1], by.box[0], by.box[3], by.box[2])))
            if words.peek() == "BUFFER":
                words.take()
                p.area = areas.shape_area(overlay.buffered(p.area.shape, words.number(0)))
        words.end()
        if p.sparse and (p.cursor or p.limit):
            raise ValueError("SPARSE excludes CURSOR and LIMIT")
        if p.limit is None and p.output != "COUNT":
            p.limit = DEFAULT_LIMIT
        if p.limit is not None and p.limit >= NO_LIMIT:
            p.limit = None
        return p

    def range_test(self, words: areas.Words) -> Column:
        """name min max, name op value, or an expression."""
        first = words.take()
        second = words.peek()
        if words.at >= len(words.words) or second[:1].isalpha() and second not in ("INF", "NAN", "TRUE", "FALSE", "NULL") or any(c in first for c in "=<>&|!( "):
            return where.parse(first)
        v, second = values.field(first), words.take()
        if second in ("<", "<=", ">", ">=", "==", "!="):
            x = values.constant(words.take().lower())
            return {"<": values.lt(v, x), "<=": values.le(v, x), ">": values.lt(x, v), ">=": values.le(x, v), "==": values.eq(v, x), "!=": ~values.eq(v, x)}[second]
        third = words.take()

        def side(raw: str, low: bool) -> Column:
            open_ = raw.startswith("(")
            x = values.constant(raw[open_:].lower())
            a, b = (x, v) if low else (v, x)
            return values.lt(a, b) if open_ else values.le(a, b)

        return side(second, True) & side(third, False)

    def execute(self, p: Plan) -> DataFrame:
        rows = self.objects.where(F.col("key") == p.key)
        if p.command == "SEARCH":
            rows = rows.where(F.col("value").isNotNull())
        order = {"SEARCH": ["value", "id"], "NEARBY": ["dist", "id"]}.get(p.command, ["id"])
        if p.area:
            rows = rows.where(F.col("lat").isNotNull())
            rows = met(rows, "INTERSECTS" if p.command == "NEARBY" else p.command, p.area) if p.command != "NEARBY" or p.area.meters is not None else rows
        if p.area and p.area.centre:
            rows = with_distance(rows, *p.area.centre)
        if p.sparse:
            rows = thinned(rows, p.area.box, p.sparse)
        order = [F.col(c).desc() if p.descending else F.col(c).asc() for c in order]
        if p.cursor:
            rows = rows.orderBy(*order).offset(p.cursor)
        subject = F.col("value" if p.command == "SEARCH" else "id")
        if p.globs:
            rows = rows.where(globs.matches(subject, p.globs))
        for test in p.tests:
            rows = rows.where(test)
        if p.output == "COUNT":
            rows = rows.limit(p.limit) if p.limit else rows
            return rows.agg(F.count("*").alias("count"))
        rows = rows.orderBy(*order)
        rows = rows.limit(p.limit) if p.limit else rows
        return rows.select("id", *self.outputs(p, rows))

    def outputs(self, p: Plan, rows: DataFrame) -> list[Column]:
        out: list[Column] = []
        if p.output == "OBJECTS":
            shape = F.col("geom")
            if p.clip and p.area:
                b = p.area.box
                shape = geo.st_clip(shape, (b[1], b[0], b[3], b[2]))
            out = [F.col("lat"), F.col("lon"), shape.alias("geom"), F.col("value")]
        elif p.output == "POINTS":
            out = [F.col("lat"), F.col("lon"), F.col("z")]
        elif p.output == "HASHES":
            out = [cells.geohash("lat", "lon", p.precision).alias("hash")]
        elif p.output == "BOUNDS":
            out = [c.alias(name) for name, c in corners().items()]
        if p.fields and p.output != "IDS":
            out.append(F.col("fields"))
        if p.distance and "dist" in rows.columns:
            out.append(F.col("dist").alias("distance"))
        return out

    def one(self, words: areas.Words) -> DataFrame:
        key, id_ = words.take(), words.take()
        return self.objects.where((F.col("key") == key) & (F.col("id") == id_))

    def cmd_get(self, words: areas.Words) -> DataFrame:
        rows = self.one(words)
        with_fields = words.peek() == "WITHFIELDS" and bool(words.take())
        kind = words.take().upper() if words.peek() else "OBJECT"
        if kind not in ("OBJECT", "POINT", "BOUNDS", "HASH"):
            raise ValueError(f"invalid argument {kind!r}")
        p = Plan("GET", "", output={"OBJECT": "OBJECTS", "POINT": "POINTS", "HASH": "HASHES"}.get(kind, kind), fields=with_fields)
        p.precision = int(words.number(1, 12)) if kind == "HASH" else 0
        return rows.select("id", *self.outputs(p, rows))

    def cmd_fget(self, words: areas.Words) -> DataFrame:
        return self.one(words).select(values.field(words.take())["data"].alias("value"))

    def cmd_exists(self, words: areas.Words) -> DataFrame:
        return self.one(words).agg((F.count("*") > 0).cast("int").alias("exists"))

    def cmd_fexists(self, words: areas.Words) -> DataFrame:
        rows = self.one(words)
        return rows.select(F.map_contains_key("fields", words.take()).cast("int").alias("exists"))

    def cmd_ttl(self, words: areas.Words) -> DataFrame:
        left = F.when(F.col("expires") == 0, -1.0).otherwise((F.col("expires") - F.lit(self.now or 0)) / 1e9)
        return self.one(words).agg(F.coalesce(F.first(left), F.lit(-2.0)).alias("ttl"))

    def cmd_type(self, words: areas.Words) -> DataFrame:
        return self.objects.where(F.col("key") == words.take()).agg(F.when(F.count("*") > 0, "hash").otherwise("none").alias("type"))

    def cmd_keys(self, words: areas.Words) -> DataFrame:
        return self.objects.where(globs.matches(F.col("key"), [words.take()])).select("key").distinct().orderBy("key")

    def cmd_bounds(self, words: areas.Words) -> DataFrame:
        rows = self.objects.where((F.col("key") == words.take()) & F.col("lat").isNotNull())
        point = {"min_lat": F.col("lat"), "min_lon": F.col("lon"), "max_lat": F.col("lat"), "max_lon": F.col("lon")}
        of = lambda rows, box: rows.select(*[c.alias(name) for name, c in box.items()])
        boxes = of(rows.where("geom is null"), point).unionByName(of(rows.where("geom is not null"), corners()))
        return boxes.agg(*[(F.min if name.startswith("min") else F.max)(name).alias(name) for name in point])

    def cmd_stats(self, words: areas.Words) -> DataFrame:
        keys = [words.take()]
        while words.peek():
            keys.append(words.take())
        wanted = self.objects.sparkSession.createDataFrame([(k,) for k in keys], "key string")
        found = self.objects.groupBy("key").agg(F.count("*").alias("num_objects"), F.count_if(F.col("lat").isNotNull()).alias("num_points"), F.count_if(F.col("value").isNotNull()).alias("num_strings"))
        return wanted.join(found, "key", "left")

    def cmd_jget(self, words: areas.Words) -> DataFrame:
        rows = self.one(words)
        text = F.col("value")
        if words.peek():
            steps = [f"[{s}]" if s.isdigit() else f".{s}" for s in words.take().split(".")]
            text = F.get_json_object(text, "$" + "".join(steps))
        return rows.select(text.alias("value"))

    def cmd_test(self, words: areas.Words) -> DataFrame:
        """TEST area WITHIN|INTERSECTS area expression: 1 or 0."""
        left = areas.area(words, self.stored)
        kind = words.take().upper()
        if kind not in ("WITHIN", "INTERSECTS"):
            raise ValueError(f"invalid argument {kind!r}")
        test = geo.within if kind == "WITHIN" else geo.intersects
        tree = areas.expression(words, self.stored)
        holds = tree(lambda a: Truth(test(left.shape, a.shape))).value
        return self.objects.sparkSession.createDataFrame([(int(holds),)], "result int")


@dataclass
class Truth:
    value: bool

    def __and__(self, other: Truth) -> Truth:
        return Truth(self.value and other.value)

    def __or__(self, other: Truth) -> Truth:
        return Truth(self.value or other.value)

    def __invert__(self) -> Truth:
        return Truth(not self.value)


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def corners() -> dict[str, Column]:
    """The box of any object, by a kernel over its geometry."""
    side = lambda i, c: F.coalesce(geo.over(lambda g: float(geo.bounds(g)[i]), "double")("geom"), F.col(c))
    return {"min_lat": side(1, "lat"), "min_lon": side(0, "lon"), "max_lat": side(3, "lat"), "max_lon": side(2, "lon")}


def with_distance(rows: DataFrame, lat: float, lon: float) -> DataFrame:
    """Add dist: metres to a point, or to the box of any other geometry (0 within). Only rows with a geometry meet the kernel."""
    points = rows.where("geom is null").withColumn("dist", geodesy.haversine_m("lat", "lon", lat, lon))
    box = corners()
    shapes = rows.where("geom is not null").withColumns({f"__{c}": x for c, x in box.items()})
    shapes = shapes.withColumn("dist", geodesy.point_rect_m(F.lit(lat), F.lit(lon), *[F.col(f"__{c}") for c in box])).drop(*[f"__{c}" for c in box])
    return points.unionByName(shapes)


def met(rows: DataFrame, command: str, area: areas.Area) -> DataFrame:
    """Rows within or meeting an area: points by Column expressions alone, other geometries by a kernel, after their stored boxes if the table has these."""
    kernel = geo.st_within if command == "WITHIN" else geo.st_intersects
    points = rows.where(F.col("geom").isNull() & area.point(F.col("lat"), F.col("lon")))
    shapes = rows.where("geom is not null")
    if {"min_lat", "min_lon", "max_lat", "max_lon"} <= set(rows.columns):
        a, o, b, p = area.box
        shapes = shapes.where((F.col("min_lat") <= b) & (F.col("max_lat") >= a) & ((F.col("min_lon") <= p) & (F.col("max_lon") >= o) | F.lit(o > p or p > 180 or o < -180)))
    return points.unionByName(shapes.where(kernel(F.col("geom"), F.lit(geo.to_wkb(area.shape)))))


def thinned(rows: DataFrame, box: tuple, level: int) -> DataFrame:
    """The least id of each of 4^level cells of the area's box."""
    n = 1 << level
    at = lambda c, low, high: F.least(F.greatest(F.floor((F.col(c) - low) / max(high - low, 1e-12) * n), F.lit(0)), F.lit(n - 1))
    w = Window.partitionBy(at("lat", box[0], box[2]), at("lon", box[1], box[3])).orderBy("id")
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
