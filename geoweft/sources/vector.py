"""Vector files as DataFrames: GeoJSON, shapefiles, GeoPackages, OSM XML.

GeoJSON and OSM XML are read with built-in readers. Shapefiles and GeoPackages are Python data sources ("geoshp", "geogpkg"); register() makes them
known to a session. Geometries are WKB in a column `geom`.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as geo


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: id, properties (JSON), geom. Files hold a FeatureCollection, or one feature or geometry a line."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.when(F.get_json_object("value", "$.features").isNotNull(), F.array("value")).otherwise(F.split("value", "\n"))).alias("doc")).where("trim(doc) <> ''")
    features = F.from_json(F.get_json_object("doc", "$.features"), "array<string>")
    rows = docs.select(F.explode(F.coalesce(features, F.array("doc"))).alias("f"))
    shape = F.coalesce(F.get_json_object("f", "$.geometry"), F.col("f"))
    return rows.select(F.get_json_object("f", "$.id").alias("id"), F.get_json_object("f", "$.properties").alias("properties"), geo.text_to_wkb(geo.from_geojson)(shape).alias("geom"))


def write_geojson(rows: DataFrame, path: str, id_: str = "id", properties: str = "properties", geom: str = "geom") -> None:
    """One feature a line."""
    head = F.concat(F.lit('{"type":"Feature","id":'), F.coalesce(F.to_json(F.struct(F.col(id_).cast("string").alias("v"))), F.lit('{"v":null}')))
    inner = F.regexp_extract(head, r'^(.*"id":)\{"v":(.*)\}$', 1)
    value = F.coalesce(F.regexp_extract(head, r'"id":\{"v":(.*)\}$', 1), F.lit("null"))
    value = F.when(value == "", F.lit("null")).otherwise(value)
    text = F.concat(inner, value, F.lit(',"properties":'), F.coalesce(properties, F.lit("{}")), F.lit(',"geometry":'), F.coalesce(geo.st_as_geojson(F.col(geom)), F.lit("null")), F.lit("}"))
    rows.select(text.alias("value")).write.text(path)


#: Shape type codes of two dimensions; 10 more has z, 20 more has m.
POINT, POLYLINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
KIND = {"C": "string", "N": "double", "F": "double", "L": "boolean", "D": "date", "M": "string"}


def shape_of(record: bytes) -> dict | None:
    """Geometry of a shape record; null shapes give none. Rings that run clockwise are outer ones."""
    (code,) = struct.unpack_from("<i", record)
    if code == 0:
        return None
    code %= 10
    if code == POINT:
        return {"type": "Point", "coordinates": list(struct.unpack_from("<dd", record, 4))}
    if code == MULTIPOINT:
        (n,) = struct.unpack_from("<i", record, 36)
        return {"type": "MultiPoint", "coordinates": [list(struct.unpack_from("<dd", record, 40 + 16 * i)) for i in range(n)]}
    if code not in (POLYLINE, POLYGON):
        raise ValueError(f"unsupported shape type {code}")
    n_parts, n_points = struct.unpack_from("<ii", record, 36)
    firsts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    base = 44 + 4 * n_parts
    lines = [[list(struct.unpack_from("<dd", record, base + 16 * i)) for i in range(a, b)] for a, b in zip(firsts, firsts[1:], strict=False)]
    if code == POLYLINE:
        return {"type": "LineString", "coordinates": lines[0]} if n_parts == 1 else {"type": "MultiLineString", "coordinates": lines}
    polys = [[r] for r in lines if geo.ring_area(r) <= 0]
    for hole in (r for r in lines if geo.ring_area(r) > 0):
        home = next((p for p in polys if geo.ring_position(hole[0], p[0]) >= 0), None)
        home.append(hole) if home else polys.append([hole])
    return {"type": "Polygon", "coordinates": polys[0]} if len(polys) == 1 else {"type": "MultiPolygon", "coordinates": polys}


def record_of(g: dict | None) -> bytes:
    if g is None:
        return struct.pack("<i", 0)
    ps, ls, gs = geo.parts(g)
    box = struct.pack("<4d", *geo.bounds(g))
    if g["type"] == "Point":
        return struct.pack("<idd", POINT, *ps[0][:2])
    if g["type"] == "MultiPoint":
        return struct.pack("<i", MULTIPOINT) + box + struct.pack("<i", len(ps)) + b"".join(struct.pack("<dd", *p[:2]) for p in ps)
    if not ls and not gs:
        raise ValueError(f"shapefiles cannot hold {g['type']}")
    turned = [r if (geo.ring_area(r) < 0) == (i == 0) else r[::-1] for poly in gs for i, r in enumerate(poly)]
    lines, code = (ls, POLYLINE) if ls else (turned, POLYGON)
    at, firsts = 0, []
    for x in lines:
        firsts.append(at)
        at += len(x)
    return struct.pack("<i", code) + box + struct.pack(f"<ii{len(lines)}i", len(lines), at, *firsts) + b"".join(struct.pack("<dd", *p[:2]) for x in lines for p in x)


def dbf_fields(data: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Rows, header size, row size and fields (name, type, length, decimals) of a DBF head."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return n, head, size, fields


def dbf_value(raw: bytes, kind: str, decimals: int, encoding: str = "utf-8"):
    import datetime

    t = raw.decode(encoding, "replace").strip().strip("\0")
    if kind in "NF":
        return float(t) if t and set(t) - {"*"} else None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(t[:1].upper())
    if kind == "D":
        return datetime.date(int(t[:4]), int(t[4:6]), int(t[6:8])) if len(t) == 8 and t.isdigit() else None
    return t


class Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class ShapefileSource(DataSource):
    """Option path: the .shp file, beside it .shx and .dbf. Partitions are ranges of records, found by the .shx index."""

    @classmethod
    def name(cls) -> str:
        return "geoshp"

    def stem(self) -> str:
        return os.path.splitext(self.options["path"].removeprefix("file://"))[0]

    def schema(self) -> str:
        with open(self.stem() + ".dbf", "rb") as f:
            fields = dbf_fields(f.read(32 * 256 + 1))[3]
        return "geom binary, " + ", ".join(f"`{n}` {KIND.get(k, 'string')}" for n, k, _, _ in fields)

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.stem(), int(self.options.get("rows", 50_000)))


class ShapefileReader(DataSourceReader):
    def __init__(self, stem: str, rows: int):
        self.stem, self.rows = stem, rows

    def partitions(self) -> list[InputPartition]:
        n = (os.path.getsize(self.stem + ".shx") - 100) // 8
        return [Range(i, min(n, i + self.rows)) for i in range(0, n, self.rows)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(self.stem + ".shp", "rb") as shp, open(self.stem + ".shx", "rb") as shx, open(self.stem + ".dbf", "rb") as dbf:
            _, head, size, fields = dbf_fields(dbf.read(32 * 256 + 1))
            shx.seek(100 + 8 * partition.start)
            dbf.seek(head + size * partition.start)
            for _ in range(partition.start, partition.stop):
                offset, length = struct.unpack(">ii", shx.read(8))
                shp.seek(offset * 2 + 8)
                g, row, at, values = shape_of(shp.read(length * 2)), dbf.read(size), 1, []
                for _, kind, width, decimals in fields:
                    values.append(dbf_value(row[at : at + width], kind, decimals))
                    at += width
                if row[:1] != b"*":
                    yield (None if g is None else geo.to_wkb(g), *values)


def write_shapefile(rows: list[tuple], fields: list[tuple[str, str, int, int]], stem: str) -> None:
    """Write rows (WKB, values...) that fit one file: .shp, .shx, .dbf. fields: name, DBF type, length, decimals."""
    records = [record_of(None if r[0] is None else geo.from_wkb(bytes(r[0]))) for r in rows]
    kinds = {struct.unpack_from("<i", r)[0] for r in records} - {0}
    if len(kinds) > 1:
        raise ValueError("a shapefile holds one kind of shape")
    boxes = [b for r in rows if r[0] is not None for b in [geo.bounds(geo.from_wkb(bytes(r[0])))] if b]
    box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, next(iter(kinds), 0), *box, 0, 0, 0, 0)
    with open(stem + ".shp", "wb") as shp, open(stem + ".shx", "wb") as shx:
        shp.write(head(50 + sum(len(r) // 2 + 4 for r in records)))
        shx.write(head(50 + 4 * len(records)))
        at = 50
        for i, r in enumerate(records):
            shp.write(struct.pack(">ii", i + 1, len(r) // 2) + r)
            shx.write(struct.pack(">ii", at, len(r) // 2))
            at += len(r) // 2 + 4
    size = 1 + sum(f[2] for f in fields)
    with open(stem + ".dbf", "wb") as dbf:
        dbf.write(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), size))
        for name, kind, width, decimals in fields:
            dbf.write(name.encode("latin-1")[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, decimals]) + b"\0" * 14)
        dbf.write(b"\x0d")
        for r in rows:
            out = b" "
            for v, (_, kind, width, decimals) in zip(r[1:], fields, strict=True):
                text = "" if v is None else ("T" if v else "F") if kind == "L" else v.strftime("%Y%m%d") if kind == "D" else (f"{v:.{decimals}f}" if kind in "NF" else str(v))
                raw = text.encode()[:width]
                out += raw.rjust(width) if kind in "NF" else raw.ljust(width)
            dbf.write(out)
        dbf.write(b"\x1a")


class GeoPackageSource(DataSource):
    """Options path and table. Partitions are ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "geogpkg"

    def columns(self) -> tuple[str, list[tuple[str, str]]]:
        with sqlite3.connect(f"file:{self.options['path'].removeprefix('file://')}?mode=ro", uri=True) as db:
            (geom,) = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (self.options["table"],)).fetchone()
            cols = db.execute("select name, type from pragma_table_info(?)", (self.options["table"],)).fetchall()
        kind = lambda t: "bigint" if "INT" in t.upper() else "double" if t.upper().startswith(("REAL", "DOUBLE", "FLOAT")) else "boolean" if "BOOL" in t.upper() else "binary" if "BLOB" in t.upper() else "string"
        return geom, [(n, "binary" if n == geom else kind(t)) for n, t in cols]

    def schema(self) -> str:
        geom, cols = self.columns()
        return ", ".join(f"`{'geom' if n == geom else n}` {t}" for n, t in cols)

    def reader(self, schema) -> DataSourceReader:
        geom, cols = self.columns()
        return GeoPackageReader(self.options["path"].removeprefix("file://"), self.options["table"], [n for n, _ in cols], geom, int(self.options.get("rows", 50_000)))


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], geom: str, rows: int):
        self.path, self.table, self.cols, self.geom, self.rows = path, table, columns, geom, rows

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{self.table}"').fetchone()
        return [Range(i, min(high + 1, i + self.rows)) for i in range(low, high + 1, self.rows)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.cols)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (partition.start, partition.stop)):
                yield tuple(package_wkb(v) if c == self.geom else v for c, v in zip(self.cols, row, strict=True))


def package_wkb(blob: bytes | None) -> bytes | None:
    """WKB of a GeoPackage geometry: behind magic, version, flags, SRS id and an envelope of 0 to 8 numbers."""
    if blob is None or blob[:2] != b"GP":
        return None
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return blob[8 + envelope :]


def package_blob(wkb: bytes, srs: int = 4326) -> bytes:
    return b"GP\0\x01" + struct.pack("<i", srs) + wkb


def read_osm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables node (id, lat, lon, tags), way (id, refs, tags) and relation (id, members, tags) of an OSM XML file."""
    tag = "tag array<struct<_k: string, _v: string>>"
    schemas = {"node": f"_id bigint, _lat double, _lon double, {tag}", "way": f"_id bigint, nd array<struct<_ref: bigint>>, {tag}", "relation": f"_id bigint, member array<struct<_type: string, _ref: bigint, _role: string>>, {tag}"}
    tags = F.map_from_entries(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>"))).alias("tags")
    out = {}
    for kind, schema in schemas.items():
        rows = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)
        out[kind] = rows.select(F.col("_id").alias("id"), *{"node": [F.col("_lat").alias("lat"), F.col("_lon").alias("lon")], "way": [F.col("nd._ref").alias("refs")], "relation": [F.col("member").alias("members")]}[kind], tags)
    return out


def way_shapes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Ways with their points in order: id, tags, points (struct lat, lon), closed, missing (references without a node)."""
    refs = ways.select("id", F.posexplode("refs").alias("at", "ref"))
    found = refs.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref", "left")
    lines = found.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("lat").isNotNull(), F.struct("at", "lat", "lon")))).alias("p"), F.count_if(F.col("lat").isNull()).alias("missing"))
    points = F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    rows = lines.select("id", points.alias("points"), "missing").join(ways.select("id", "tags", "refs"), "id")
    return rows.withColumn("closed", (F.size("refs") > 3) & (F.element_at("refs", 1) == F.element_at("refs", -1))).drop("refs")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
    spark.dataSource.register(GeoPackageSource)


def feature(id_, properties: dict, shape: dict) -> str:
    return json.dumps({"type": "Feature", "id": id_, "properties": properties, "geometry": shape})
