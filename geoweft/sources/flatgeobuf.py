"""FlatGeobuf files: a Python data source ("geofgb") and a writer.

The file's packed R-tree gives feature offsets, so partitions are ranges of features, and a box option reads only features whose boxes meet it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as geo

#: Fixed values of the format: magic bytes, geometry types 1 to 7, column types in their order.
MAGIC = b"fgb\x03fgb\x00"
COLUMNS = ["byte", "ubyte", "bool", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "string", "json", "datetime", "binary"]
PACK = {"byte": "b", "ubyte": "B", "bool": "?", "short": "h", "ushort": "H", "int": "i", "uint": "I", "long": "q", "ulong": "Q", "float": "f", "double": "d"}
SPARK = {"byte": "tinyint", "ubyte": "smallint", "bool": "boolean", "short": "smallint", "ushort": "int", "int": "int", "uint": "bigint", "long": "bigint", "ulong": "decimal(20,0)", "float": "float", "double": "double", "string": "string", "json": "string", "datetime": "string", "binary": "binary"}
NODE = 16


class Table:
    """A table of a flat buffer: fields by number."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    def place(self, field: int) -> int:
        slot = 4 + 2 * field
        offset = struct.unpack_from("<H", self.data, self.vtable + slot)[0] if slot < self.size else 0
        return self.at + offset if offset else 0

    def scalar(self, field: int, kind: str, default=0):
        at = self.place(field)
        return struct.unpack_from("<" + kind, self.data, at)[0] if at else default

    def follow(self, field: int) -> int:
        at = self.place(field)
        return at + struct.unpack_from("<I", self.data, at)[0] if at else 0

    def vector(self, field: int, kind: str) -> tuple:
        at = self.follow(field)
        return struct.unpack_from(f"<{struct.unpack_from('<I', self.data, at)[0]}{kind}", self.data, at + 4) if at else ()

    def raw(self, field: int) -> bytes:
        at = self.follow(field)
        return self.data[at + 4 : at + 4 + struct.unpack_from("<I", self.data, at)[0]] if at else b""

    def table(self, field: int) -> Table | None:
        at = self.follow(field)
        return Table(self.data, at) if at else None

    def tables(self, field: int) -> list[Table]:
        at = self.follow(field)
        n = struct.unpack_from("<I", self.data, at)[0] if at else 0
        return [Table(self.data, at + 4 + 4 * i + struct.unpack_from("<I", self.data, at + 4 + 4 * i)[0]) for i in range(n)]


def root(data: bytes) -> Table:
    return Table(data, struct.unpack_from("<I", data)[0])


class Ref:
    """A child that a table or vector points to."""

    def __init__(self, kind: str, value):
        self.kind, self.value = kind, value


def built(fields: dict[int, tuple[str, object]]) -> bytes:
    """A flat buffer of one root table, size first. fields: number to (struct code, scalar) or ('ref', Ref)."""
    out = bytearray(8)

    def align(n: int, shift: int = 0) -> None:
        while (len(out) + shift) % n:
            out.append(0)

    def table(fields: dict) -> int:
        fields = {k: v for k, v in fields.items() if v[1] is not None}
        count = max(fields, default=-1) + 1
        align(8)
        vtable = len(out)
        out.extend(b"\0" * (4 + 2 * count))
        align(8)
        at = len(out)
        out.extend(struct.pack("<i", at - vtable) + b"\0" * 4)
        places = {}
        for k, (code, value) in sorted(fields.items()):
            n = 4 if code == "ref" else struct.calcsize(code)
            align(n)
            places[k] = len(out)
            out.extend(b"\0" * 4 if code == "ref" else struct.pack("<" + code, value))
        struct.pack_into("<HH", out, vtable, 4 + 2 * count, len(out) - at)
        for k, p in places.items():
            struct.pack_into("<H", out, vtable + 4 + 2 * k, p - at)
        for k, p in places.items():
            if fields[k][0] == "ref":
                child = write(fields[k][1])
                struct.pack_into("<I", out, p, child - p)
        return at

    def write(ref: Ref) -> int:
        if ref.kind == "table":
            return table(ref.value)
        if ref.kind == "tables":
            align(4)
            at = len(out)
            out.extend(struct.pack("<I", len(ref.value)) + b"\0" * (4 * len(ref.value)))
            for i, f in enumerate(ref.value):
                child = table(f)
                struct.pack_into("<I", out, at + 4 + 4 * i, child - (at + 4 + 4 * i))
            return at
        if ref.kind == "text":
            align(4)
            at = len(out)
            raw = ref.value.encode()
            out.extend(struct.pack("<I", len(raw)) + raw + b"\0")
            return at
        size = struct.calcsize(ref.kind)
        align(max(4, size), 4)
        align(4)
        at = len(out)
        out.extend(struct.pack(f"<I{len(ref.value)}{ref.kind}", len(ref.value), *ref.value) if size <= 4 else struct.pack("<I", len(ref.value)) + struct.pack(f"<{len(ref.value)}{ref.kind}", *ref.value))
        return at

    struct.pack_into("<I", out, 4, table(fields) - 4)
    align(8, 4)
    struct.pack_into("<I", out, 0, len(out) - 4)
    return bytes(out)


def geometry_fields(g: geo.Shape) -> dict:
    kind, c = g["type"], g.get("coordinates")
    code = geo.KINDS.index(kind) + 1
    if kind in ("MultiPolygon", "GeometryCollection"):
        members = g["geometries"] if kind == "GeometryCollection" else [{"type": "Polygon", "coordinates": p} for p in c]
        return {6: ("B", code), 7: ("ref", Ref("tables", [geometry_fields(m) for m in members]))}
    rings = {"Point": lambda: [[c]], "MultiPoint": lambda: [c], "LineString": lambda: [c], "MultiLineString": lambda: c, "Polygon": lambda: c}[kind]()
    ends, n = [], 0
    for r in rings:
        n += len(r)
        ends.append(n)
    xy = [float(v) for r in rings for p in r for v in p[:2]]
    return {0: ("ref", Ref("I", ends) if len(rings) > 1 else None), 1: ("ref", Ref("d", xy)), 6: ("B", code)}


def shape_of(t: Table, kind: int) -> geo.Shape:
    kind = t.scalar(6, "B") or kind
    name = geo.KINDS[kind - 1]
    if kind in (6, 7):
        members = [shape_of(p, 3 if kind == 6 else 0) for p in t.tables(7)]
        return {"type": name, "geometries": members} if kind == 7 else {"type": name, "coordinates": [m["coordinates"] for m in members]}
    xy, ends = t.vector(1, "d"), t.vector(0, "I")
    points = [list(xy[i : i + 2]) for i in range(0, len(xy), 2)]
    rings = [points[a:b] for a, b in zip((0, *ends), ends, strict=False)] if ends else [points]
    c = {1: lambda: points[0], 2: lambda: points, 4: lambda: points, 3: lambda: rings, 5: lambda: rings}[kind]()
    return {"type": name, "coordinates": c}


def properties(raw: bytes, columns: list[tuple[str, str]]) -> list:
    out, at = [None] * len(columns), 0
    while at + 2 <= len(raw):
        (i,) = struct.unpack_from("<H", raw, at)
        kind, at = columns[i][1], at + 2
        if kind in PACK:
            (out[i],) = struct.unpack_from("<" + PACK[kind], raw, at)
            at += struct.calcsize(PACK[kind])
        else:
            (n,) = struct.unpack_from("<I", raw, at)
            body = raw[at + 4 : at + 4 + n]
            out[i], at = body if kind == "binary" else body.decode(), at + 4 + n
    return out


def property_bytes(values: list, columns: list[tuple[str, str]]) -> bytes:
    out = b""
    for i, (v, (_, kind)) in enumerate(zip(values, columns, strict=True)):
        if v is None:
            continue
        body = v if kind == "binary" else b"" if kind in PACK else str(v).encode()
        out += struct.pack("<H", i) + (struct.pack("<" + PACK[kind], v) if kind in PACK else struct.pack("<I", len(body)) + body)
    return out


def hilbert(x: int, y: int) -> int:
    d, s = 0, 1 << 15
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * (3 * rx ^ ry)
        if not ry:
            x, y = (s - 1 - y, s - 1 - x) if rx else (y, x)
            x, y = x & 65535, y & 65535
        s >>= 1
    return d


def level_sizes(n: int, node: int) -> list[int]:
    """Nodes by level, leaves first; even a single leaf has a root above it."""
    out = [n]
    while len(out) < 2 or out[-1] > 1:
        out.append(math.ceil(out[-1] / node))
    return out


def write(path: str, rows: list[tuple], columns: list[tuple[str, str]], name: str = "layer", node: int = NODE) -> None:
    """Write rows (WKB, values..) that fit one file, Hilbert-sorted, with an index. columns: name and one of COLUMNS."""
    shapes = [(geo.from_wkb(bytes(r[0])), r[1:]) for r in rows]
    boxes = [geo.bounds(g) or (0.0, 0.0, 0.0, 0.0) for g, _ in shapes]
    world = [f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max))] if boxes else [0.0] * 4
    at = lambda b, i: int(((b[i] + b[i + 2]) / 2 - world[i]) / ((world[i + 2] - world[i]) or 1) * 65535)
    order = sorted(range(len(shapes)), key=lambda k: hilbert(at(boxes[k], 0), at(boxes[k], 1)))
    kinds = {geo.KINDS.index(g["type"]) + 1 for g, _ in shapes}
    bodies, offsets, total = [], [], 0
    for k in order:
        g, values = shapes[k]
        raw = property_bytes(list(values), columns)
        body = built({0: ("ref", Ref("table", geometry_fields(g))), 1: ("ref", Ref("B", raw) if raw else None)})
        offsets.append(total)
        bodies.append(body)
        total += len(body)
    head = built({0: ("ref", Ref("text", name)), 1: ("ref", Ref("d", world)), 2: ("B", kinds.pop() if len(kinds) == 1 else 0), 7: ("ref", Ref("tables", [{0: ("ref", Ref("text", n)), 1: ("B", COLUMNS.index(t))} for n, t in columns])), 8: ("Q", len(rows)), 9: ("H", node if rows else 0)})
    with open(path, "wb") as f:
        f.write(MAGIC + head)
        if rows and node:
            sizes = level_sizes(len(rows), node)
            starts = [sum(sizes[i + 1 :]) for i in range(len(sizes))]  # the root comes first
            level = [(*boxes[k], o) for k, o in zip(order, offsets, strict=True)]
            levels = [level]
            for i in range(1, len(sizes)):
                below = levels[-1]
                levels.append([(*[g(b[j] for b in below[k : k + node]) for j, g in enumerate((min, min, max, max))], starts[i - 1] + k) for k in range(0, len(below), node)])
            for level in reversed(levels):
                f.write(b"".join(struct.pack("<4dQ", *n) for n in level))
        f.write(b"".join(bodies))


class File:
    """An open file's header and index."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            if f.read(8)[:4] != MAGIC[:4]:
                raise ValueError("not a FlatGeobuf file")
            (n,) = struct.unpack("<I", f.read(4))
            t = root(f.read(n))
        self.kind, self.count, self.node = t.scalar(2, "B"), t.scalar(8, "Q"), t.scalar(9, "H", NODE)
        self.columns = [(c.raw(0).decode(), COLUMNS[c.scalar(1, "B")]) for c in t.tables(7)]
        self.index = 12 + n
        self.sizes = level_sizes(self.count, self.node) if self.node and self.count else []
        self.data = self.index + 40 * sum(self.sizes)

    def offsets(self, f, box: tuple | None) -> list[int]:
        """Feature offsets, of those that meet the box: levels are searched from the root down, reading only nodes that meet it."""
        if not self.sizes:
            return []
        starts = [sum(self.sizes[i + 1 :]) for i in range(len(self.sizes))]
        level = len(self.sizes) - 1
        nodes = [0]
        while True:
            hit = []
            for first in nodes:
                last = min(first + (self.node if level < len(self.sizes) - 1 else 1), starts[level] + self.sizes[level])
                f.seek(self.index + 40 * first)
                for a, b, c, d, o in struct.iter_unpack("<4dQ", f.read(40 * (last - first))):
                    if box is None or a <= box[2] and c >= box[0] and b <= box[3] and d >= box[1]:
                        hit.append(o)
            if level == 0:
                return hit
            nodes, level = hit, level - 1


class Features(InputPartition):
    def __init__(self, offsets: list[int] | None):
        self.offsets = offsets


class FlatGeobufSource(DataSource):
    """Options path, rows (features a partition), bbox (min_x,min_y,max_x,max_y)."""

    @classmethod
    def name(cls) -> str:
        return "geofgb"

    def schema(self) -> str:
        return "geom binary" + "".join(f", `{n}` {SPARK[t]}" for n, t in File(self.options["path"].removeprefix("file://")).columns)

    def reader(self, schema) -> DataSourceReader:
        box = self.options.get("bbox")
        return FlatGeobufReader(self.options["path"].removeprefix("file://"), int(self.options.get("rows", 20_000)), tuple(map(float, box.split(","))) if box else None)


class FlatGeobufReader(DataSourceReader):
    def __init__(self, path: str, rows: int, box: tuple | None):
        self.path, self.rows, self.box = path, rows, box

    def partitions(self) -> list[InputPartition]:
        file = File(self.path)
        if not file.sizes:
            return [Features(None)]
        with open(self.path, "rb") as f:
            at = file.offsets(f, self.box)
        return [Features(at[i : i + self.rows]) for i in range(0, len(at), self.rows)] or [Features([])]

    def read(self, partition: Features) -> Iterator[tuple]:
        file = File(self.path)
        with open(self.path, "rb") as f:
            f.seek(file.data)
            for o in partition.offsets if partition.offsets is not None else iter(f.tell, None):
                if partition.offsets is not None:
                    f.seek(file.data + o)
                size = f.read(4)
                if len(size) < 4:
                    return
                t = root(f.read(struct.unpack("<I", size)[0]))
                g = t.table(0)
                shape = shape_of(g, file.kind) if g else None
                if shape and partition.offsets is None and self.box:
                    b = geo.bounds(shape)
                    if not b or b[0] > self.box[2] or b[2] < self.box[0] or b[1] > self.box[3] or b[3] < self.box[1]:
                        continue
                yield (geo.to_wkb(shape) if shape else None, *properties(t.raw(1), file.columns))


def register(spark) -> None:
    spark.dataSource.register(FlatGeobufSource)
