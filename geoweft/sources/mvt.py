"""Vector tiles: features of one layer as protobuf, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import geometry as geo

EXTENT = 4096
MOVE, LINE, CLOSE = 1, 2, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def number(i: int, n: int) -> bytes:
    return varint(i << 3) + varint(n)


def commands(g: geo.Shape, box: tuple) -> tuple[int, list[int]]:
    """Geometry type and commands of a shape (longitudes and latitudes scaled to the box, y down)."""
    ps, ls, gs = geo.parts(g)
    scale = lambda p: (round((p[0] - box[0]) / (box[2] - box[0]) * EXTENT), round((box[3] - p[1]) / (box[3] - box[1]) * EXTENT))
    out, at = [], [0, 0]

    def step(p) -> list[int]:
        d = [p[0] - at[0], p[1] - at[1]]
        at[:] = p
        return [x << 1 ^ x >> 63 for x in d]

    if gs:
        for poly in gs:
            for i, ring in enumerate(poly):
                r = [scale(p) for p in (ring[:-1] if ring[0] == ring[-1] else ring)]
                r = r if (geo.ring_area(r) > 0) == (i == 0) else r[::-1]
                out += [MOVE | 1 << 3, *step(r[0]), LINE | len(r) - 1 << 3, *[v for p in r[1:] for v in step(p)], CLOSE | 1 << 3]
        return 3, out
    if ls:
        for line in ls:
            r = [scale(p) for p in line]
            out += [MOVE | 1 << 3, *step(r[0]), LINE | len(r) - 1 << 3, *[v for p in r[1:] for v in step(p)]]
        return 2, out
    if not ps:
        return 0, []
    return 1, [MOVE | len(ps) << 3, *[v for p in ps for v in step(scale(p))]]


def value_bytes(v) -> bytes:
    if isinstance(v, bool):
        return number(7, int(v))
    if isinstance(v, int):
        return number(6, (v << 1 ^ v >> 63) & (1 << 64) - 1)
    if isinstance(v, float):
        return varint(3 << 3 | 1) + struct.pack("<d", v)
    return field(1, str(v).encode())


def encode(name: str, features: list[tuple[int | None, geo.Shape, dict]], box: tuple) -> bytes:
    """A tile with one layer. features: id, shape, attributes; box: min_x, min_y, max_x, max_y."""
    keys: dict = {}
    values: dict = {}
    body = number(15, 2) + field(1, name.encode())
    for id_, shape, attributes in features:
        tags = [n for k, v in attributes.items() if v is not None for n in (keys.setdefault(k, len(keys)), values.setdefault((type(v).__name__, v), len(values)))]
        kind, cmds = commands(shape, box)
        f = (number(1, id_) if id_ is not None else b"") + field(2, b"".join(map(varint, tags))) + number(3, kind) + field(4, b"".join(varint(c & (1 << 32) - 1) for c in cmds))
        body += field(2, f)
    body += b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, value_bytes(v)) for _, v in values)
    return field(3, body + number(5, EXTENT))


def messages(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0

    def read() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = read()
        if tag & 7 == 0:
            yield tag >> 3, read()
        elif tag & 7 == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif tag & 7 == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            n = read()
            yield tag >> 3, data[at : at + n]
            at += n


def numbers(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def decode(data: bytes) -> dict[str, list[tuple[int | None, str, list, dict]]]:
    """Layers by name: features with id, kind, parts in tile units, attributes."""
    sign = lambda n: n >> 1 ^ -(n & 1)
    out = {}
    for tag, layer in messages(data):
        if tag != 3:
            continue
        name, keys, values, raw = "", [], [], []
        for t, v in messages(layer):
            if t == 1:
                name = v.decode()
            elif t == 2:
                raw.append(v)
            elif t == 3:
                keys.append(v.decode())
            elif t == 4:
                k, x = next(messages(v))
                values.append(x.decode() if k == 1 else bool(x) if k == 7 else sign(x) if k == 6 else x)
        rows = []
        for f in raw:
            got = dict(messages(f))
            tags, cmds, at, parts, i = numbers(got.get(2, b"")), numbers(got.get(4, b"")), [0, 0], [], 0
            while i < len(cmds):
                op, n = cmds[i] & 7, cmds[i] >> 3
                i += 1
                for _ in range(n if op != CLOSE else 0):
                    at = [at[0] + sign(cmds[i]), at[1] + sign(cmds[i + 1])]
                    i += 2
                    parts.append([at]) if op == MOVE else parts[-1].append(at)
            rows.append((got.get(1), ["", "Point", "LineString", "Polygon"][got.get(3, 0)], parts, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}))
        out[name] = rows
    return out


def tiles(rows: DataFrame, layer: str, columns: list[str]) -> DataFrame:
    """One tile (z, x, y, mvt) for each group of rows with z, x, y, id, geom (WKB) and attribute columns."""
    from ..plans.areas import tile_bounds

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(pdf[c].iloc[0]) for c in "zxy")
        b = tile_bounds(x, y, z)
        feats = [(int(r["id"]), geo.from_wkb(bytes(r["geom"])), {c: (v.item() if hasattr(v := r[c], "item") else v) for c in columns}) for _, r in pdf.sort_values("id").iterrows()]
        return pd.DataFrame({"z": [z], "x": [x], "y": [y], "mvt": [encode(layer, feats, (b[1], b[0], b[3], b[2]))]})

    return rows.select("z", "x", "y", "id", "geom", *columns).groupBy("z", "x", "y").applyInPandas(build, "z int, x int, y int, mvt binary")
