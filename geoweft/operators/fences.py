"""Geofences over a change log, in batch: transitions, messages and proximity.

changes: seq, id, lat, lon, and last_lat, last_lon (the position before; null for a new object). fences: hook, flat, flon, fkm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import haversine_km
from .joins import SMALL, band_cells, radius_join, touched_cells

#: Order of messages of one change.
RANK = {"exit": 1, "outside": 2, "enter": 3, "inside": 4}


def with_last(positions: DataFrame) -> DataFrame:
    """Positions (id, ts, seq, lat, lon) with the one before."""
    w = Window.partitionBy("id").orderBy("ts", "seq")
    return positions.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("lat", "lon")})


def transition(before: Column, after: Column, crossed: Column | None = None) -> Column:
    """enter, exit, inside, outside, or cross where the way between two outside positions meets the fence."""
    out = F.when(before & after, "inside").when(before, "exit").when(after, "enter")
    return out.otherwise("outside") if crossed is None else out.when(crossed, "cross").otherwise("outside")


def way_meets(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column, km: Column) -> Column:
    """The straight way (on degrees) comes within km of a point."""
    dx, dy = lat2 - lat1, lon2 - lon1
    t = ((lat - lat1) * dx + (lon - lon1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))
    return haversine_km(lat, lon, lat1 + t * dx, lon1 + t * dy) <= km


def touched(changes: DataFrame, fences: DataFrame) -> DataFrame:
    """Transitions of changes that were or are inside a fence (enter, exit, inside), by a cell join for any number of fences."""
    at = ("flat", "flon")
    now = radius_join(changes, fences, "fkm", ("lat", "lon"), at).select("seq", "hook", F.lit(True).alias("now"), F.lit(False).alias("was"))
    was = radius_join(changes.where("last_lat is not null"), fences, "fkm", ("last_lat", "last_lon"), at).select("seq", "hook", F.lit(False).alias("now"), F.lit(True).alias("was"))
    both = now.unionByName(was).groupBy("seq", "hook").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    return both.select("seq", "hook", transition(F.col("was"), F.col("now")).alias("detect"))


def way_cells(step: float) -> Column:
    """Cells that the box of a change's way touches."""
    c = F.col
    low, high = F.floor(F.least("last_lat", "lat") / step).cast("int"), F.floor(F.greatest("last_lat", "lat") / step).cast("int")

    def row(band: Column) -> Column:
        n = band_cells(band, step)
        at = lambda lon: F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n).cast("int"), F.lit(0)), n - 1)
        return F.transform(F.sequence(at(F.least(c("last_lon"), c("lon"))), at(F.greatest(c("last_lon"), c("lon")))), lambda x: F.struct(band.alias("band"), x.alias("x")))

    return F.flatten(F.transform(F.sequence(low, high), row))


def passed(changes: DataFrame, fences: DataFrame, step: float = 1.0) -> DataFrame:
    """Transitions without bare outside (enter, exit, inside, cross: seq, hook, detect), by cell joins for any number of fences.

    A way that meets a fence shares a cell with it: its box holds the point nearest to the fence, which the fence's circle holds, too.
    """
    c = F.col
    ways = changes.where("last_lat is not null").withColumn("__cell", F.explode(way_cells(step)))
    near = fences.withColumn("__touched", F.explode(touched_cells(c("flat"), c("flon"), c("fkm"), step)))
    pairs = ways.join(near, (c("__cell.band") == c("__touched.band")) & (c("__cell.x") == c("__touched.x")))
    crossed = pairs.where(way_meets(c("last_lat"), c("last_lon"), c("lat"), c("lon"), c("flat"), c("flon"), c("fkm"))).select("seq", "hook").distinct()
    known = touched(changes, fences)
    return known.unionByName(crossed.join(known, ["seq", "hook"], "left_anti").withColumn("detect", F.lit("cross")))


def observed(changes: DataFrame, fences: DataFrame) -> DataFrame:
    """Transitions of every change at every fence, with outside and cross; only for a fence table of checked size."""
    n = fences.limit(SMALL + 1).count()
    if n > SMALL:
        raise ValueError(f"more than {SMALL} fences report outside positions: use touched()")
    c = F.col
    rows = changes.join(F.broadcast(fences))
    inside = lambda a, o: F.coalesce(haversine_km(a, o, "flat", "flon") <= c("fkm"), F.lit(False))
    crossed = c("last_lat").isNotNull() & way_meets(c("last_lat"), c("last_lon"), c("lat"), c("lon"), c("flat"), c("flon"), c("fkm"))
    return rows.withColumn("detect", transition(inside("last_lat", "last_lon"), inside("lat", "lon"), crossed))


def messages(detected: DataFrame, detect: list[str] | None = None) -> DataFrame:
    """Rows (.., detect) to messages: enter also says inside, exit and cross also say outside. With a DETECT list, enter falls back
    to inside, exit and cross to outside, and what is not listed is silent. `rank` orders messages of one change."""
    d = F.col("detect")
    said = F.when(d == "enter", F.array(F.lit("enter"), F.lit("inside"))).when(d.isin("exit", "cross"), F.array(d, F.lit("outside"))).otherwise(F.array(d))
    rows = detected.withColumn("message", F.explode(said))
    if detect is not None:
        rows = rows.where(F.col("message").isin(detect))
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return rows.withColumn("rank", F.coalesce(F.try_element_at(rank, F.col("message")), F.lit(0)))


def stay_in(detected: DataFrame) -> DataFrame:
    """The engine's other rule: enter and exit as usual, cross for staying inside, silent outside."""
    d = F.col("detect")
    return detected.where(d.isin("enter", "exit", "inside")).withColumn("detect", F.when(d == "inside", "cross").otherwise(d))


def groups(detected: DataFrame) -> DataFrame:
    """A number that stays the same from an enter to the next, per hook and id (detected: hook, id, seq, detect)."""
    w = Window.partitionBy("hook", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return detected.withColumn("visit", F.sum(F.col("detect").isin("enter", "cross").cast("int")).over(w))


def roam_order(found: DataFrame) -> DataFrame:
    """Messages of roaming in the order they are sent: by change, nearer first, then by id."""
    return found.orderBy("seq", F.when(F.col("kind") == "nearby", 0).otherwise(1), "meters", "oid")


def newly_near(before: Column, after: Column) -> tuple[Column, Column]:
    """Arrays of neighbour ids: those that came and those that left."""
    return F.array_except(after, before), F.array_except(before, after)


def roaming(changes: DataFrame, others: DataFrame, meters: float, nodwell: bool = False) -> DataFrame:
    """Objects (oid, olat, olon) that came near or went away by a change: seq, id, oid, kind (nearby, faraway), meters, to the millimetre.

    Distance decides, not the box around the radius. Those near before and after dwell: they are nearby again unless `nodwell`.
    """
    here = others.select("oid", "olat", "olon")
    pairs = lambda lat, lon: radius_join(changes.where(F.col(lat).isNotNull()), here, meters / 1000, (lat, lon), ("olat", "olon")).where("id <> oid")
    now = pairs("lat", "lon").select("seq", "id", "oid", F.lit(1).alias("now"), F.lit(0).alias("was"), haversine_km("lat", "lon", "olat", "olon").alias("km"))
    was = pairs("last_lat", "last_lon").select("seq", "id", "oid", F.lit(0).alias("now"), F.lit(1).alias("was"), haversine_km("lat", "lon", "olat", "olon").alias("km"))
    both = now.unionByName(was).groupBy("seq", "id", "oid").agg(F.max("now").alias("now"), F.max("was").alias("was"), F.max("km").alias("km"))
    rows = both.where("now = 0 or was = 0") if nodwell else both
    kind = F.when(F.col("now") == 1, "nearby").otherwise("faraway")
    return rows.select("seq", "id", "oid", kind.alias("kind"), (F.floor(F.col("km") * 1e6) / 1000).alias("meters"))
