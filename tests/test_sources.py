import datetime
import json
import sqlite3

from geoweft.functions import geometry as geo
from geoweft.sources import stac, vector

P = {"type": "Point", "coordinates": [1.5, 2.5]}
POLY = {"type": "Polygon", "coordinates": [[[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(vector.feature("x", {"n": 1}, P)), json.loads(vector.feature("y", {}, POLY))]}))
    rows = vector.read_geojson(spark, str(tmp_path / "a.json"))
    got = {r["id"]: geo.from_wkb(bytes(r["geom"])) for r in rows.collect()}
    assert got["x"] == P and geo.area(got["y"]) == 96
    vector.write_geojson(rows, str(tmp_path / "out"))
    again = {r["id"]: (json.loads(r["properties"]), geo.from_wkb(bytes(r["geom"]))) for r in vector.read_geojson(spark, str(tmp_path / "out")).collect()}
    assert again["x"] == ({"n": 1}, P) and geo.area(again["y"][1]) == 96


def test_shapefile(spark, tmp_path):
    vector.register(spark)
    rows = [(geo.to_wkb(POLY), "a", 1.25, True, datetime.date(2020, 2, 3)), (None, "é", None, None, None), (geo.to_wkb(geo.rectangle(1, 1, 2, 2)), "c", -7.0, False, None)]
    vector.write_shapefile(rows, [("name", "C", 12, 0), ("v", "N", 10, 2), ("ok", "L", 1, 0), ("day", "D", 8, 0)], str(tmp_path / "s"))
    df = spark.read.format("geoshp").option("path", str(tmp_path / "s.shp")).option("rows", 2).load()
    got = {r["name"]: r for r in df.collect()}
    assert geo.area(geo.from_wkb(bytes(got["a"]["geom"]))) == 96 and got["a"]["v"] == 1.25 and got["a"]["day"] == datetime.date(2020, 2, 3)
    assert got["é"]["geom"] is None and got["é"]["v"] is None and got["c"]["ok"] is False and df.rdd.getNumPartitions() == 2


def test_geopackage(spark, tmp_path):
    vector.register(spark)
    path = str(tmp_path / "g.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('places', 'shape')")
        db.execute("create table places (fid integer primary key, name text, height double, shape blob)")
        db.executemany("insert into places values (?, ?, ?, ?)", [(i, f"p{i}", i / 2, vector.package_blob(geo.to_wkb({"type": "Point", "coordinates": [i, -i]}))) for i in range(1, 6)])
    df = spark.read.format("geogpkg").option("path", path).option("table", "places").option("rows", 2).load()
    assert {r["name"]: geo.from_wkb(bytes(r["geom"]))["coordinates"] for r in df.collect()} == {f"p{i}": [float(i), float(-i)] for i in range(1, 6)}


def test_osm(spark, tmp_path):
    (tmp_path / "o.osm").write_text("""<osm><node id="1" lat="1" lon="2"><tag k="amenity" v="cafe"/></node><node id="2" lat="1" lon="3"/><node id="3" lat="2" lon="3"/>
<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way><way id="8"><nd ref="2"/><nd ref="99"/></way><relation id="9"><member type="way" ref="7" role="outer"/></relation></osm>""")
    t = vector.read_osm(spark, str(tmp_path / "o.osm"))
    ways = {r["id"]: r for r in vector.way_shapes(t["node"], t["way"]).collect()}
    assert ways[7]["closed"] and [(p["lat"], p["lon"]) for p in ways[7]["points"]] == [(1, 2), (1, 3), (2, 3), (1, 2)] and ways[8]["missing"] == 1 and not ways[8]["closed"]
    assert t["node"].where("id = 1").first()["tags"] == {"amenity": "cafe"} and t["relation"].first()["members"][0]["_ref"] == 7


def test_stac(spark, tmp_path):
    item = {"type": "Feature", "stac_version": "1.0.0", "id": "i1", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2021-01-02T03:04:05Z"}, "links": [{"rel": "self", "href": "./i1.json"}], "assets": {"a": {"href": "a.tif", "type": "image/tiff"}}, "stac_extensions": ["eo"]}
    (tmp_path / "i1.json").write_text(json.dumps(item))
    (tmp_path / "c.json").write_text(json.dumps({"type": "Collection", "stac_version": "1.0.0", "id": "c1"}))
    flat = stac.flat(stac.read_stac(spark, str(tmp_path / "*.json")))
    rows = {r["id"]: r for r in flat.select("id", "type", "bbox", stac.link(flat["links"], "self").alias("self")).collect()}
    assert rows["i1"]["type"] == "item" and rows["i1"]["bbox"] == [1, 2, 3, 4] and rows["i1"]["self"]["href"] == "./i1.json" and rows["c1"]["type"] == "collection"
    n = {(r["kind"], r["type"], r["name"]): r["n"] for r in stac.statistics(flat).collect()}
    assert n["asset", "item", "image/tiff"] == 1 and n["version", "collection", "1.0.0"] == 1
    assert {r["id"]: r["missing"] for r in stac.problems(flat).collect()} == {"c1": ["links"]}
