import json
import math

import pytest

import airloom
from airloom import LeafletMap, PolygonLayer, TubeError, TubePlot, quick_text
from airloom.functions import colour, geo
from airloom.plans import catalogue
from airloom.plans.figures import Part, asked_kinds, own_args
from airloom.plans.maps import contour_lines
from airloom.sources.polygons import as_polygons, polygon_layer
from airloom.sources.tubes import aurn_example, order_monitors, order_tubes, read_table

from .conftest import SMALL


@pytest.fixture(scope="module")
def tubes(spark):
    return airloom.tag_tube(order_tubes(spark, SMALL)).cache()


def test_colours():
    assert colour.hue_palette(3) == ["#F8766D", "#00BA38", "#619CFF"] and colour.grey(0.5) == "#808080" and colour.resolve_colour("red") == "#FF0000"
    assert colour.pretty(2.3, 17.8) == [0, 5, 10, 15, 20] and colour.pretty(5, 5) == [5]


def test_ramp(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(colour.colour_ramp(df.v, 0, 1)).collect()] == ["#9E0142", "#FFFFBF", "#5E4FA2", "#808080"]


def test_mercator(spark):
    x, y = geo.to_mercator(-1.75, 53.8)
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert got.x == pytest.approx(-194809.10888822874) and got.y == pytest.approx(7132369.312295495)
    assert geo.tile_of(0.1, -0.1, 1) == (1, 1) and geo.tile_of(0, 89, 3)[1] == 0
    west, south, east, north = geo.tile_bounds(*geo.tile_of(-1.75, 53.8, 12), 12)
    assert west <= -1.75 <= east and south <= 53.8 <= north
    assert 1 <= geo.choose_zoom((-1.95, 53.75, -1.7, 53.93)) <= 19 and geo.choose_zoom((0, 0, 0.001, 0.001)) == 19


def test_labels():
    assert quick_text("NO2 [ug/m3]") == "NO<sub>2</sub> [&mu;g.m<sup>-3</sup>]" and quick_text("ws") == "wind spd." and quick_text("a", False) == "a" and quick_text(None) is None


def test_polygons(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = PolygonLayer([[[*map(tuple, square), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]], [[(3, 3), (9, 3), (9, 9), (3, 9), (3, 3)]]], [{"name": "one"}, {"name": "two"}])
    rows = [(1.5, 1.5, "hole"), (0.5, 0.5, "in"), (0.0, 2.0, "edge"), (4.0, 4.0, "corner of one, in two"), (3.5, 3.5, "both"), (20.0, 1.0, "out"), (None, 1.0, "none")]
    df = spark.createDataFrame(rows, "longitude double, latitude double, what string")
    got = {r["what"]: (r["ans"], r["n.id"], r["name"]) for r in airloom.tube_in_xy_polygon(df, hole, ["ans", "id", "name"], ["ans", "n", "name"], keep_missing=True).collect()}
    assert got["hole"][0] is False and got["in"] == (True, 1, "one") and got["edge"][0] is False and got["both"] == (True, 1, "one")
    assert got["corner of one, in two"] == (True, 2, "two") and got["out"][0] is False and got["none"][0] is None
    assert airloom.tube_in_xy_polygon(df, hole).count() == 6
    assert len(as_polygons({"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]})) == 1
    with pytest.raises(TubeError):
        polygon_layer({"type": "Point", "coordinates": [0, 0]})


def test_places_on_an_edge(spark):
    """By the ray a place on a shared edge lies in one polygon; the queries judge places as their SQL does."""
    square = lambda a: [(a, 0), (a + 4, 0), (a + 4, 4), (a, 4)]
    df = spark.createDataFrame([(4.0, 2.0)], "longitude double, latitude double")
    one, two = (airloom.tube_in_xy_polygon(df, square(a), edge="ray").first()[".in_polygon"] for a in (0, 4))
    assert (one, two) == (False, True)
    assert not airloom.tube_in_xy_polygon(df, square(4)).first()[".in_polygon"]
    keys = (598, 1082, 2214, 4784, 5793, 7)  # on the ring's edges and corners, and one off them
    df = spark.createDataFrame([(-2.0 + (k * 53 % 89) / 1000.0, 53.0 + (k * 37 % 97) / 1000.0, k) for k in keys], "longitude double, latitude double, k int")
    got = {r.k: r.ans for r in airloom.tube_in_xy_polygon(df, catalogue._RING, rename="ans", edge="ray").collect()}
    ends = list(zip(catalogue._RING, catalogue._RING[1:] + catalogue._RING[:1], strict=True))
    for x, y, k in df.collect():
        crossings = [(b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in ends if b != d]
        assert got[k] == (sum(crossings) % 2 == 1)
    assert got[1082] and got[2214]


def test_features_of_several_parts(spark, tmp_path):
    square = lambda a: [[a, 0], [a + 1, 0], [a + 1, 1], [a, 1], [a, 0]]
    parts = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "first"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(0)], [square(5)]]}},
        {"type": "Feature", "properties": {"name": "second"}, "geometry": {"type": "MultiLineString", "coordinates": [square(10)]}},
    ]}
    (tmp_path / "zone.geojson").write_text(json.dumps(parts))
    layer = airloom.caz_brd(str(tmp_path / "zone.geojson"))
    df = spark.createDataFrame([(0.5, 0.5), (0.5, 5.5), (0.5, 10.5), (0.5, 3.0)], "latitude double, longitude double")
    out = airloom.tube_in_xy_polygon(df, layer, ["id", "name"])
    assert len(layer) == 2 and {r[".longitude"]: (r[".in_polygon.id"], r["name"]) for r in out.collect()} == {0.5: (1, "first"), 5.5: (1, "first"), 10.5: (2, "second"), 3.0: (None, None)}
    plain = airloom.tube_in_xy_polygon(df, layer)
    assert ".in_polygon" in plain.columns and plain.where("`.in_polygon`").count() == 3
    with pytest.raises(TubeError):
        airloom.tube_in_xy_polygon(df, layer, ["ans", "id"], ["one"])
    with pytest.raises(TubeError):
        airloom.caz_brd(str(tmp_path / "none.geojson"))


def test_annual_options(tubes):
    both = airloom.tube_annual_cover(tubes, by="site", meta=True)
    assert both.columns == [".year", "site", ".annual.n", ".annual.pc"]
    named = airloom.tube_annual_cover(tubes, by="site", output="pc", rename="share")
    assert "share" in named.columns and ".annual.n" not in named.columns and named.count() == tubes.count()
    tested = airloom.tube_annual_test(named, "share > 50", "site", rename="whole")
    assert "whole" in tested.columns and "share > 50" not in tested.columns
    with pytest.raises(TubeError):
        airloom.tube_annual_cover(tubes, output="days")


def test_meta_figure(tubes):
    plot = airloom.test_tube_meta(tubes, ["site", "local_authority"])
    assert [la.geom for la in plot.layers] == ["GeomCol", "GeomVline"] and plot.layers[0].params == {"position": "stack"} and plot.facet_vars == ["variable"]
    one = airloom.test_tube_meta(tubes, "site", plot_type=1, palette="grey")
    assert one.layers[0].mapping["fill"] == "ref" and one.fill_palette == ["grey"] * 4 and one.data.count() == 4


def test_figure_options(tubes):
    band = airloom.tube_plot(tubes, ".value", ".date", "band", direction="by-y", colour="site")
    assert band.layers[0].mapping | {"group": None} == {"x": ".value.x.mid", "xmin": ".value.x.low", "xmax": ".value.x.hi", "y": ".date", "group": None} and band.layers[1].mapping["colour"] == "site"
    out = airloom.test_tube_precision(tubes, facet=".year", **{"line.linewidth": 2, "size": 3})
    assert out.plot.facet_vars == [".year"] and [(la.geom, la.params.get("colour"), la.params.get("linetype")) for la in out.plot.layers[1:]] == [("GeomPath", "red", "solid"), ("GeomPath", "red", "dashed"), ("GeomPath", "red", "dashed")]
    assert out.plot.layers[0].params["size"] == 3 and out.plot.layers[1].params["linewidth"] == 2 and out.plot.layers[2].mapping == {"x": ".mean", "y": ".ylow"}
    more = airloom.tube_plot(airloom.tube_plot(tubes, ".date", ".value"), ".date", ".value", "line")
    assert [la.geom for la in more.layers] == ["GeomPoint", "GeomPath"] and more.labels["x"] is None
    part = Part("GeomLine", {"alpha": 1}, held={"colour": "red"}, without=frozenset({"linetype"}))
    assert part.layer(tubes, {"colour": "blue", "linetype": 3, "alpha": 2, "shape": 1}, lambda v: False).params == {"alpha": 2, "colour": "red"}


def test_precision_report(tubes):
    out = airloom.test_tube_precision(tubes, method=2)
    report = out.report()
    assert report.startswith("'.value' (rep = 3 subset):\n  |all| mean: ") and "[%] to " in report
    assert {".n", ".mean", ".low", ".high", ".y", ".ylow", ".yhigh"} <= set(out.data.columns)
    lone = airloom.test_tube_precision(tubes, n=200)
    assert lone.report().endswith("Insufficient replicates...") and lone.lookup.first().ans is None and lone.data.count() == 0
    for bad in ({"group": ["a", "b"]}, {"facet": ["a", "b", "c"]}, {"method": 9}, {"tube": "site"}):
        with pytest.raises(TubeError):
            airloom.test_tube_precision(tubes, **bad)


def test_accuracy_report(spark, tubes):
    monitors = order_monitors(spark, SMALL)
    out = airloom.test_tube_accuracy(tubes, monitors, max_distance=10)
    assert out.report().startswith("'.value' vs. 'no2.ref' (dist < 10):") and "adj.r^2" in out.report()
    assert {"site.ref", "code.ref", "source.ref"} & set(out.data.columns) == {f"{n}.ref" for n in ("site", "code", "source") if n in monitors.columns} != set()
    by_code = airloom.test_tube_accuracy(tubes, monitors, max_distance=10, facet="code.ref", stat="max")
    means, most = ({r["distance.m"]: r[".ref"] for r in o.all.groupBy("`distance.m`").agg({"`.ref`": "max"}).withColumnRenamed("max(.ref)", ".ref").collect()} for o in (out, by_code))
    assert by_code.lookup.count() == monitors.select("code").distinct().count() and sum(most.values()) > sum(means.values())
    none = airloom.test_tube_accuracy(tubes, monitors, max_distance=0)
    assert none.lookup.first().slope is None and "Insufficient data" in none.report()
    assert out.lookup.columns == [".cut", "n", "max.distance", "adj.r.squared", "intercept", "slope", "p.intercept", "p.slope"]


def test_figures(tubes):
    plot = airloom.tube_plot(tubes.limit(50), ".date", ".value", colour="local_authority", facet=".year")
    spec = json.loads(plot.to_json())
    assert spec["layers"][0]["geom"] == "GeomPoint" and spec["layers"][0]["mapping"]["colour"] == "local_authority" and spec["facet"] == {"type": "wrap", "vars": [".year"]}
    assert spec["palette"] and len(spec["layers"][0]["data"]["data"][".value"]) == spec["layers"][0]["data"]["nrow"] == 50 and ".year" in spec["layers"][0]["data"]["columns"]
    constant = airloom.tube_plot(tubes, ".date", ".value", colour="red")
    assert constant.layers[0].params["colour"] == "red" and "colour" not in constant.layers[0].mapping
    assert [la.geom for la in airloom.tube_plot(tubes, ".date", ".value", **{"line.col": "red", "point.size": 2}).layers] == ["GeomPath", "GeomPoint"]
    assert [la.geom for la in airloom.tube_plot(tubes, ".date", ".value", "band").layers] == ["GeomRibbon", "GeomLine"]
    assert airloom.tube_time_plot(tubes, y=".value").x == ".date" and airloom.tube_plot(tubes, x=".value").y == ".index"
    assert airloom.tube_plot(tubes, ".date", ".value", "smooth").layers[0].geom == "GeomPath"
    assert asked_kinds(None, {"box.fill": 1}) == ["box"] and own_args({"point": False}, "point") is None and own_args({"point.col": "a", "col": "b"}, "point")["colour"] == "a"
    with pytest.raises(TubeError):
        airloom.tube_plot(tubes)


def test_maps(tubes):
    plot = airloom.tube_map(tubes.limit(20))
    assert isinstance(plot, TubePlot) and [la.geom for la in plot.layers] == ["GeomPoint", "GeomBlank", "GeomPoint"] and plot.to_spec()["basemap"]["provider"] == "esri"
    m = airloom.leaflet_tube_map(tubes.limit(20), color=".value")
    assert isinstance(m, LeafletMap) and [k["method"] for k in m.calls] == ["addProviderTiles", "addCircleMarkers"] and m.calls[1]["args"]["color"][0].startswith("#")
    more = airloom.leaflet_tube_map(m, "polygon", polygon=[(0, 0), (1, 0), (1, 1)])
    assert json.loads(more.to_json())["calls"][-1]["args"]["data"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    surface = airloom.leaflet_tube_map(tubes.withColumn(".value", tubes["`.value`"] / 1000), "surface", **{"grid.resolution": 12, "min.count": 6})
    assert {"addRasterImage", "addLegend"} <= {k["method"] for k in surface.calls}


def test_contours():
    xs = [0.5 * k for k in range(9)]
    z = [[math.hypot(a - 2, b - 2) for b in xs] for a in xs]
    (line,) = contour_lines(xs, xs, z, 1.2)
    assert line[0] == line[-1] and all(abs(math.hypot(a - 2, b - 2) - 1.2) < 0.1 for a, b in line)
    assert contour_lines(xs, xs, z, 99) == []


def test_sources(spark, tmp_path):
    hours = aurn_example(spark, start="2022-01-01", end="2022-01-02")
    assert hours.count() == 96 and hours.where("no2 < 0.5").count() == 0
    with pytest.raises(TubeError):
        read_table(spark, str(tmp_path / "none"))
    frame = {"rtype": "data.frame", "names": ["a", "f", "d"], "columns": [
        {"rtype": "double", "values": [1.5, "NaN", 3], "na": [3]}, {"rtype": "factor", "values": [2, 1, 2], "levels": ["x", "y"]}, {"rtype": "Date", "values": [0, 19000.5, -1]},
    ]}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(frame))
    got = airloom.read_rjson(spark, str(path))
    assert [tuple(map(str, r)) for r in got.collect()] == [("1.5", "y", "1970-01-01"), ("None", "x", "2022-01-08"), ("None", "y", "1969-12-31")]
    assert got.schema["f"].metadata["levels"] == ["x", "y"]


def test_meta_frames(spark):
    rows = [("s1", "p", 1), ("s1", None, 1), ("s1", "q", 2), ("s2", "r", 3), ("s2", "r", 3)]
    df = spark.createDataFrame(rows, "site string, a string, b int").selectExpr("*", "date'2020-01-01' as `.start_date`", "date'2020-01-31' as `.end_date`", "1.0D as latitude", "2.0D as longitude", "1.0D as measurement")
    assert [tuple(r) for r in airloom.check_tube_meta(df, "a", "site", "report").collect()] == [("s1", "3", "'p'|'q'"), ("s2", "1", "'r'")]
    fixed = airloom.repair_tube_meta(df, "a", "site", ["q"])
    assert {(r.site, r.a) for r in fixed.collect()} == {("s1", "q"), ("s2", "r")}
    suspect = airloom.repair_tube_meta(df, "a", "site", ["p", "q"])
    assert {r.a for r in suspect.collect()} == {"p.SUSPECT", "q.SUSPECT", None, "r"}
    assert airloom.extract_tube_meta(df, ["a", "b"], "site") is None
    assert {(r.site, r.a) for r in airloom.pad_tube_meta(df, "a", "site").collect()} == {("s1", "p"), ("s2", "r")}


def test_stream(spark, tmp_path):
    rows = [("k", "2024-01-01 10:00:00", 1.0), ("k", "2024-01-01 11:00:00", 3.0), ("k", "2024-01-02 01:00:00", 5.0)]
    schema = "k string, ts timestamp, v double"
    spark.createDataFrame(rows, "k string, t string, v double").selectExpr("k", "cast(t as timestamp) as ts", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", airloom.windowed_stat(stream, "v", "ts", "k"), "complete"), ("cover", airloom.running_coverage(stream, "k", "ts"), "update")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(r.v for r in spark.table("w").collect()) == [2.0, 5.0]
    assert spark.table("cover").first().days == 2
