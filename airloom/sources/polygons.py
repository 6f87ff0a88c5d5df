"""Polygon layers: read on the driver as rings, joined as a small table of edges."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from airloom.session import TubeError

Ring = list[tuple[float, float]]


@dataclass
class PolygonLayer:
    """Polygons as rings of (longitude, latitude); coordinates are WGS84. ``features`` says which feature, from 1, each
    polygon is a part of, and ``attributes`` has a dict for each feature."""

    polygons: list[list[Ring]]
    attributes: list[dict] = field(default_factory=list)
    crs: str = "WGS84"
    features: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.features = self.features or list(range(1, len(self.polygons) + 1))

    def __len__(self) -> int:
        return len(set(self.features))

    def __repr__(self) -> str:
        return f"<PolygonLayer of {len(self)} in {self.crs}>"

    def edge_rows(self) -> list[tuple]:
        """poly (1-based), feature, x1, y1, x2, y2 of every edge."""
        return [
            (k, feature, float(a[0]), float(a[1]), float(b[0]), float(b[1]))
            for k, (rings, feature) in enumerate(zip(self.polygons, self.features, strict=True), 1) for r in rings for a, b in zip(r[:-1], r[1:], strict=True) if tuple(a) != tuple(b)
        ]

    def edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edge_rows(), "poly int, feature int, x1 double, y1 double, x2 double, y2 double")

    def exteriors(self) -> list[Ring]:
        return [rings[0] for rings in self.polygons if rings]


def closed(ring) -> Ring:
    """The ring with its first point repeated at the end."""
    points = [(float(x), float(y)) for x, y, *_ in ring]
    if len(points) < 3:
        raise TubeError("a ring needs three points")
    return points if points[0] == points[-1] else [*points, points[0]]


def as_polygons(geometry: dict) -> list[list[Ring]]:
    """Polygons of a GeoJSON geometry; closed lines are cast to polygons."""
    kind, at = geometry["type"], geometry.get("coordinates")
    if kind == "Polygon":
        return [[closed(r) for r in at]]
    if kind == "MultiPolygon":
        return [[closed(r) for r in p] for p in at]
    if kind in ("LineString", "LinearRing"):
        return [[closed(at)]]
    if kind == "MultiLineString":
        return [[closed(line)] for line in at]
    if kind == "GeometryCollection":
        return [p for g in geometry["geometries"] for p in as_polygons(g)]
    raise TubeError(f"a {kind} isn't a polygon")


def read_geojson(path: str) -> PolygonLayer:
    """A layer with the features of a file, each of one or more polygons."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    features = got["features"] if got.get("type") == "FeatureCollection" else [got if got.get("type") == "Feature" else {"geometry": got, "properties": {}}]
    return _joined([PolygonLayer(found := as_polygons(feature["geometry"]), [dict(feature.get("properties") or {})], features=[1] * len(found)) for feature in features])


def caz_brd(path: str = "caz_brd.geojson") -> PolygonLayer:
    """The boundary of the clean air zone, from the file that has it (no data come with this library)."""
    if not os.path.exists(path):
        raise TubeError(f"no boundary at {path}; put its GeoJSON there first")
    return read_geojson(path)


def _joined(layers: list[PolygonLayer]) -> PolygonLayer:
    """Layers as one, their features numbered on."""
    before, polygons, attributes, features = 0, [], [], []
    for layer in layers:
        polygons += layer.polygons
        attributes += layer.attributes or [{} for _ in range(len(layer))]
        features += [before + f for f in layer.features]
        before += len(layer)
    return PolygonLayer(polygons, attributes, features=features)


def polygon_layer(polygon, x: str = "X", y: str = "Y") -> PolygonLayer:
    """A layer from itself, a path, a GeoJSON geometry, a shape that can give its geometry as GeoJSON has it
    (``__geo_interface__``), a ring of points, a frame with the columns ``x`` and ``y``, or a list of these."""
    if isinstance(polygon, PolygonLayer):
        return polygon
    if isinstance(polygon, str):
        return read_geojson(polygon)
    if hasattr(polygon, "__geo_interface__"):
        polygon = polygon.__geo_interface__
    if hasattr(polygon, "geoms") and hasattr(polygon, "names"):  # shapes with their names
        parts = [polygon_layer(g) for g in polygon.geoms]
        return _joined([PolygonLayer(p.polygons, [{"name": n}], features=[1] * len(p.polygons)) for p, n in zip(parts, polygon.names, strict=True)])
    if isinstance(polygon, dict) and not {x, y} <= set(polygon):
        if polygon.get("type") in ("Feature", "FeatureCollection"):
            return _joined([PolygonLayer(found := as_polygons(f["geometry"]), [dict(f.get("properties") or {})], features=[1] * len(found)) for f in polygon.get("features", [polygon])])
        return PolygonLayer(found := as_polygons(polygon), [{}], features=[1] * len(found))
    if isinstance(polygon, dict) or {x, y} <= set(getattr(polygon, "columns", ())):
        return PolygonLayer([[closed(zip(polygon[x], polygon[y], strict=True))]], [{}])
    if isinstance(polygon, (list, tuple)) and polygon:
        if isinstance(polygon[0], (list, tuple)) and len(polygon[0]) == 2 and isinstance(polygon[0][0], (int, float)):
            return PolygonLayer([[closed(polygon)]], [{}])
        return _joined([polygon_layer(p, x, y) for p in polygon])
    raise TubeError("not a polygon layer")
