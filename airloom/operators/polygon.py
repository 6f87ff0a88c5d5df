"""Point in polygon by ray casting over a table of edges in bands of latitude, on distinct places only."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, functions as F

from airloom.operators.tagging import tag_tube_required
from airloom.functions.expressions import attach
from airloom.session import TubeError, c, null_safe_join
from airloom.sources.polygons import PolygonLayer, polygon_layer

#: Edges that are sent to every task at most (48 bytes each).
MAX_EDGES = 1_000_000
#: Bands that the layer's height is cut into at most.
MAX_BANDS = 4096


def containing(places: DataFrame, layer: PolygonLayer, x: str = ".longitude", y: str = ".latitude", edge: str = "outside") -> DataFrame:
    """x, y and ``id``, the first feature that the place lies in, of the distinct places that lie in one.

    On an edge is outside, as within means; with edge="ray" such a place is judged by the crossings of its ray alone, so
    that it lies in one of two polygons that share the edge.
    A place meets only the edges of its band of latitude, which hold all that a ray to the east can cross."""
    rows = layer.edge_rows()
    ys = [v for r in rows for v in (r[3], r[5])]
    low, high = min(ys), max(ys)
    step = max((high - low) / min(MAX_BANDS, max(1, len(rows) // 4)), 1e-9)
    lx, ly = c(x), c(y)
    xs = [v for r in rows for v in (r[2], r[4])]
    boxed = places.where(lx.between(min(xs), max(xs)) & ly.between(low, high)).withColumn("band", F.floor((ly - low) / step))
    edges = layer.edges(places.sparkSession)
    first, last = (F.floor((f("y1", "y2") - low) / step) for f in (F.least, F.greatest))
    edges = edges.withColumn("band", F.explode(F.sequence(first, last)))
    # An edge is crossed by the ray if its ends lie on either side of the point's latitude.
    at = (F.col("x2") - F.col("x1")) * (ly - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    crossed = ((F.col("y1") > ly) != (F.col("y2") > ly)) & (lx < at)
    level = (F.col("y1") == F.col("y2")) & (ly == F.col("y1")) & lx.between(F.least("x1", "x2"), F.greatest("x1", "x2"))
    touched = level | (ly.between(F.least("y1", "y2"), F.greatest("y1", "y2")) & (lx == at))
    spans = sum(math.floor((max(r[3], r[5]) - low) / step) - math.floor((min(r[3], r[5]) - low) / step) + 1 for r in rows)
    pairs = boxed.join(F.broadcast(edges) if spans <= MAX_EDGES else edges, "band")
    if edge == "ray":
        touched = F.lit(False)
    inside = pairs.groupBy(lx, ly, "poly", "feature").agg(F.sum(crossed.cast("int")).alias("k"), F.max(F.coalesce(touched, F.lit(False))).alias("t")).where("k % 2 = 1 and not t")
    return inside.groupBy(lx, ly).agg(F.min("feature").alias("id"))


def tube_in_xy_polygon(df: DataFrame, polygon, output="ans", rename=".in_polygon", keep_missing: bool = False, lat: str = ".latitude", lon: str = ".longitude", edge: str = "outside", **options) -> DataFrame:
    """Adds what ``output`` names, under the names of ``rename``: "ans", whether the place lies in a polygon; "id" (as
    ``<name>.id``), the first feature it lies in; or an attribute of that feature, under its own name where ``rename``
    has none for it. Rows without coordinates go, as the places are joined back, unless ``keep_missing``. ``edge`` says
    what a place on an edge is: "outside", or as its "ray" has it."""
    if edge not in ("outside", "ray"):
        raise TubeError("[tube_in_xy_polygon]> edge must be outside or ray")
    wanted, names = ([v] if isinstance(v, str) else list(v) for v in (output, rename))
    layer = polygon_layer(polygon, options.pop("x", "X"), options.pop("y", "Y"))
    own = [o for o in wanted if o not in ("ans", "id")]
    if len(names) != len(wanted):
        names += own
    if len(names) != len(wanted):
        raise TubeError("[tube_in_xy_polygon]> output and rename differ in length")
    d = attach(tag_tube_required(df, [lat, lon], **options), [lon, lat], on_error="stop<<tube_in_xy_polygon>>lat/lon")
    places = d.select(c(lon), c(lat)).distinct().where(c(lon).isNotNull() & c(lat).isNotNull())
    found = null_safe_join(places, containing(places, layer, lon, lat, edge), [lon, lat], "left")
    columns = []
    for what, name in zip(wanted, names, strict=True):
        if what == "ans":
            columns.append(F.col("id").isNotNull().alias(name))
        elif what == "id":
            columns.append(F.col("id").alias(f"{name}.id"))
        elif any(what in a for a in layer.attributes):
            known = [v for k, a in enumerate(layer.attributes, 1) if a.get(what) is not None for v in (k, str(a[what]))]
            columns.append((F.try_element_at(F.create_map(*map(F.lit, known)), "id") if known else F.lit(None).cast("string")).alias(name))
    if not columns:
        warnings.warn("[tube_in_xy_polygon]> nothing to add", stacklevel=2)
        return d
    flagged = found.select(c(lon), c(lat), *columns)
    rest = [n for n in d.columns if n in (lon, lat) or n not in names and n not in flagged.columns]
    return null_safe_join(d.select(*map(c, rest)), flagged, [lon, lat], "left" if keep_missing else "inner")
