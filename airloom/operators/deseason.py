"""Seasonal decomposition: a local regression on day of year and time, a task per group or place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airloom.functions.expressions import attach
from airloom.functions.geo import haversine
from airloom.operators.tagging import tag_tube_required
from airloom.session import TubeError, c, field, kind_of, na_text, null_safe_join

FITS = ("..fit", "..fit.se", "..trend", "..trend.se", "..season", "..deseason")
_HALF_TURN = 20_100_000.0  # metres: no two places are further apart


def _decompose(span: float, degree: int):
    """Fits a group's rows (i, jd, n, y, own); gives i and the six fits of its own rows."""

    def run(group):
        import numpy as np
        import pandas as pd

        from airloom.operators.loess import r_loess

        none = pd.DataFrame({"i": np.zeros(0, np.int64), **{f"f{k}": np.zeros(0) for k in range(6)}})
        if len(group) <= 2:
            return none
        x, y = group[["jd", "n"]].to_numpy(float), group["y"].to_numpy(float)
        try:
            model = r_loess(x, y, span, degree)
        except (TubeError, np.linalg.LinAlgError):
            return none
        flat = x.copy()
        flat[:, 0] = np.nanmean(x[:, 0])
        fit, fit_se = (model.scatter(part, len(y)) for part in model.predict(se=True))
        trend, trend_se = model.predict(flat, se=True)
        lacking = np.isnan(y)
        for part in (fit, fit_se, trend, trend_se):
            part[lacking] = np.nan
        trend = trend - np.nanmean(trend) + np.nanmean(fit)  # the trend at the fit's level
        season = fit - trend
        out = pd.DataFrame({"i": group["i"], **{f"f{k}": v for k, v in enumerate((fit, fit_se, trend, trend_se, season, y - season))}})
        return out[group["own"].to_numpy(bool)]

    return run


def _fitted(rows: DataFrame, groups: DataFrame, span: float, degree: int) -> DataFrame:
    """The rows with their fits; ``groups`` has g, i, jd, n, y, own: which rows each fit reads and which it is for."""
    schema = "i bigint, " + ", ".join(f"f{k} double" for k in range(6))
    # Few bytes are much work here: of so many parts none are put together, so that all cores fit.
    spark = groups.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    fits = groups.repartition(tasks, "g").groupBy("g").applyInPandas(_decompose(span, degree), schema)
    named = [F.nanvl(f"f{k}", F.lit(None)).alias(n) for k, n in enumerate(FITS)]
    return rows.join(fits.select("i", *named), "i").drop("i")


def deseason_tube_data(df: DataFrame, tube: str = ".value", by=None, method: int = 1, span: float = 0.75, degree: int = 2, max_distance: float | None = None, max_n: int | None = None, **options) -> DataFrame:
    """Means per date with ..fit, ..trend and their errors, ..season and ..deseason; groups of two rows or fewer, or too
    few to scale, go. Method 1 fits each ``by`` group, without terms all of the data as one.

    Method 2 fits each place with its neighbours: those within ``max_distance`` metres, of them the nearest ``max_n``;
    without either, with none (places at the same coordinates are one). Rows without a value have no fit. A group is
    one task: its time grows with the square of its dates, its memory with their number."""
    if method not in (1, 2):
        raise TubeError("[deseason_tube_data]> method must be 1 or 2")
    terms = [] if by is None else [by] if isinstance(by, str) else list(by)
    place = [".longitude", ".latitude", ".location"] if method == 2 else []
    keys = list(dict.fromkeys([".date", *place, *terms]))
    d = attach(tag_tube_required(df, [tube, *keys], **options), [tube, *terms], on_error="stop<<deseason_tube_data>>tube")
    means = d.groupBy(*map(c, keys)).agg(F.avg(c(tube)).alias(f"{tube}.mean"))
    epoch = F.lit("1970-01-01").cast("date")
    rows = means.withColumns({"jd": F.dayofyear(c(".date")).cast("double"), "n": F.datediff(c(".date"), epoch).cast("double"), ".y": c(f"{tube}.mean")})
    if method == 1:
        name = F.concat(*[na_text(c(t), "text" if (k := kind_of(field(d, t))) == "factor" else k) for t in terms]) if terms else F.lit("|default|")
    else:
        name = F.concat(na_text(c(".latitude"), "number"), F.lit(" "), na_text(c(".longitude"), "number"))
    # A row's number is a hash of its keys, the same wherever the row is computed again.
    number = F.xxhash64(F.array(*[F.coalesce(c(k).cast("string"), F.lit("NA")) for k in keys]))
    rows = rows.withColumns({"..id": name, "i": number})
    parts = rows.select(c("..id").alias("g"), "i", "jd", "n", c(".y").alias("y"))
    if method == 1:
        groups = parts.withColumn("own", F.lit(True))
    else:
        near = neighbours(d.withColumn("..id", F.concat(na_text(c(".latitude"), "number"), F.lit(" "), na_text(c(".longitude"), "number"))), "..id", 0.0 if max_distance is None and max_n is None else max_distance, max_n)
        groups = near.join(parts, F.col("other") == F.col("g")).select(F.col("site").alias("g"), "i", "jd", "n", "y", (F.col("site") == F.col("other")).alias("own"))
    return _fitted(rows, groups, span, degree).orderBy(c("..id"), c(".date"))


def map_cells(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    """Row and column of the cell of the map that a place lies in; cells are ``step`` degrees high and as wide at least
    at the far side of their row's neighbours, but for rows at the poles, which are one cell."""
    row = F.floor(lat / step)
    far = F.least(F.lit(90.0), (F.abs(row) + 2) * step)
    return row, F.when(far >= 89.9, F.lit(0)).otherwise(F.floor(lon * F.cos(F.radians(far)) / step))


def near_pairs(places: DataFrame, others: DataFrame, max_distance: float) -> DataFrame:
    """All pairs of a place (site, lat, lon) and another one (other, lat2, lon2) no further apart than ``max_distance``
    metres, with their distance. Only cells of the map that touch are compared, also across the date line."""
    step = max(max_distance, 1.0) / 111_000.0
    if step >= 45:  # a cell would be a good part of the globe
        met = places.crossJoin(others)
    else:
        row, _ = map_cells(F.col("lat"), F.col("lon"), step)
        one = places.withColumn("r", F.explode(F.array(row - 1, row, row + 1)))
        far = F.least(F.lit(90.0), (F.abs(F.col("r")) + 2) * step)
        column = lambda lon: F.floor(lon * F.cos(F.radians(far)) / step)
        around = F.concat(*[F.array(column(F.col("lon") + turn) - 1, column(F.col("lon") + turn), column(F.col("lon") + turn) + 1) for turn in (-360.0, 0.0, 360.0)])
        one = one.withColumn("q", F.explode(F.array_distinct(F.when(far >= 89.9, F.array(F.lit(0).cast("bigint"))).otherwise(around))))
        row2, column2 = map_cells(F.col("lat2"), F.col("lon2"), step)
        two = others.withColumns({"r": row2, "q": column2})
        met = one.join(two, ["r", "q"]).drop("r", "q")
    return met.withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("distance") <= max_distance)


def neighbours(df: DataFrame, by: str, max_distance: float | None, max_n: int | None) -> DataFrame:
    """site, other, distance: each site's nearest ones within the distance, itself among them.

    Without a distance the nearest ``max_n`` are searched in rings that double until each site has as many."""
    sites = df.groupBy(c(by).alias("site")).agg(F.first(c(".latitude"), True).alias("lat"), F.first(c(".longitude"), True).alias("lon")).where("lat is not null and lon is not null and site is not null")
    order = Window.partitionBy("site").orderBy("distance", "other")

    def within(places: DataFrame, distance: float) -> DataFrame:
        others = sites.selectExpr("site as other", "lat as lat2", "lon as lon2")
        near = near_pairs(places, others, distance).select("site", "other", "distance")
        return near if max_n is None else near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= max_n).drop("at")

    if max_distance is not None or max_n is None:
        return within(sites, _HALF_TURN if max_distance is None else max_distance)
    found, left, distance = None, sites, 1_000.0
    while True:
        near = within(left, distance)
        if distance >= _HALF_TURN:
            return near if found is None else found.unionByName(near)
        done = near.groupBy("site").agg(F.count("*").alias("k")).where(F.col("k") >= max_n).select("site")
        found = near.join(done, "site") if found is None else found.unionByName(near.join(done, "site"))
        left = left.join(done, "site", "left_anti")
        if left.isEmpty():
            return found
        distance *= 4


def with_seasons(df: DataFrame, by=".location", **options) -> DataFrame:
    """The rows with their group's and date's decomposition."""
    terms = [by] if isinstance(by, str) else list(by)
    found = deseason_tube_data(df, by=terms, **options)
    d = attach(tag_tube_required(df, [".date", *terms]), terms)
    return null_safe_join(d, found.select(*map(c, terms), c(".date"), *map(c, FITS)), [*terms, ".date"], "left")
