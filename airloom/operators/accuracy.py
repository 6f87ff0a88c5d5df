"""Accuracy against reference monitors: distance join, interval-average join, and a line per subset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from airloom.functions.expressions import attach, term
from airloom.functions.geo import haversine
from airloom.functions.statistics import significant, t_two_sided
from airloom.operators.deseason import near_pairs
from airloom.operators.precision import TestResult, cut_key, terms_of
from airloom.operators.tagging import tag_tube_required
from airloom.session import TubeError, c, number_text

#: Monitors that are sent to every task at most; more are joined as Spark sees fit.
MAX_SENT = 10_000
#: Columns of a monitor that its pairs get, with ``.ref`` behind their names.
MONITOR = ("source", "site", "code")
#: The tags that pairs need; the others, the costly sample number among them, are left alone.
_NEEDED = (".latitude", ".longitude", ".start_date", ".end_date")


#: Statistics of a window: what is kept of each day, how days make months and windows, and what comes of it.
WINDOW_STATS = {
    "mean": ((F.sum, F.count), (F.sum, F.sum), lambda s, n: F.try_divide(s, n)),
    "sum": ((F.sum,), (F.sum,), lambda s: s),
    "min": ((F.min,), (F.min,), lambda s: s),
    "max": ((F.max,), (F.max,), lambda s: s),
    "n": ((F.count,), (F.sum,), lambda s: s.cast("double")),
}


def range_average(windows: DataFrame, series: DataFrame, keys: list[str], values: list[str], start: str = ".start_date", end: str = ".end_date", date: str = "date", stat: str = "mean") -> DataFrame:
    """The mean (or sum, min, max or n) of each value over each distinct window, both end days included; a missing window
    or value gives NULL.

    The series is summed by day and month first. A window is its whole months, taken from monthly sums, and its
    edge days, so it costs about a row per month and no more than 60 days, joined by equality."""
    if stat not in WINDOW_STATS:
        raise TubeError(f"[range_average]> no stat {stat!r}; there are {', '.join(WINDOW_STATS)}")
    first_by, then_by, finish = WINDOW_STATS[stat]
    day = F.to_date(c(date))
    clean = {v: F.nanvl(c(v), F.lit(None)) if dict(series.dtypes)[v] in ("double", "float") else c(v) for v in values}
    at = [(k, j) for k in range(len(values)) for j in range(len(first_by))]
    daily = series.where(day.isNotNull()).groupBy(*map(c, keys), day.alias("__d")).agg(*[first_by[j](clean[values[k]]).alias(f"s{k}_{j}") for k, j in at])
    parts = [then_by[j](f"s{k}_{j}").alias(f"s{k}_{j}") for k, j in at]
    monthly = daily.groupBy(*map(c, keys), F.trunc("__d", "month").alias("__d")).agg(*parts)
    units = daily.withColumn("__u", F.lit("d")).unionByName(monthly.withColumn("__u", F.lit("m")))

    wanted = windows.select(c(start), c(end)).distinct().where(c(start).isNotNull() & c(end).isNotNull() & (c(end) >= c(start)))
    first = F.when(F.dayofmonth(c(start)) == 1, c(start)).otherwise(F.date_add(F.last_day(c(start)), 1))
    past = F.trunc(F.date_add(c(end), 1), "month")  # the month that isn't whole at the end starts here
    nothing = F.array().cast("array<date>")
    days = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(nothing)
    months = F.when(first < past, F.sequence(first, F.add_months(past, -1), F.expr("interval 1 month"))).otherwise(nothing)
    edge = F.when(first < past, F.concat(days(c(start), F.date_sub(first, 1)), days(past, c(end)))).otherwise(days(c(start), c(end)))
    as_units = lambda a, u: F.transform(a, lambda d: F.struct(d.alias("__d"), F.lit(u).alias("__u")))
    pieces = wanted.select("*", F.explode(F.concat(as_units(months, "m"), as_units(edge, "d"))).alias("__p")).select(c(start), c(end), "__p.*")
    met = pieces.join(units, ["__d", "__u"]).groupBy(*map(c, keys), c(start), c(end)).agg(*parts)
    return met.select(*map(c, keys), c(start), c(end), *[finish(*[F.col(f"s{k}_{j}") for j in range(len(first_by))]).alias(v) for k, v in enumerate(values)])


def find_near_lat_lon(df: DataFrame, lat: float, lon: float, nmax: int | None = None, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Rows with their distance in metres, nearest first; with ``nmax`` that many."""
    near = df.withColumn("distance_m", haversine(F.lit(lat), F.lit(lon), c(lat_col), c(lon_col))).orderBy("distance_m")
    return near if nmax is None else near.limit(nmax)


@dataclass
class Prepared:
    """Tubes, monitors (one row a place) and the monitors' means over the tubes' windows, ready to be paired."""

    tubes: DataFrame
    monitors: DataFrame
    means: DataFrame
    tube: str
    ref: str

    def paired(self, max_distance: float | None = None) -> DataFrame:
        """Tube rows with a monitor's distance.m, mean and columns; pairs lacking a value go. Below a distance, places
        and monitors meet in cells of the map; without one every place is paired with every monitor."""
        places = self.tubes.select(c(".latitude"), c(".longitude")).distinct().where(c(".latitude").isNotNull() & c(".longitude").isNotNull())
        if max_distance is None:
            few = self.monitors.limit(MAX_SENT + 1).count() <= MAX_SENT
            monitors = F.broadcast(self.monitors) if few else self.monitors
            pairs = places.crossJoin(monitors).withColumn("distance.m", haversine(c("__lat"), c("__lon"), c(".latitude"), c(".longitude")))
        else:
            here = self.monitors.select(F.struct("__lat", "__lon").alias("site"), F.col("__lat").alias("lat"), F.col("__lon").alias("lon"))
            there = places.select(F.struct(c(".latitude"), c(".longitude")).alias("other"), c(".latitude").alias("lat2"), c(".longitude").alias("lon2"))
            near = near_pairs(here, there, max_distance).where(F.col("distance") < max_distance)
            pairs = near.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("lat2").alias(".latitude"), F.col("lon2").alias(".longitude"), F.col("distance").alias("distance.m")).join(self.monitors, ["__lat", "__lon"])
        out = self.tubes.join(pairs, [".latitude", ".longitude"]).join(self.means, ["__lat", "__lon", ".start_date", ".end_date"])
        key = F.concat(number_text(F.col("__lat")), F.lit(" "), number_text(F.col("__lon")))
        out = out.withColumns({".tube": c(self.tube).cast("double"), ".ref": c(f"{self.ref}.ref"), ".monitor": key}).drop("__lat", "__lon")
        return out.where(c(".tube").isNotNull() & c(".ref").isNotNull())

    def measured(self) -> DataFrame:
        """The tube rows of which some pair has both values, without being paired."""
        windows = self.means.where(c(f"{self.ref}.ref").isNotNull()).select(c(".start_date"), c(".end_date")).distinct()
        placed = self.tubes.where(c(".latitude").isNotNull() & c(".longitude").isNotNull() & c(self.tube).cast("double").isNotNull())
        return placed.join(windows, [".start_date", ".end_date"], "left_semi")


def prepare_pairs(df: DataFrame, data_ref: DataFrame, tube: str = ".value", ref: str = "no2", stat: str = "mean", **options) -> Prepared:
    """Checks and sums up what ``test_tube_accuracy`` pairs."""
    d = attach(tag_tube_required(df, [*_NEEDED, tube], **options), [tube], on_error="stop<<test_tube_accuracy>>tube")
    lat, lon = options.get("ref_lat", "latitude"), options.get("ref_lon", "longitude")
    if missing := [n for n in (ref, lat, lon, "date") if n not in data_ref.columns]:
        raise TubeError(f"[test_tube_accuracy]> data_ref: missing {', '.join(missing)}")
    known = [n for n in MONITOR if n in data_ref.columns]
    series = data_ref.select(c(lat).alias("__lat"), c(lon).alias("__lon"), c("date"), c(ref), *[c(n).alias(f"{n}.ref") for n in known]).where("__lat is not null and __lon is not null")
    monitors = series.groupBy("__lat", "__lon").agg(F.count("*").alias("__n"), *[F.min(c(f"{n}.ref")).alias(f"{n}.ref") for n in known]).drop("__n")
    means = range_average(d, series, ["__lat", "__lon"], [ref], stat=stat).withColumnRenamed(ref, f"{ref}.ref")
    return Prepared(d, monitors, means, tube, ref)


def accuracy_pairs(df: DataFrame, data_ref: DataFrame, tube: str = ".value", ref: str = "no2", stat: str = "mean", max_distance: float | None = None, **options) -> DataFrame:
    """Tube rows with each monitor's distance.m and mean over the tube's period, as ``<ref>.ref``, and its source, site
    and code with ``.ref`` behind; pairs lacking either value go, and with ``max_distance`` those as far or further."""
    return prepare_pairs(df, data_ref, tube, ref, stat, **options).paired(max_distance)


def lines_by(df: DataFrame, keys: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Least squares of y on x per group: n, adj.r.squared, intercept, slope and what their p-values need.

    Groups with fewer than ``least`` pairs, or constant x, have NULL coefficients."""
    whole = df.where(c(x).isNotNull() & c(y).isNotNull())
    g = whole.groupBy(*map(c, keys)).agg(
        F.count("*").alias("n"), F.regr_slope(c(y), c(x)).alias("slope"), F.regr_intercept(c(y), c(x)).alias("intercept"), F.regr_r2(c(y), c(x)).alias("r2"),
        F.regr_sxx(c(y), c(x)).alias("sxx"), F.regr_syy(c(y), c(x)).alias("syy"), F.avg(c(x)).alias("mx"),
    )
    fitted = (F.col("n") >= least) & (F.col("sxx") > 0)
    left = F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0))
    s2 = F.try_divide(left, F.col("n") - 2)
    cols = {
        "adj.r.squared": 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2), "intercept": F.col("intercept"), "slope": F.col("slope"),
        "se.intercept": F.sqrt(s2 * (1 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx")))), "se.slope": F.sqrt(F.try_divide(s2, F.col("sxx"))),
    }
    return g.select(*map(c, keys), "n", *[F.when(fitted, v).alias(k) for k, v in cols.items()])


def with_p_values(lines: DataFrame) -> DataFrame:
    """Adds p.intercept and p.slope in arrow batches; there is one row per group."""

    @F.pandas_udf("double")
    def p(t, n):
        return t.combine(n, lambda a, b: None if a != a else t_two_sided(a, int(b) - 2))

    for k in ("intercept", "slope"):
        t = F.try_divide(c(k), c(f"se.{k}"))
        lines = lines.withColumn(f"p.{k}", F.when(c(k).isNotNull(), F.when(c(f"se.{k}") == 0, 0.0).otherwise(p(t, c("n")))))
    return lines


def test_tube_accuracy(df: DataFrame, data_ref: DataFrame, tube: str = ".value", ref: str = "no2", max_distance: float = 10.0, nearest_only: bool = False, group=None, facet=None, stat: str = "mean", show=None, **options) -> TestResult:
    """Pairs of tubes and monitors closer than ``max_distance`` metres, and a line per .cut of tube on monitor.

    data: the pairs within the distance, found in cells of the map; all: every pair, made only when it is asked for;
    lookup: a row per cut of all pairs, NULL where fewer than four pairs are near. ``stat`` is that of the monitor's
    values over a tube's period."""
    groups, facets = terms_of(group, 1, "test_tube_accuracy", "group term"), terms_of(facet, 2, "test_tube_accuracy", "facet terms")
    terms = [*groups, *facets]
    d = tag_tube_required(df, [*_NEEDED, tube, *terms], **options)
    ready = prepare_pairs(d, data_ref, tube, ref, stat, **options)
    if ready.measured().limit(1).isEmpty():
        raise TubeError("[test_tube_accuracy]> no tube and monitor pairs")

    def with_cut(rows: DataFrame) -> DataFrame:
        rows = attach(rows, terms, on_error="stop<<test_tube_accuracy>>facet")
        return rows.withColumn(".cut", cut_key(rows, terms))

    pairs, near = with_cut(ready.paired()), with_cut(ready.paired(max_distance))
    if nearest_only:
        least = near.groupBy(c(".cut")).agg(F.min(c("distance.m")).alias("__least"))
        near = near.join(least, ".cut").where(c("distance.m") == F.col("__least")).drop("__least")
    # Where the terms are the tubes' own, the cuts are those of the tubes that have a pair.
    alone = all(term(ready.tubes, t) is not None for t in terms)
    cuts = (with_cut(ready.measured()) if alone else pairs).select(c(".cut")).distinct()
    lines = cuts.join(with_p_values(lines_by(near, [".cut"], ".ref", ".tube")), ".cut", "left")
    lookup = lines.select(c(".cut"), F.coalesce("n", F.lit(0)).cast("int").alias("n"), F.lit(float(max_distance)).alias("max.distance"), *[c(k) for k in ("adj.r.squared", "intercept", "slope", "p.intercept", "p.slope")]).orderBy(c(".cut"))

    def report() -> str:
        limit = int(max_distance) if max_distance == int(max_distance) else max_distance
        out = [f"'{tube}' vs. '{ref}.ref' (dist < {limit}{'; nearest.only' if nearest_only else ''}):"]
        for r in lookup.collect():  # one row per cut
            s = significant
            out.append(f"  {r['.cut']} Insufficient data..." if r.slope is None else f"  {r['.cut']} {s(r.intercept)}\t+ {s(r.slope)}*[ref]\t(adj.r^2 {s(r['adj.r.squared'])})")
        return "\n".join(out)

    from airloom.plans.figures import accuracy_plot

    kept = {k: v for k, v in {"facet": facet, "group": group}.items() if v is not None}
    return TestResult(near, lookup, report, pairs, accuracy_plot(near, f"{ref}.ref", tube, **options, **kept)).shown(show)


test_tube_accuracy.__test__ = False
