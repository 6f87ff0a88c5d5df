"""Overviews of a tagged table: the whole set, each sample, and the places by distance from the centre."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airloom.functions.geo import haversine
from airloom.functions.statistics import band_labels, cut
from airloom.operators.aggregate import factor_row
from airloom.operators.tagging import tag_tube
from airloom.session import as_factor, c

#: The distance bands in metres.
DISTANCE_BREAKS = (0.0, 1.0, 10.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e7)
_MISSING = (("missing.latitudes", ".latitude"), ("missing.longitudes", ".longitude"), ("missing.start.dates", ".start_date"), ("missing.end.dates", ".end_date"))


def _distinct_whole(*parts):
    """Distinct combinations; one with a missing part counts as missing, and all missing ones as one more."""
    some_missing = F.lit(False)
    for p in parts:
        some_missing = some_missing | p.isNull()
    return F.count_distinct(*parts) + F.coalesce(F.max(F.when(some_missing, 1).otherwise(0)), F.lit(0))


def tube_summary(df: DataFrame, **options) -> DataFrame:
    """One row: sampling.from, sampling.to, and numbers of rows, samples, intervals, locations and samples with missing tags."""
    d = tag_tube(df, **options)
    missing = F.lit(False)
    for _, name in _MISSING:
        missing = missing | c(name).isNull()
    return d.agg(
        F.min(c(".start_date")).alias("sampling.from"), F.max(c(".end_date")).alias("sampling.to"), F.count("*").alias("n.total"), F.count_distinct(c(".sample_id")).alias("n.samples"),
        _distinct_whole(c(".start_date"), c(".end_date")).alias("n.intervals"), _distinct_whole(c(".latitude"), c(".longitude")).alias("n.locations"),
        F.count_distinct(F.when(missing, c(".sample_id"))).alias("n.bad.tags"),
    )


def tube_summary_sample(df: DataFrame, output: str | None = None, **options) -> DataFrame:
    """For each sample its rows and missing tags; without output="report" how many samples have how many rows."""
    d = tag_tube(df, **options)
    counts = [F.sum(c(name).isNull().cast("int")).alias(label) for label, name in _MISSING]
    out = d.groupBy(c(".sample_id")).agg(F.count("*").alias("n"), *counts)
    total = c(_MISSING[0][0])
    for label, _ in _MISSING[1:]:
        total = total + c(label)
    out = out.withColumn("checksum", total).orderBy(c(".sample_id"))
    if output in ("report", "full.report"):
        return out
    sizes = out.groupBy("n").agg(F.count("*").alias("samples")).orderBy("n").collect()  # one row per set size
    levels = [str(r.n) for r in sizes]
    return factor_row(out.select(as_factor(F.col("n").cast("string"), "n", levels)), "n")


def tube_summary_lat_lon(df: DataFrame, output: str | None = None, **options) -> DataFrame:
    """Places and their distance from the median place, furthest first; without output="report" counts by band."""
    d = tag_tube(df, **options)
    places = d.groupBy(c(".latitude"), c(".longitude")).agg(F.min(c(".sample_id")).alias(".sample_id")).where("`.latitude` is not null and `.longitude` is not null")
    centre = places.agg(F.median(c(".latitude")).alias("__lat"), F.median(c(".longitude")).alias("__lon"))
    far = places.crossJoin(F.broadcast(centre)).withColumn("distance.m", haversine(F.col("__lat"), F.col("__lon"), c(".latitude"), c(".longitude")))
    out = far.select(c(".sample_id"), c(".latitude"), c(".longitude"), c("distance.m")).orderBy(c("distance.m").desc(), c(".sample_id"))
    if output in ("report", "full.report"):
        return out
    from airloom.operators.aggregate import factor_counts

    band = as_factor(cut(c("distance.m"), list(DISTANCE_BREAKS)), "band", band_labels(list(DISTANCE_BREAKS)))
    return factor_counts(out.select(band), "band")
