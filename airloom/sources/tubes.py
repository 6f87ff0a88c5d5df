"""Sources: measurement tables, sampling calendars, reference monitors and the adapter from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airloom.session import TubeError, clean


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, NaN as missing; a missing one is named with what to do."""
    from pyspark.errors import AnalysisException

    try:
        return clean(spark.read.parquet(path))
    except AnalysisException as e:
        raise TubeError(f"no table at {path}; write it there as Parquet first") from e


def dt_brd(spark: SparkSession, path: str) -> DataFrame:
    """The tube measurements, if they have been written to a path as Parquet."""
    return read_table(spark, path)


def dt_calendar(spark: SparkSession, path: str | None = None, years: range = range(2015, 2027)) -> DataFrame:
    """A sampling calendar: year, month (full name), start, end. Without a path, whole months."""
    if path is not None:
        return read_table(spark, path)
    months = spark.range(12).select((F.col("id") + 1).cast("int").alias("m"))
    first = F.make_date("year", "m", F.lit(1))
    rows = spark.range(years.start, years.stop).select(F.col("id").cast("int").alias("year")).crossJoin(months)
    return rows.select("year", F.date_format(first, "MMMM").alias("month"), first.alias("start"), F.last_day(first).alias("end"))


def aurn_example(spark: SparkSession, site: tuple[float, float] = (53.75975, -1.73278), start: str = "2022-01-01", end: str = "2026-01-31", seed: int = 5) -> DataFrame:
    """Two synthetic hourly monitors: a base level, a yearly and a daily wave and noise; the second is 0.02 degrees off."""
    hours = spark.sql(f"select explode(sequence(timestamp_ntz'{start} 00:00:00', timestamp_ntz'{end} 23:00:00', interval 1 hour)) as date")
    wave = 8 * F.cos(2 * F.pi() * (F.dayofyear("date") - 15) / 365) + 6 * F.sin(2 * F.pi() * (F.hour("date") - 8) / 24)
    parts = []
    for k, (code, base) in enumerate((("SYNA", 28.0), ("SYNB", 20.0))):
        value = F.greatest(F.lit(0.5), base + wave + 4 * F.randn(seed + k))
        parts.append(hours.select("date", value.alias("no2"), F.lit(f"Synthetic {code[-1]}").alias("site"), F.lit(code).alias("code"), F.lit("synthetic").alias("source"), F.lit(site[0] + 0.02 * k).alias("latitude"), F.lit(site[1] + 0.02 * k).alias("longitude")))
    return parts[0].unionByName(parts[1])


def order_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order tables seen as tube measurements: suppliers are sites, line items measurements of a month.

    Catalyst prunes the columns and joins the small sides by broadcast where their size allows."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    line, supplier, nation = read("lineitem"), read("supplier"), read("nation")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.col("l_suppkey") % 50 != 0
    return rows.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("site"),
        F.col("s_name").alias("site_name"),
        F.col("n_name").alias("local_authority"),
        F.when(place, F.lit(53.0) + (F.col("l_suppkey") * 37 % 97) / F.lit(1000.0)).alias("latitude"),
        F.when(place, F.lit(-2.0) + (F.col("l_suppkey") * 53 % 89) / F.lit(1000.0)).alias("longitude"),
        F.year("l_shipdate").alias("year_of_measurement"),
        F.date_format("l_shipdate", "MMM").alias("month"),
        F.month("l_shipdate").alias("month_numeric"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / F.col("l_quantity")).alias("bias_adjusted_measurement"),
        F.trunc("l_shipdate", "month").alias(".start_date"),
        F.last_day(F.col("l_shipdate").cast("date")).alias(".end_date"),
    )


def order_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five monitors, one per region, each at a supplier's place; daily order totals of the region's customers."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("n_regionkey") + 1
    return rows.select(
        F.col("o_orderdate").alias("date"), (F.col("o_totalprice") / 1000).alias("no2"), F.concat(F.lit("M"), key.cast("string")).alias("code"),
        (F.lit(53.0) + (key * 37 % 97) / F.lit(1000.0)).alias("latitude"), (F.lit(-2.0) + (key * 53 % 89) / F.lit(1000.0)).alias("longitude"),
    )
