import datetime as dt

import pytest

from airloom import TubeError, calc_tube_stat, tag_tube, tag_tube_date, tag_tube_location, tag_tube_month, tag_tube_required, tag_tube_sample_id, tag_tube_start_end, tag_tube_value, tag_tube_year
from airloom.operators.merge import r_merge
from airloom.sources.tubes import dt_calendar

D = dt.date


@pytest.fixture(scope="module")
def tubes(spark):
    rows = [
        ("a", 53.75975, -1.73278, "Jan", 2022, 10.0), ("a", 53.75975, -1.73278, "january", 2022, float("nan")), ("b", 53.8, -1.8, "DEC", 2021, 30.0),
        ("c", None, -1.8, "Feb", 2020, None), ("d", 53.9, -1.9, "nomonth", 2020, 5.0), ("e", 53.9, -1.9, "3", None, 6.0),
    ]
    return spark.createDataFrame(rows, "site string, latitude double, longitude double, month string, year_of_measurement int, bias_adjusted_measurement double")


def test_nominal_months(tubes):
    got = {(r.site, r.month): (r[".start_date"], r[".end_date"]) for r in tag_tube_start_end(tubes, method=1).collect()}
    assert got["a", "Jan"] == got["a", "january"] == (D(2022, 1, 1), D(2022, 1, 31))
    assert got["b", "DEC"] == (D(2021, 12, 1), D(2021, 12, 31))
    assert got["c", "Feb"] == (D(2020, 2, 1), D(2020, 2, 29))
    assert got["d", "nomonth"] == got["e", "3"] == (None, None)


@pytest.mark.parametrize("month", [0, 13, None, 2.5])
def test_odd_month_numbers(spark, month):
    df = spark.createDataFrame([(month, 2022), (1.0 if isinstance(month, float) else 1, 2022)], "month double, year int" if isinstance(month, float) else "month int, year int")
    assert sorted(str(r[".start_date"]) for r in tag_tube_start_end(df, method=1).collect()) == ["2022-01-01", "None"]


def test_calendar(spark, tubes):
    calendar = dt_calendar(spark, years=range(2020, 2023))
    got = tag_tube_start_end(tubes.where("length(month) = 3"), method=2, calendar=calendar)
    assert got.columns[:2] == ["year_of_measurement", "month"] and got.count() == 3
    assert got.where("site = 'a'").first()[".end_date"] == D(2022, 1, 31)


def test_explicit(spark):
    df = spark.createDataFrame([("30/03/2022", "04/05/2022"), ("bad", None)], "start_date string, end_date string")
    got = tag_tube_date(tag_tube_start_end(df, method=3, date_format="%d/%m/%Y")).collect()
    assert got[0][".date"] == D(2022, 4, 17) and got[1][".date"] is None


def test_half_even_middle(spark):
    df = spark.createDataFrame([(D(2022, 3, 30), D(2022, 5, 4)), (D(2022, 1, 5), D(2022, 2, 7))], "`.start_date` date, `.end_date` date")
    assert [r[".date"] for r in tag_tube_date(df).collect()] == [D(2022, 4, 17), D(2022, 1, 21)]
    assert tag_tube_date(df, 1).first()[".date"] == D(2022, 3, 30) and tag_tube_date(df, 3).first()[".date"] == D(2022, 5, 4)


def test_location_text(tubes):
    got = {r.site: r[".location"] for r in tag_tube_location(tubes).collect()}
    assert got["a"] == "{53.75975,-1.73278}" and got["c"] == "{NA,-1.8}"


def test_samples_are_a_partition(tubes):
    rows = tag_tube_sample_id(tubes, start_end_method=1).collect()
    place = {(r[".latitude"], r[".longitude"], r[".start_date"], r[".end_date"]): r[".sample_id"] for r in rows}
    assert len(set(place.values())) == len(place) and sorted(place.values()) == [float(k) for k in range(1, len(place) + 1)]


def test_hash_tells_missing_places_apart(spark):
    df = spark.createDataFrame([(None, 5.0), (5.0, None), (5.0, 5.0), (5.0, 5.0)], "latitude double, longitude double").selectExpr("*", "date'2020-01-01' as `.start_date`", "date'2020-01-31' as `.end_date`")
    assert len({r[".sample_id"] for r in tag_tube_sample_id(df, method=2).collect()}) == 3


def test_numbers_without_shared_exchanges(spark):
    """Every part of the plan computed on its own gives the same samples, and the same rows of replicates."""
    from airloom import test_tube_precision
    from airloom.sources.tubes import order_tubes

    from .conftest import SMALL

    def run():
        rows = order_tubes(spark, SMALL)
        samples = {(r[".latitude"], r[".longitude"], r[".start_date"], r[".sample_id"]) for r in tag_tube_sample_id(rows).collect()}
        return samples, sorted((r[".sample_id"], round(r[".y"], 6)) for r in test_tube_precision(rows).data.collect())

    wanted = run()
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        for k in old:
            spark.conf.set(k, "false")
        assert run() == wanted and len({s for *_, s in wanted[0]}) == len(wanted[0])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_tagging_twice_changes_nothing(tubes):
    once = tag_tube(tubes, start_end_method=1)
    assert tag_tube(once).columns == once.columns
    assert {r[".value"] for r in once.collect()} == {10.0, 30.0, 5.0, 6.0, None}
    with pytest.raises(TubeError):
        tag_tube_value(tubes.drop("bias_adjusted_measurement"))
    with pytest.raises(TubeError):
        tag_tube_date(once, method=4)


def test_only_required(tubes):
    got = tag_tube_required(tubes, [".value", 7, "site"])
    assert ".value" in got.columns and ".sample_id" not in got.columns


def test_factors(tubes):
    d = tag_tube_year(tag_tube_month(tag_tube(tubes, start_end_method=1)))
    assert d.schema[".month"].metadata["levels"][0] == "Jan" and len(d.schema[".month"].metadata["levels"]) == 12
    assert d.schema[".year"].metadata == {"levels": ["2020", "2021", "2022"], "ordered": True}
    assert [r[".month"] for r in calc_tube_stat(d, ".value", ".month").collect()] == [None, "Jan", "Feb", "Dec"]


def test_merge(spark):
    x = spark.createDataFrame([(None, 1), (2, 2), (10, 3)], "k int, a int")
    y = spark.createDataFrame([(10, "p"), (None, "q"), (2, "r")], "k int, b string")
    assert [tuple(r) for r in r_merge(x, y).collect()] == [(10, 3, "p"), (2, 2, "r"), (None, 1, "q")]
    z = spark.createDataFrame([(2, 9)], "k int, a int")
    assert r_merge(x, z, "k").columns == ["k", "a.x", "a.y"]


def test_odd_names(spark):
    df = spark.createDataFrame([(1.0, "x")], "`a.b (c), d``e` double, g string")
    assert calc_tube_stat(df, "a.b (c), d`e", "g").first()[1] == 1.0


def test_empty(spark, tubes):
    none = tag_tube(tubes.limit(0), start_end_method=1)
    assert none.count() == 0 and calc_tube_stat(none, ".value", "site").count() == 0
