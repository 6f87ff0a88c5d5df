"""Tagging: the common columns that every later query reads.

``.start_date .end_date .latitude .longitude .sample_id .value`` and, on request, ``.date .month .year .location``.
What a tagger does is decided from the schema, on the driver; the data is read only where a choice depends on it. A
tag that is there already stays, unless ``force``. Options may come as ``<prefix>_force`` and ``<prefix>_method``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airloom.functions.expressions import term
from airloom.session import TubeError, as_factor, c, kind_of, field, na_text, null_safe_join, number_text

#: English month names, as they stand in the data and in the labels.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_LABELS = tuple(m[:3] for m in MONTHS)
VALUE_TERMS = ("bias_adjusted_measurement", "measurement")
_SAMPLE = (".latitude", ".longitude", ".start_date", ".end_date")


def _settings(prefix: str, method, force: bool, options: dict) -> tuple[object, bool]:
    return options.get(f"{prefix}_method", method), bool(options.get(f"{prefix}_force", force))


def _methods(method, known: int, who: str) -> list[int]:
    wanted = list(range(1, known + 1)) if method is None else [method] if isinstance(method, int) else list(method)
    if bad := [m for m in wanted if m not in range(1, known + 1)]:
        raise TubeError(f"[{who}]> no method {bad[0]!r}; there are 1 to {known}")
    return wanted


def _named(df: DataFrame, options: dict, **defaults: str) -> dict[str, str]:
    """Column names by role, overridden by options; fails listing those that are missing."""
    names = {role: options.get(role, default) for role, default in defaults.items()}
    missing = [n for n in names.values() if n not in df.columns]
    if missing:
        raise TubeError(f"missing: {', '.join(missing)}")
    return names


def month_number(x: Column, kind: str) -> Column:
    """1 to 12 from a number, a name or an abbreviation in any case; NULL for anything else."""
    if kind == "number":
        n = x.cast("double")
        return F.when((n >= 1) & (n <= 12) & (n == F.floor(n)), n.cast("int"))
    text = F.lower(F.trim(x.cast("string")))
    names = F.create_map(*[F.lit(v) for k, m in enumerate(MONTHS, 1) for v in (m.lower(), k)], *[F.lit(v) for k, m in enumerate(MONTHS, 1) if len(m) > 3 for v in (m[:3].lower(), k)])
    number = text.try_cast("int")
    return F.coalesce(F.try_element_at(names, text), F.when(number.between(1, 12), number))


def tag_tube_start_end(df: DataFrame, method=None, force: bool = False, **options) -> DataFrame:
    """``.start_date`` and ``.end_date``: 1 from month and year, 2 from a calendar, 3 from date columns.

    Without a method they are tried in that order and the first that the columns allow is taken."""
    method, force = _settings("start_end", method, force, options)
    if not force and {".start_date", ".end_date"} <= set(df.columns):
        return df
    reasons = []
    for m in _methods(method, 3, "tag_tube_start_end"):
        try:
            return (_nominal, _calendar, _explicit)[m - 1](df.drop(".start_date", ".end_date"), options | {"__chosen": method is not None})
        except TubeError as e:
            reasons.append(f"{m}: {e}")
    raise TubeError(f"[tag_tube_start_end]> no method fits ({'; '.join(reasons)})")


def _nominal(df: DataFrame, options: dict) -> DataFrame:
    year_name = options.get("year", "year_of_measurement" if "year_of_measurement" in df.columns else "year")
    names = _named(df, {**options, "year": year_name}, month="month", year="year")
    month = month_number(c(names["month"]), kind_of(field(df, names["month"])))
    # Only where the method is open do the data decide; a month column of a type that can't hold one decides by itself.
    if not options["__chosen"] and df.where(month.isNotNull()).limit(1).isEmpty() and not df.limit(1).isEmpty():
        raise TubeError("no month can be read")
    year = c(names["year"]).cast("string").try_cast("double").cast("int")
    first = F.when(month.isNotNull() & year.between(1, 9999), F.make_date(year, month, F.lit(1)))
    return df.withColumns({".start_date": first, ".end_date": F.last_day(first)})


def _calendar(df: DataFrame, options: dict) -> DataFrame:
    calendar = options.get("calendar")
    if calendar is None:
        raise TubeError("no calendar")
    names = _named(df, options, month="month", year="year_of_measurement" if "year_of_measurement" in df.columns else "year")
    month, year = names["month"], names["year"]
    if kind_of(field(df, month)) == "number":
        raise TubeError("the month isn't an abbreviation")
    periods = calendar.select(F.col("year").cast("double").alias("__year"), F.substring(F.col("month"), 1, 3).alias("__month"), F.to_date("start").alias(".start_date"), F.to_date("end").alias(".end_date"))
    rows = df.withColumn("__year", c(year).cast("double")).withColumn("__month", c(month))
    joined = null_safe_join(rows, F.broadcast(periods), ["__year", "__month"], "left")
    rest = [n for n in df.columns if n not in (year, month)]
    return joined.orderBy(na_text(F.col("__year"), "number"), F.coalesce("__month", F.lit("NA"))).select(c(year), c(month), *map(c, rest), c(".start_date"), c(".end_date"))


def _explicit(df: DataFrame, options: dict) -> DataFrame:
    names = _named(df, options, start_date="start_date", end_date="end_date")
    pattern = options.get("date_format", "%Y-%m-%d")
    java = pattern.replace("%Y", "yyyy").replace("%m", "MM").replace("%d", "dd").replace("%y", "yy").replace("%b", "MMM").replace("%B", "MMMM").replace("%H", "HH").replace("%M", "mm").replace("%S", "ss")

    def date(name: str) -> Column:
        kind = kind_of(field(df, name))
        return c(name).cast("date") if kind in ("date", "time") else F.try_to_timestamp(c(name).cast("string"), F.lit(java)).cast("date")

    return df.withColumns({".start_date": date(names["start_date"]), ".end_date": date(names["end_date"])})


def tag_tube_lat_lon(df: DataFrame, method=None, force: bool = False, **options) -> DataFrame:
    """``.latitude`` and ``.longitude`` from the columns named ``lat`` and ``lon``."""
    method, force = _settings("lat_lon", method, force, options)
    if not force and {".latitude", ".longitude"} <= set(df.columns):
        return df
    _methods(method, 1, "tag_tube_lat_lon")
    try:
        names = _named(df, options, lat="latitude", lon="longitude")
    except TubeError as e:
        raise TubeError(f"[tag_tube_lat_lon]> {e}") from None
    return df.withColumns({".latitude": c(names["lat"]).cast("double"), ".longitude": c(names["lon"]).cast("double")})


def dense_key(df: DataFrame, keys: list[Column], name: str, coarse: Column) -> DataFrame:
    """Adds a 1-based dense rank of the keys, missing ones last, as a double.

    ``coarse`` is a function of the first key that never falls as the key rises and has a bounded number of values.
    Only distinct keys are ordered, within each of these; the values' counts, a row each, give the offsets. All of it
    follows from the keys alone, so a part that is computed again gets the same numbers."""
    names = [f"__k{k}" for k in range(len(keys))]
    rows = df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    order = [F.col(n).asc_nulls_last() for n in names]
    distinct = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], coarse.alias("__band")).distinct()
    bands = distinct.groupBy("__band").agg(F.count("*").alias("__n"))
    before = Window.orderBy(F.col("__band").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("__band", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = distinct.withColumn("__at", F.row_number().over(Window.partitionBy("__band").orderBy(*order)))
    ranked = null_safe_join(ranked, F.broadcast(bands), ["__band"]).select(*names, (F.col("__at") + F.col("__base")).cast("double").alias(name))
    return null_safe_join(rows, ranked, names, "left").drop(*names)


def _latitude_band(lat: Column) -> Column:
    """Hundredths of a degree, 18,001 at most; what lies beyond the poles counts with them, NaN with the highest."""
    return F.when(lat.isNotNull(), F.floor(F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0)) * 100))


def tag_tube_sample_id(df: DataFrame, method=None, force: bool = False, **options) -> DataFrame:
    """``.sample_id``: a number for each place and period. 1 numbers them in order, 2 is a 64-bit hash of them."""
    method, force = _settings("sample_id", method, force, options)
    if not force and ".sample_id" in df.columns:
        return df
    wanted = _methods(method, 2, "tag_tube_sample_id")
    df = tag_tube_lat_lon(tag_tube_start_end(df, **options), **options).drop(".sample_id")
    if wanted[0] == 2:
        parts = [F.coalesce(c(n).cast("string"), F.lit("NA")) for n in _SAMPLE]
        return df.withColumn(".sample_id", F.xxhash64(F.array(*parts)))
    return dense_key(df, [c(n) for n in _SAMPLE], ".sample_id", _latitude_band(c(".latitude")))


def tag_tube_value(df: DataFrame, method=None, force: bool = False, **options) -> DataFrame:
    """``.value``: the first of the value terms that the data has; it chooses a column, not a value in each row."""
    method, force = _settings("value", method, force, options)
    if not force and ".value" in df.columns:
        return df
    _methods(method, 1, "tag_tube_value")
    wanted = options.get("value", VALUE_TERMS)
    for text in [wanted] if isinstance(wanted, str) else wanted:
        found = term(df, text)
        if found is not None:
            return df.withColumn(".value", F.nanvl(found.column, F.lit(None).cast("double")) if found.kind == "number" else found.column)
    raise TubeError(f"[tag_tube_value]> none of {wanted} found")


def tag_tube(df: DataFrame, **options) -> DataFrame:
    """The six standard tags; tagging again changes nothing."""
    return tag_tube_value(tag_tube_sample_id(tag_tube_lat_lon(tag_tube_start_end(df, **options), **options), **options), **options)


def tag_tube_date(df: DataFrame, method: int | None = None, force: bool = False, **options) -> DataFrame:
    """``.date``: 1 the start, 2 the middle (the default; half the days between, a half going to the even number), 3 the end."""
    method, force = _settings("date", method, force, options)
    if not force and ".date" in df.columns:
        return df
    m = _methods(2 if method is None else method, 3, "tag_tube_date")[0]
    df = tag_tube_start_end(df, **options)
    start, end = c(".start_date"), c(".end_date")
    middle = F.date_add(start, F.rint(F.datediff(end, start) / 2).cast("int"))
    return df.withColumn(".date", (start, middle, end)[m - 1])


def tag_tube_month(df: DataFrame, method=None, force: bool = False, **options) -> DataFrame:
    """``.month``: a factor with all twelve months."""
    method, force = _settings("month", method, force, options)
    if not force and ".month" in df.columns:
        return df
    df = tag_tube_date(df, **options).drop(".month")
    return df.select("*", as_factor(F.date_format(c(".date"), "MMM"), ".month", list(MONTH_LABELS)))


def tag_tube_year(df: DataFrame, method=None, force: bool = False, **options) -> DataFrame:
    """``.year``: an ordered factor of the years present (one small aggregation finds them)."""
    method, force = _settings("year", method, force, options)
    if not force and ".year" in df.columns:
        return df
    df = tag_tube_date(df, **options).drop(".year")
    year = F.date_format(c(".date"), "yyyy")
    levels = df.agg(F.array_sort(F.collect_set(year)).alias("y")).first().y
    return df.select("*", as_factor(year, ".year", levels, True))


def tag_tube_location(df: DataFrame, method=None, force: bool = False, **options) -> DataFrame:
    """``.location``: the coordinates as text, ``{lat,lon}``."""
    method, force = _settings("location", method, force, options)
    if not force and ".location" in df.columns:
        return df
    df = tag_tube_lat_lon(df, **options)
    text = [F.coalesce(number_text(c(n)), F.lit("NA")) for n in (".latitude", ".longitude")]
    return df.withColumn(".location", F.concat(F.lit("{"), text[0], F.lit(","), text[1], F.lit("}")))


TAGGERS = {
    ".start_date": tag_tube_start_end, ".end_date": tag_tube_start_end, ".latitude": tag_tube_lat_lon, ".longitude": tag_tube_lat_lon, ".sample_id": tag_tube_sample_id,
    ".value": tag_tube_value, ".date": tag_tube_date, ".month": tag_tube_month, ".year": tag_tube_year, ".location": tag_tube_location,
}


def tag_tube_required(df: DataFrame, required=(), **options) -> DataFrame:
    """Only the tags that the required texts name; other texts and things that aren't text are ignored."""
    for text in [required] if isinstance(required, str) else required:
        if not isinstance(text, str):
            continue
        for tag, tagger in TAGGERS.items():
            if tag == text or tag not in df.columns and tag in _names_in(text):
                df = tagger(df, **options)
    return df


def _names_in(text: str) -> set[str]:
    from airloom.functions.expressions import ExpressionError, tokens

    try:
        return {v for k, v in tokens(text) if k in ("name", "tick")}
    except ExpressionError:
        return set()
