"""Session defaults, column quoting, and the text and missing-value rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


class TubeError(ValueError):
    """A request that the data or the arguments can't answer."""


def session(name: str = "airloom", **conf) -> SparkSession:
    """A session with the settings that the engine assumes."""
    made = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        made = made.config(key, value)
    return made.getOrCreate()


def c(name: str) -> Column:
    """A column by its exact name, dots, spaces and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(field: T.StructField) -> str:
    """number, text, logical, date, time, factor or other."""
    t = field.dataType
    if isinstance(t, T.StringType):
        return "factor" if {"levels", "natural"} & set(field.metadata or {}) else "text"
    if isinstance(t, T.BooleanType):
        return "logical"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "number" if isinstance(t, T.NumericType) else "other"


def levels_of(field: T.StructField) -> list[str] | None:
    return (field.metadata or {}).get("levels")


def natural_of(field: T.StructField) -> str | None:
    """How the levels of a factor without a list of them are ordered: as text or by number."""
    return (field.metadata or {}).get("natural")


def as_factor(col: Column, name: str, levels: list[str], ordered: bool = False) -> Column:
    """A text column whose levels and their order are part of its schema."""
    return col.alias(name, metadata={"levels": list(levels), "ordered": ordered})


def clean(df: DataFrame) -> DataFrame:
    """Floating columns with NaN turned into NULL, which every operator reads as missing."""
    found = {f.name: F.nanvl(c(f.name), F.lit(None)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(found) if found else df


def number_text(x: Column) -> Column:
    """A double as text: whole numbers without a point, else the shortest form that reads back the same."""
    raw = x.cast("string")
    mantissa, power = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", ""), F.split_part(raw, F.lit("E"), F.lit(2)).cast("int")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string"))
        .when(F.instr(raw, "E") == 0, raw)
        .otherwise(F.concat(mantissa, F.lit("e"), exponent))
    )


def as_text(x: Column, kind: str) -> Column:
    """A value as text, NULL staying NULL."""
    if kind == "number":
        return number_text(x.cast("double"))
    if kind == "logical":
        return F.upper(x.cast("string"))
    if kind == "date":
        return F.date_format(x, "yyyy-MM-dd")
    return x.cast("string")


def na_text(x: Column, kind: str) -> Column:
    """A value as text, NULL as NA."""
    return F.coalesce(as_text(x, kind), F.lit("NA"))


def field(df: DataFrame, name: str) -> T.StructField:
    try:
        return df.schema[name]
    except KeyError:
        raise TubeError(f"no column {name!r}; the data has {', '.join(df.columns)}") from None


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match NULL keys; the keys come once, from the left."""
    other = right.select(*[c(n).alias(f"__r_{n}") if n in by else c(n) for n in right.columns])
    on = [c(n).eqNullSafe(c(f"__r_{n}")) for n in by]
    joined = left.join(other, on, how) if by else left.crossJoin(other)
    return joined.drop(*[f"__r_{n}" for n in by])


def sort_columns(df: DataFrame, by: list[str]) -> list[Column]:
    """Group order: missing first, factors by level, all else ascending by value or code point."""
    out = []
    for name in by:
        levels = levels_of(field(df, name))
        key = F.array_position(F.array(*[F.lit(v) for v in levels]), c(name)) if levels else c(name).try_cast("double") if natural_of(field(df, name)) == "number" else c(name)
        out.append(key.asc_nulls_first())
    return out
