"""Grouped statistics: any number of columns, keys and named statistics in one hash aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airloom.functions.expressions import attach, term
from airloom.functions.statistics import Stat, as_stat
from airloom.operators.tagging import tag_tube_required
from airloom.session import TubeError, as_text, c, field, kind_of, levels_of, natural_of, sort_columns


def split_keys(df: DataFrame, by: list[str]) -> list[str]:
    """A single key with commas names several columns; several keys can't have commas."""
    if len(by) == 1 and "," in by[0] and by[0] not in df.columns and "(" not in by[0]:
        names = [n.strip() for n in by[0].split(",")]
        if missing := [n for n in names if n not in df.columns]:
            raise TubeError(f"[calc_tube_stat]> by: missing {', '.join(missing)}")
        return names
    if len(by) > 1 and any("," in b and "(" not in b for b in by):
        raise TubeError("[calc_tube_stat]> by: no commas in several keys")
    return by


def calc_tube_stat(df: DataFrame, tube=".value", by=None, stat=None, **options) -> DataFrame:
    """One row per group, in group order (missing first, factors by level).

    ``tube`` and ``by`` are terms; ``stat`` is a Stat, a name, a function from a column to an aggregate, or a dict of
    such functions, whose names give ``<tube>.<name>``. If any statistic is text, all of a tube's become text."""
    tubes = [tube] if isinstance(tube, str) else list(tube)
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    stat = as_stat(stat)
    df = tag_tube_required(df, [*tubes, *[k for b in keys for k in ([b] if "(" in b else b.split(","))]], **options)
    keys = split_keys(df, keys)
    df = attach(df, [*tubes, *keys], on_error="stop<<calc_tube_stat>>tube")
    out = []
    for name in tubes:
        for label, column, is_text in stat.columns(c(name), name):
            if stat.text and not is_text:
                column = as_text(column.cast("double"), "number")
            out.append(column.alias(label))
    if not keys:
        return df.agg(*out)
    fields = {k: field(df, k) for k in keys}
    grouped = df.groupBy(*map(c, keys)).agg(*out)
    rest = [n for n in grouped.columns if n not in keys]
    kept = [c(k).alias(k, metadata=fields[k].metadata) if kind_of(fields[k]) == "factor" else c(k) for k in keys]
    ordered = grouped.select(*kept, *map(c, rest))
    return ordered.orderBy(*sort_columns(ordered, keys))


def calc_tube_apply(df: DataFrame, function, schema: str, by) -> DataFrame:
    """The slow way for statistics that aren't aggregates: a function of each group's pandas frame."""
    keys = split_keys(df, [by] if isinstance(by, str) else list(by))
    df = attach(tag_tube_required(df, keys), keys)
    return df.groupBy(*map(c, keys)).applyInPandas(function, schema)


def factor_counts(df: DataFrame, name: str) -> DataFrame:
    """level and n of a factor or text column: every level, none left out, then "NA's" if there are any missing."""
    f = field(df, name)
    text = as_text(c(name), "text" if kind_of(f) == "factor" else kind_of(f))
    counted = df.groupBy(text.alias("level")).agg(F.count("*").alias("n"))
    levels = levels_of(f)
    if levels is None:
        by = F.col("level").try_cast("double") if natural_of(f) == "number" else F.col("level")
        return counted.orderBy(F.col("level").isNull(), by).select(F.coalesce("level", F.lit("NA's")).alias("level"), "n")
    all_levels = df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(levels)], "at int, level string")
    full = all_levels.join(counted.where("level is not null"), "level", "left").select("at", "level", F.coalesce("n", F.lit(0)).alias("n"))
    missing = counted.where("level is null").select(F.lit(len(levels)).alias("at"), F.lit("NA's").alias("level"), "n")
    return full.unionByName(missing).orderBy("at").select("level", "n")


def make_names(names: list[str]) -> list[str]:
    """Texts as syntactic names, repeated ones numbered."""
    import re

    out, seen = [], {}
    for n in names:
        n = re.sub(r"[^A-Za-z0-9._]", ".", n)
        if not re.match(r"[A-Za-z]|\.(?!\d)", n):
            n = "X" + n
        k = seen.get(n, -1) + 1
        seen[n] = k
        out.append(f"{n}.{k}" if k else n)
    return out


def factor_row(df: DataFrame, name: str) -> DataFrame:
    """The counts of ``factor_counts`` as one row, a column per level."""
    rows = factor_counts(df, name).collect()  # one row per level
    spark = df.sparkSession
    if not rows:
        return spark.range(1).select()
    return spark.createDataFrame([tuple(int(r.n) for r in rows)], ", ".join(f"`{n}` bigint" for n in make_names([r.level for r in rows])))


def get_scalar(df: DataFrame, text: str):
    """A scalar expression such as mean(x, na.rm = TRUE), on the driver."""
    value = term(df, text, None, "stop<<get_scalar>>x")
    return value.literal
