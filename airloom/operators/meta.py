"""Meta-data: checking, extracting, adding, padding and repairing attributes that should be constant in a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from airloom.functions.expressions import attach
from airloom.functions.statistics import n_distinct, options as options_of
from airloom.operators.tagging import tag_tube, tag_tube_required
from airloom.session import TubeError, as_text, c, field, kind_of, null_safe_join

#: Tag columns, which are no attributes.
TAGS = (".start_date", ".end_date", ".latitude", ".longitude", ".sample_id", ".value", ".date", ".month", ".year", ".location")
LEVELS = (("total", None), ("sample", ".sample_id"), ("date", ".date"), ("location", ".location"))


def _text(df: DataFrame, name: str):
    kind = kind_of(field(df, name))
    return as_text(c(name), "text" if kind == "factor" else kind)


def check_tube_meta(df: DataFrame, x: str | None = None, by: str | None = None, output: str | None = None, **options) -> DataFrame:
    """Distinct values of ``x`` in each ``by`` group (missing counts as one) and the present ones, worst first.

    Counts sort as numbers; without output="report" the groups are counted by what was found."""
    if x is None or by is None:
        raise TubeError("[check_tube_meta]> x and by are needed")
    d = attach(tag_tube_required(df, [x, by], **options), [x, by], on_error="stop<<check_tube_meta>>x")
    out = d.groupBy(c(by)).agg(n_distinct(_text(d, x)).cast("string").alias(f"{x}.count"), options_of(_text(d, x)).alias(f"{x}.options"))
    out = out.orderBy(c(f"{x}.count").cast("int").desc(), c(by))
    if output in ("report", "full.report"):
        return out
    keys = [c(f"{x}.count"), c(f"{x}.options")]
    return out.groupBy(*keys).agg(F.count("*").alias(by)).orderBy(*keys)


def extract_tube_meta(df: DataFrame, x=None, by: str = ".sample_id", **options) -> DataFrame | None:
    """Columns with exactly one present value in every group, one row per group; None if there is none."""
    d = tag_tube_required(df, [by], **options)
    wanted = [n for n in d.columns if n != by and n not in TAGS] if x is None else [x] if isinstance(x, str) else list(x)
    d = attach(d, [*wanted, by])
    groups = d.groupBy(c(by)).agg(*[F.count_distinct(c(n)).alias(n) for n in wanted], *[F.min(c(n)).alias(f"__{k}") for k, n in enumerate(wanted)])
    flags = groups.agg(*[F.min((c(n) == 1)).alias(n) for n in wanted]).first()  # one row
    kept = [(k, n) for k, n in enumerate(wanted) if flags[n]]
    if not kept:
        return None
    return groups.select(c(by), *[c(f"__{k}").alias(n, metadata=field(d, n).metadata) for k, n in kept]).orderBy(c(by))


def add_tube_meta(df: DataFrame, ref: DataFrame, by: str = ".sample_id", **options) -> DataFrame:
    """Adds the columns of ``ref``; where both have one, the reference's is taken."""
    d = tag_tube_required(df, [by], **options)
    rest = [n for n in d.columns if n == by or n not in ref.columns]
    return null_safe_join(d.select(*map(c, rest)), ref, [by])


def extract_and_add_tube_meta(df: DataFrame, x=None, by=".sample_id", ref: DataFrame | None = None, **options) -> DataFrame:
    """Extracts from ``ref`` for each key in turn and adds what was found."""
    source = df if ref is None else ref
    for key in [by] if isinstance(by, str) else by:
        found = extract_tube_meta(source, x, key, **options)
        if found is not None:
            df = add_tube_meta(df, found, key, **options)
    return df


def pad_tube_meta(df: DataFrame, x, by: str = ".sample_id", order: str | None = None, **options) -> DataFrame:
    """Each column replaced by its group's first present value: the smallest, or the first by ``order``."""
    d = tag_tube_required(df, [by], **options)
    names = [x] if isinstance(x, str) else list(x)
    d = attach(d, [*names, by])
    window = Window.partitionBy(c(by))
    ordered = window.orderBy(c(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if order else None
    new = {n: (F.first(c(n), True).over(ordered) if ordered else F.min(c(n)).over(window)).alias(n, metadata=field(d, n).metadata) for n in names}
    return d.select(*[new.get(n, c(n)) for n in d.columns])


def repair_tube_meta(df: DataFrame, x: str, by: str = ".sample_id", options: list[str] | None = None, **tags) -> DataFrame:
    """Groups with several values: if exactly one is among ``options`` it replaces all, if more are, they get .SUSPECT."""
    d = attach(tag_tube_required(df, [x, by], **tags), [x, by])
    allowed = F.array(*[F.lit(v) for v in options or []]).cast("array<string>")
    text = _text(d, x)
    window = Window.partitionBy(c(by))
    found = F.collect_set(text).over(window)
    several = F.size(found) + F.max(F.when(text.isNull(), 1).otherwise(0)).over(window) > 1
    good = F.array_intersect(found, allowed)
    fixed = F.when(several & (F.size(good) == 1), F.get(good, F.lit(0))).when(several & (F.size(good) > 1), F.concat(text, F.lit(".SUSPECT"))).otherwise(text)
    return d.select(*[fixed.alias(n) if n == x else c(n) for n in d.columns])


def repair_counts(df: DataFrame, x: str, by: str = ".sample_id", options: list[str] | None = None) -> DataFrame:
    """One row: how many groups were repaired and how many are suspect."""
    d = attach(tag_tube_required(df, [x, by]), [x, by])
    allowed = F.array(*[F.lit(v) for v in options or []]).cast("array<string>")
    groups = d.groupBy(c(by)).agg(n_distinct(_text(d, x)).alias("n"), F.size(F.array_intersect(F.collect_set(_text(d, x)), allowed)).alias("good")).where("n > 1")
    return groups.agg(F.count_if(F.col("good") == 1).alias("repaired"), F.count_if(F.col("good") > 1).alias("suspect"))


def meta_levels(df: DataFrame, x, plot_type: int = 1, **options) -> DataFrame:
    """How constant columns are in each level's groups, in percent of all rows.

    Type 1: a row per column and level, the share of rows in groups with a single value. Type 2: a row per column,
    level and group with its status: grey all missing, green one value, amber one value and missing, red several.
    Rows are first counted by column, group and value, so that what a group has is a sum over its values."""
    names = [x] if isinstance(x, str) else list(x)
    d = attach(tag_tube_required(df, [".sample_id", ".date", ".location"], **options), names)
    keys = {label: F.lit(None).cast("string") if key is None else c(key).cast("string") for label, key in LEVELS}
    parts = F.array(*[F.struct(F.lit(n).alias("variable"), _text(d, n).alias("value")) for n in names])
    # Equal rows are counted once for all levels, before they are dealt to each.
    counted = d.select(F.explode(parts).alias("p"), *[k.alias(f"__{label}") for label, k in keys.items()]).groupBy("p.variable", "p.value", *[f"__{label}" for label in keys]).agg(F.count("*").alias("n"))
    levels = F.array(*[F.struct(F.lit(label).alias("ref"), F.col(f"__{label}").alias("group")) for label in keys])
    values = counted.select("variable", "value", "n", F.explode(levels).alias("l")).groupBy("variable", "l.ref", "l.group", "value").agg(F.sum("n").alias("n"))
    groups = values.groupBy("variable", "ref", "group").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"), F.count("value").alias("k"))
    total = groups.where("ref = 'total'").select("variable", F.col("n").alias("total"))
    missing = F.col("n") > F.col("present")
    status = F.when(F.col("present") == 0, "grey").when((F.col("k") == 1) & ~missing, "green").when(F.col("k") == 1, "amber").otherwise("red")
    groups = groups.join(F.broadcast(total), "variable").withColumn("status", status)  # a row a column
    if plot_type == 2:
        return groups.select("variable", "ref", "group", (F.col("n") / F.col("total") * 100).alias("value"), "status")
    single = F.sum(F.when((F.col("k") == 1) & ~missing, F.col("present")).otherwise(0))
    return groups.groupBy("variable", "ref").agg((single / F.max("total") * 100).alias("value"))


def test_tube_meta(df: DataFrame, x=None, by=None, plot_type: int = 2, palette=None, **options):
    """A figure of ``meta_levels``, of all columns unless some are named: bars by level (type 1), or stacked by status."""
    from airloom.plans.figures import meta_plot

    d = tag_tube(df, **options)
    return meta_plot(meta_levels(d, list(d.columns) if x is None else x, plot_type, **options), plot_type, palette)


test_tube_meta.__test__ = False
