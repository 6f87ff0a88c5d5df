"""Annual coverage: days covered by sampling periods, and places that pass a test in every year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from airloom.functions.expressions import attach
from airloom.operators.tagging import tag_tube_required
from airloom.session import TubeError, c, null_safe_join


def days_covered(df: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """Days in the union of each group's periods, ends included, overlaps once.

    Periods are swept in order of their starts; only the part beyond all earlier ends is counted, so the work grows
    with the number of periods and not with their length. Periods with a missing end or end < start cover nothing."""
    periods = df.where(c(start).isNotNull() & c(end).isNotNull() & (c(end) >= c(start))).select(*map(c, keys), c(start).alias("__s"), c(end).alias("__e")).distinct()
    before = Window.partitionBy(*map(c, keys)).orderBy("__s", "__e").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("__e").over(before)
    new = F.datediff("__e", F.greatest("__s", F.coalesce(F.date_add(seen, 1), F.col("__s")))) + 1
    return periods.withColumn("__d", F.greatest(new, F.lit(0))).groupBy(*map(c, keys)).agg(F.sum("__d").alias(name))


def tube_annual_cover(df: DataFrame, tube: str = ".value", by: str = ".location", output=("n", "pc"), rename=None, meta: bool = False, require_value: bool = False, **options) -> DataFrame:
    """``.annual.n`` days covered in each year and group, and ``.annual.pc`` of 365, as ``output`` asks for and
    ``rename`` names them; joined back on both keys, or with ``meta`` the groups alone.

    ``require_value`` leaves out periods without a measurement."""
    wanted = [output] if isinstance(output, str) else list(output)
    if bad := [o for o in wanted if o not in ("n", "pc")]:
        raise TubeError(f"[tube_annual_cover]> no output {bad[0]!r}; there are n and pc")
    names = [f".annual.{o}" for o in wanted] if rename is None else [rename] if isinstance(rename, str) else list(rename)
    if len(names) != len(wanted):
        raise TubeError("[tube_annual_cover]> output and rename differ in length")
    d = attach(tag_tube_required(df, [".year", tube, by, ".start_date", ".end_date"], **options), [tube, by], on_error="stop<<tube_annual_cover>>tube")
    keys = list(dict.fromkeys([".year", by]))
    used = d.where(c(tube).isNotNull()) if require_value else d
    groups = d.select(*map(c, keys)).distinct()
    cover = null_safe_join(groups, days_covered(used, keys, ".start_date", ".end_date", "__days"), keys, "left")
    days = F.coalesce(F.col("__days"), F.lit(0)).cast("double")
    cover = cover.select(*map(c, keys), *[(days if o == "n" else days / 365 * 100).alias(n) for o, n in zip(wanted, names, strict=True)])
    return cover if meta else null_safe_join(d.drop(*names), cover, keys)


def tube_annual_test(df: DataFrame, test: str, by=".location", years=None, rename: str | None = None, **options) -> DataFrame:
    """Adds ``<test>.<first>.<last>``, or what ``rename`` says: whether the row's group passes ``test`` in all the
    years; the test's own column goes.

    ``years`` defaults to those in the data; several keys are judged together."""
    keys = [by] if isinstance(by, str) else list(by)
    d = attach(tag_tube_required(df, [".year", *keys], **options), [test, *keys], on_error="stop<<tube_annual_test>>test")
    wanted = sorted(str(y) for y in years) if years is not None else (d.schema[".year"].metadata.get("levels") or [])
    if not wanted:
        raise TubeError("[tube_annual_test]> no years")
    name = rename or f"{test}.{wanted[0]}.{wanted[-1]}"
    passed = F.collect_set(F.when(c(test).cast("boolean"), c(".year").cast("string")))
    groups = d.groupBy(*map(c, keys)).agg((F.size(F.array_except(F.array(*map(F.lit, wanted)), passed)) == 0).alias(name))
    return null_safe_join(d.drop(test, name), groups, keys)
