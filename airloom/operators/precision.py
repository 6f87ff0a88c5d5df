"""Replicate precision: spread within sets of tubes exposed together, with local-regression bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from airloom.functions.expressions import attach
from airloom.functions.statistics import NORMAL_975, finite, quantile7, significant, t_quantile
from airloom.operators.loess import loess_curves
from airloom.operators.tagging import tag_tube, tag_tube_required
from airloom.session import TubeError, c, field, kind_of, na_text, null_safe_join


@dataclass
class TestResult:
    """data, lookup and (for accuracy) all are lazy frames; report() is computed when asked for."""

    __test__ = False
    data: DataFrame
    lookup: DataFrame
    make_report: object
    all: DataFrame | None = None
    plot: object = None

    def report(self, summary: bool = False) -> str:
        lines = self.make_report().split("\n")
        if summary:
            lines = [x for x in lines if "Insufficient" not in x]
            return "\n".join(lines) if len(lines) > 1 else "not enough data..."
        return "\n".join(lines)

    def shown(self, show) -> TestResult:
        """Prints what is asked for: "report", or "summary.report" without the lines that lack data."""
        for what in [show] if isinstance(show, str) else show or ():
            if what.lower() in ("report", "summary.report"):
                print(self.report(what.lower() == "summary.report"))
        return self


def terms_of(value, most: int, who: str, what: str) -> list[str]:
    found = [] if value is None else [value] if isinstance(value, str) else list(value)
    if len(found) > most:
        raise TubeError(f"[{who}]> no more than {most} {what} allowed")
    return found


def cut_key(df: DataFrame, terms: list[str]) -> Column:
    """``|all|``, or the terms' values between bars."""
    if not terms:
        return F.lit("|all|")
    parts = []
    for t in terms:
        kind = kind_of(field(df, t))
        parts += [F.lit("|"), na_text(c(t), "text" if kind == "factor" else kind)]
    return F.concat(*parts, F.lit("|"))


def half_width(method: int, n: Column, sd: Column, sizes: list[int]) -> Column:
    """Half the interval of methods 2 to 4; blank for two values or fewer."""
    root = sd / F.sqrt(n)
    if method == 2:
        table = F.create_map(*[F.lit(v) for k in sizes if k > 2 for v in (k, t_quantile(0.975, k - 1))] or [F.lit(0), F.lit(0.0)])
        return F.when(n > 2, F.try_element_at(table, n.cast("int")) * root)
    return F.when(n > 2, 1.96 * root if method == 3 else NORMAL_975 * sd)


def replicate_stats(df: DataFrame, by: list[str], method: int = 2, sizes: list[int] | None = None) -> DataFrame:
    """``by``, .n (finite values), .mean, .low and .high of each set of replicates."""
    x = F.when(finite(c(".tube")), c(".tube"))
    stats = [F.count(x).alias(".n"), F.avg(x).alias(".mean"), F.stddev_samp(x).alias("__sd")]
    if method == 1:
        stats.append(quantile7(x, [0.025, 0.975]).alias("__q"))
    sets = df.groupBy(*map(c, by)).agg(*stats)
    if method == 1:
        return sets.withColumns({".low": F.get("__q", F.lit(0)), ".high": F.get("__q", F.lit(1))}).drop("__sd", "__q")
    if method == 2 and sizes is None:
        sizes = sorted(r[0] for r in sets.select(c(".n")).distinct().collect())
    half = half_width(method, c(".n"), F.col("__sd"), sizes or [])
    return sets.withColumns({".low": c(".mean") - half, ".high": c(".mean") + half}).drop("__sd")


def replicates(df: DataFrame, tube: str = ".value", n: int = 3, method: int = 2, group=None, facet=None, **options) -> tuple[DataFrame, DataFrame]:
    """The rows of sets with exactly ``n`` finite values, with their sets' statistics; and all rows with .cut."""
    groups, facets = terms_of(group, 1, "test_tube_precision", "group term"), terms_of(facet, 2, "test_tube_precision", "facet terms")
    if method not in (1, 2, 3, 4):
        raise TubeError("[test_tube_precision]> method must be 1 to 4")
    d = tag_tube_required(tag_tube(df, **options), [tube, *groups, *facets])
    d = attach(d, [tube, *groups, *facets], on_error="stop<<test_tube_precision>>tube")
    if kind_of(field(d, tube)) != "number":
        raise TubeError("[test_tube_precision]> tube isn't numeric")
    d = d.withColumn(".tube", c(tube).cast("double")).withColumn(".cut", cut_key(d, [*groups, *facets]))
    # One hash aggregation per set, joined back on the set's keys.
    sets = replicate_stats(d, [".cut", ".sample_id"], method, [n]).where(c(".n") == n)
    return null_safe_join(d, sets, [".cut", ".sample_id"]).where(c(".tube").isNotNull()), d


def test_tube_precision(df: DataFrame, tube: str = ".value", n: int = 3, method: int = 2, group=None, facet=None, show=None, **options) -> TestResult:
    """Replicate intervals and their smooth bounds against the set mean, for each .cut.

    data: replicate rows with .n .mean .low .high .y .ylow .yhigh; lookup: bounds at round tens of the mean."""
    rows, d = replicates(df, tube, n, method, group, facet, **options)
    sets = replicate_stats(d, [".cut", ".sample_id"], method, [n]).where(c(".n") == n)
    sets = sets.select(c(".cut"), c(".sample_id"), c(".n"), c(".mean"), c(".low"), c(".high"), (c(".n") * c(".mean")).alias("sy"), (c(".n") * c(".low")).alias("slow"), (c(".n") * c(".high")).alias("shigh"), F.when(c(".low").isNotNull(), c(".n")).alias("wlow"))
    carried = (".n", ".mean", ".low", ".high")
    curves = loess_curves(sets, ".cut", ".mean", {".y": ("sy", ".n"), ".ylow": ("slow", "wlow"), ".yhigh": ("shigh", "wlow")}, ident=".sample_id", carry=carried)
    fitted = curves.where("not on_grid").select(c(".cut"), c(".sample_id"), c(".n").cast("bigint").alias(".n"), *map(c, carried[1:]), c(".y"), c(".ylow"), c(".yhigh"))
    # A set's numbers and its place on the curves come from one task and meet the rows by the set's name.
    data = null_safe_join(d, fitted, [".cut", ".sample_id"]).where(c(".tube").isNotNull()).orderBy(c(".cut"))
    enough = sets.select(c(".cut")).distinct()
    grid = curves.where("on_grid").select(c(".cut"), c("x").alias("ans"), c(".ylow").alias("low"), c(".yhigh").alias("high"))
    lookup = grid.select("*", ((F.col("low") - F.col("ans")) / F.col("ans") * 100).alias("low.pc"), ((F.col("high") - F.col("ans")) / F.col("ans") * 100).alias("high.pc"))
    cuts = d.select(c(".cut")).distinct()
    lacking = cuts.join(enough, ".cut", "left_anti").select(c(".cut"), *[F.lit(None).cast("double").alias(k) for k in ("ans", "low", "high", "low.pc", "high.pc")])
    lookup = lookup.unionByName(lacking).orderBy(c(".cut"), "ans")

    def report() -> str:
        pc = lambda col: F.avg((c(col) - c(".mean")) / c(".mean") * 100)
        found = rows.groupBy(c(".cut")).agg(F.count("*").alias("n"), F.avg(c(".mean")).alias("m"), F.min(c(".mean")).alias("lo"), F.max(c(".mean")).alias("hi"), pc(".low").alias("pl"), pc(".high").alias("ph"))
        got = {r[".cut"]: r for r in cuts.join(found, ".cut", "left").collect()}  # one row per cut
        lines = [f"'{tube}' (rep = {n} subset):"]
        for key in sorted(got):
            r, s = got[key], significant
            if r.n is None or r.n < n:
                lines.append(f"  {key} Insufficient replicates...")
            else:
                lines.append(f"  {key} mean: {s(r.m)} ({s(r.lo)} to {s(r.hi)}) precision: {s(r.pl)}[%] to {s(r.ph)}[%]")
        return "\n".join(lines)

    from airloom.plans.figures import precision_plot

    kept = {k: v for k, v in {"facet": facet, "group": group}.items() if v is not None}
    return TestResult(data, lookup, report, plot=precision_plot(data, **options, **kept)).shown(show)


test_tube_precision.__test__ = False
