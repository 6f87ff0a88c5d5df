"""Fitted models by group, with prediction on the data or on a grid, and masking far from the data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from airloom.functions.expressions import attach
from airloom.operators.aggregate import calc_tube_stat
from airloom.operators.tagging import tag_tube_required
from airloom.session import TubeError, c, field, kind_of, na_text, null_safe_join

#: Grid nodes of all inputs together, at most.
MAX_NODES = 4_000_000


def fit_tube_model_loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, se: bool = False, span: float = 0.75, degree: int = 2):
    """A local regression surface: predictions at ``at``, with se also their standard errors."""
    from airloom.operators.loess import r_loess

    return r_loess(x, y, span, degree).predict(at, se)


def fit_tube_model_gam(x: np.ndarray, y: np.ndarray, at: np.ndarray, se: bool = False, k: int = 5):
    """A tensor-product smooth of the inputs."""
    from airloom.operators.gam import fit_tensor_gam

    return fit_tensor_gam(x, y, k).predict(at, se)


MODELS = {"loess": fit_tube_model_loess, "gam": fit_tube_model_gam}


def grid_nodes(df: DataFrame, inputs: list[str], resolution: int | list[int] = 100, borders: float = 0.0) -> DataFrame:
    """All combinations of evenly spaced values of the inputs' ranges, grown by ``borders``; the first varies fastest."""
    sizes = [resolution] * len(inputs) if isinstance(resolution, int) else list(resolution)
    if np.prod(sizes, dtype=float) > MAX_NODES:
        raise TubeError(f"[grid_nodes]> more than {MAX_NODES} nodes")
    lo_hi = df.agg(*[f(c(n)).alias(f"{p}{k}") for k, n in enumerate(inputs) for p, f in (("lo", F.min), ("hi", F.max))])
    out = lo_hi
    for k, n in reversed(list(enumerate(inputs))):
        pad = (F.col(f"hi{k}") - F.col(f"lo{k}")) * borders
        low, high = F.col(f"lo{k}") - pad, F.col(f"hi{k}") + pad
        step = F.col(f"i{k}") / float(max(sizes[k] - 1, 1))
        out = out.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.lit(sizes[k] - 1)))).withColumn(f"v{k}", low + (high - low) * step)
    return out.orderBy(*[f"i{k}" for k in reversed(range(len(inputs)))]).select(*[F.col(f"v{k}").alias(n) for k, n in enumerate(inputs)])


def exclude_too_far(grid: DataFrame, data: DataFrame, inputs: list[str], distance: float, outputs: list[str], by=()) -> DataFrame:
    """Outputs set to missing at nodes farther than ``distance`` from all data (of their own ``by`` group), in units of
    the grid's ranges.

    Data and nodes meet in cells as wide as the distance, so only neighbours are compared."""
    ranges = grid.agg(*[f(c(n)).alias(f"{p}{k}") for k, n in enumerate(inputs) for p, f in (("lo", F.min), ("hi", F.max))]).first()  # one row

    if any(v is None for v in ranges):  # no nodes
        return grid

    def unit(k: int, n: str):
        width = ranges[f"hi{k}"] - ranges[f"lo{k}"]
        return (c(n) - ranges[f"lo{k}"]) / (width or 1.0)

    if distance <= 0:
        raise TubeError("[exclude_too_far]> the distance must be more than 0")
    of = [na_text(c(k), "text" if (kind := kind_of(field(data, k))) == "factor" else kind) for k in by]
    group = F.concat_ws("|", *of) if of else F.lit("")
    units = [unit(k, n) for k, n in enumerate(inputs)]
    nodes = grid.select(group.alias("g"), *[c(n).alias(f"n{k}") for k, n in enumerate(inputs)], *[u.alias(f"u{k}") for k, u in enumerate(units)]).distinct()
    points = data.select(group.alias("g"), *[u.alias(f"p{k}") for k, u in enumerate(units)]).distinct().where(" and ".join(f"p{k} is not null" for k in range(len(inputs))))
    for k in range(len(inputs)):
        points = points.withColumn(f"c{k}", F.floor(F.col(f"p{k}") / distance))
        nodes = nodes.withColumn(f"c{k}", F.floor(F.col(f"u{k}") / distance)).withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + s for s in (-1, 0, 1)])))
    gap = F.sqrt(sum((F.pow(F.col(f"u{k}") - F.col(f"p{k}"), 2) for k in range(len(inputs))), F.lit(0.0)))
    close = nodes.join(points, ["g", *[f"c{k}" for k in range(len(inputs))]]).where(gap <= distance).select("g", *[f"n{k}" for k in range(len(inputs))]).distinct().withColumn("__ok", F.lit(True))
    rows = grid.select("*", group.alias("g"), *[c(n).alias(f"n{k}") for k, n in enumerate(inputs)])
    masked = rows.join(close, ["g", *[f"n{k}" for k in range(len(inputs))]], "left")
    return masked.select(*[F.when(F.col("__ok"), c(n)).alias(n) if n in outputs else c(n) for n in grid.columns])


def _axes(df: DataFrame, inputs: list[str], resolution: int | list[int], borders: float) -> list[np.ndarray] | None:
    """The values of a grid's axes, from the inputs' ranges (one row)."""
    sizes = [resolution] * len(inputs) if isinstance(resolution, int) else list(resolution)
    if np.prod(sizes, dtype=float) > MAX_NODES:
        raise TubeError(f"[fit_tube_model]> more than {MAX_NODES} nodes")
    r = df.agg(*[f(c(n)).alias(f"{p}{k}") for k, n in enumerate(inputs) for p, f in (("lo", F.min), ("hi", F.max))]).first()
    if any(v is None for v in r):
        return None
    axes = []
    for k, size in enumerate(sizes):
        lo, hi = float(r[f"lo{k}"]), float(r[f"hi{k}"])
        low, high = lo - (hi - lo) * borders, hi + (hi - lo) * borders
        axes.append(low + (high - low) * np.arange(size) / max(size - 1, 1))
    return axes


#: Rows of new data that a task predicts at most.
NEW_ROWS = 50_000


def fit_tube_model(
    df: DataFrame, tube: str = ".value", inputs=(".longitude", ".latitude"), by=None, model: str | Callable = "loess", simplify: bool = False, min_count: float = -1, min_prop: float = -1,
    new_data: DataFrame | str | None = None, grid_resolution: int | list[int] = 100, grid_borders: float | None = None, too_far: float | None = None, force_positive: bool = False, se: bool = True, **options,
) -> DataFrame:
    """Fits a model of ``tube`` on ``inputs`` in each ``by`` group, a task per group, and predicts ``<tube>.pred`` and,
    unless ``se`` is off, its error ``<tube>.pred.se``.

    The data come back with their predictions; ``new_data`` is predicted for each group instead, or with "input.ranges"
    a grid over the inputs. Groups with fewer than ``min_count`` values (if that is more than 0), a share of them below
    ``min_prop``, or too few for the model, have no rows. ``simplify`` averages rows of equal inputs first. A model is a
    name, or a function (x, y, at, se) of arrays. A row with a missing input has a missing prediction. ``too_far``
    blanks nodes far from their own group's data. A task holds its group's inputs and values; predictions are made once
    for equal inputs and joined back."""
    inputs, keys = [inputs] if isinstance(inputs, str) else list(inputs), [] if by is None else [by] if isinstance(by, str) else list(by)
    d = attach(tag_tube_required(df, [tube, *inputs, *keys], **options), [tube, *inputs, *keys], on_error="stop<<fit_tube_model>>tube")
    function = MODELS.get(model) if isinstance(model, str) else model
    if function is None:
        raise TubeError(f"[fit_tube_model]> no model {model!r}")
    if simplify:
        d = calc_tube_stat(d, tube, [*inputs, *keys])
    xs, ks = [f"x{i}" for i in range(len(inputs))], [f"k{i}" for i in range(len(keys))]
    number = lambda n: F.nanvl(c(n).cast("double"), F.lit(None))
    named_keys = [c(k).cast("string").alias(a) for k, a in zip(keys, ks, strict=True)]
    rows = d.select(*named_keys, *[number(n).alias(a) for n, a in zip(inputs, xs, strict=True)], number(tube).alias("y"))
    axes = _axes(d, inputs, grid_resolution, grid_borders or 0.0) if isinstance(new_data, str) else None
    if isinstance(new_data, str) and axes is None:
        return d.limit(0).select(*map(c, [*keys, *inputs]), *[F.lit(0.0).alias(n) for n in ([f"{tube}.pred", f"{tube}.pred.se"] if se else [f"{tube}.pred"])])

    def predict(group, at):
        """Rows of the group's keys, ``at`` and its predictions; none where the group is too small for the model."""
        import pandas as pd

        x, y = group[xs].to_numpy(float), group["y"].to_numpy(float)
        present = int((~np.isnan(y)).sum())
        whole = ~(np.isnan(x).any(axis=1) | np.isnan(y))
        nothing = pd.DataFrame(columns=[*ks, *xs, "pred", "se"])
        if min_count > 0 and present < min_count or min_prop > 0 and present < min_prop * len(y):
            return nothing
        try:
            got = function(x[whole], y[whole], at, se)
        except (TubeError, ValueError, np.linalg.LinAlgError):
            return nothing
        pred, size = got if se else (got, np.full(len(at), np.nan))
        out = pd.DataFrame(at, columns=xs)
        for k in ks:
            out[k] = group[k].iloc[0]
        out["pred"] = np.maximum(pred, 0) if force_positive else pred
        out["se"] = size
        return out[[*ks, *xs, "pred", "se"]]

    def on_grid(group):
        mesh = np.meshgrid(*axes, indexing="ij")
        return predict(group, np.stack([m.ravel(order="F") for m in mesh], axis=1))

    def on_itself(group):
        return predict(group, group[xs].drop_duplicates().to_numpy(float))

    def on_new(group, new):
        return predict(group, new[xs].to_numpy(float)) if len(group) and len(new) else predict(group.iloc[:0], np.zeros((0, len(xs))))

    schema = ", ".join([f"{k} string" for k in ks] + [f"{x} double" for x in xs] + ["pred double", "se double"])
    if not ks:
        rows = rows.withColumn("all", F.lit(1))
    parts = ks or ["all"]
    if axes is not None or new_data is None:
        fitted = rows.groupBy(*parts).applyInPandas(on_grid if axes is not None else on_itself, schema)
    else:
        new = new_data.select(*[number(n).alias(a) for n, a in zip(inputs, xs, strict=True)])
        blocks = max(1, -(-new.count() // NEW_ROWS))
        asked = new.withColumn("block", F.pmod(F.xxhash64(*xs, F.monotonically_increasing_id()), F.lit(blocks)))
        asked = asked.crossJoin(rows.select(*[F.col(p).alias(f"of_{p}") for p in parts]).distinct())  # every group predicts every row: the size of the result
        held = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("bigint"))
        fitted = held.groupBy(*parts, "block").cogroup(asked.withColumnRenamed("block", "of_block").groupBy(*[f"of_{p}" for p in parts], "of_block")).applyInPandas(on_new, schema)
    preds = [F.nanvl("pred", F.lit(None)).alias(f"{tube}.pred")] + ([F.nanvl("se", F.lit(None)).alias(f"{tube}.pred.se")] if se else [])
    if new_data is None:
        marked = d.select("*", *[n.alias(f"__{a}") for a, n in zip([*ks, *xs], [c(k).cast("string") for k in keys] + [number(n) for n in inputs], strict=True)])
        found = fitted.select(*[F.col(k).alias(f"__{k}") for k in ks], *[F.nanvl(x, F.lit(None)).alias(f"__{x}") for x in xs], *preds)
        return null_safe_join(marked.drop(*[f"{tube}.pred", f"{tube}.pred.se"]), found, [f"__{a}" for a in (*ks, *xs)]).drop(*[f"__{a}" for a in (*ks, *xs)])
    types = dict(d.dtypes)
    out = fitted.select(*[F.col(a).cast(types[k]).alias(k, metadata=field(d, k).metadata) for k, a in zip(keys, ks, strict=True)], *[F.nanvl(a, F.lit(None)).alias(n) for n, a in zip(inputs, xs, strict=True)], *preds)
    return out if too_far is None else exclude_too_far(out, d, inputs, too_far, [f"{tube}.pred"], keys)
