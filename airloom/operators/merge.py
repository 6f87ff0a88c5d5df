"""Merging two frames: keys inferred, missing keys matching, keys first, rows in the order of the keys as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airloom.session import TubeError, c, field, kind_of, na_text, null_safe_join


def r_merge(x: DataFrame, y: DataFrame, by=None, how: str = "inner") -> DataFrame:
    """Joins on the shared columns, in the order of ``x``, or on ``by``; other shared names get .x and .y."""
    shared = [n for n in x.columns if n in y.columns]
    keys = shared if by is None else [by] if isinstance(by, str) else list(by)
    if missing := [k for k in keys if k not in shared]:
        raise TubeError(f"[merge]> by: {', '.join(missing)} isn't in both")
    clash = [n for n in shared if n not in keys]
    left = x.select(*[c(n).alias(f"{n}.x") if n in clash else c(n) for n in x.columns])
    right = y.select(*[c(n).alias(f"{n}.y") if n in clash else c(n) for n in y.columns])
    joined = null_safe_join(left, right, keys, how)
    rest = [n for n in joined.columns if n not in keys]
    out = joined.select(*map(c, keys), *map(c, rest))
    if not keys:
        return out
    key = F.concat_ws("\r", *[na_text(c(k), "text" if kind_of(field(out, k)) == "factor" else kind_of(field(out, k))) for k in keys])
    return out.orderBy(key)
