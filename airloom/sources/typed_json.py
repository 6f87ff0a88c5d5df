"""Typed JSON: a node says its R type and, beside the values, which places are missing. Small files, read on the driver."""

from __future__ import annotations

import gzip
import json
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, types as T

from airloom.session import TubeError

_TYPES = {"double": T.DoubleType(), "numeric": T.DoubleType(), "integer": T.IntegerType(), "logical": T.BooleanType(), "character": T.StringType(), "factor": T.StringType(), "Date": T.DateType(), "POSIXct": T.TimestampNTZType()}


def _values(node: dict) -> list:
    kind = node["rtype"]
    raw = node.get("values", [])
    raw = raw if isinstance(raw, list) else [raw]
    gone = node.get("na") or []
    gone = {k - 1 for k in (gone if isinstance(gone, list) else [gone])}
    out = []
    for k, v in enumerate(raw):
        if k in gone or v is None or v in ("NA", "NaN") and kind != "character":
            out.append(None)
        elif kind in ("double", "numeric"):
            out.append({"Inf": float("inf"), "-Inf": float("-inf")}.get(v) if isinstance(v, str) and "Inf" in v else float(v))
        elif kind == "integer":
            out.append(int(v))
        elif kind == "logical":
            out.append(v if isinstance(v, bool) else str(v).upper() in ("TRUE", "T", "1"))
        elif kind == "factor":
            out.append(node["levels"][int(v) - 1] if not isinstance(v, str) else v)
        elif kind == "Date":
            out.append(date(1970, 1, 1) + timedelta(days=int(float(v) // 1)))
        elif kind == "POSIXct":
            out.append(datetime(1970, 1, 1) + timedelta(seconds=float(v)))
        else:
            out.append(str(v))
    return out


def load_value(spark: SparkSession, node):
    """A frame, a column as a list, a matrix as rows, or a list or dict of such."""
    if isinstance(node, list):
        return [load_value(spark, n) for n in node]
    if not isinstance(node, dict):
        return node
    kind = node.get("rtype")
    if kind == "data.frame":
        return _frame(spark, node)
    if kind == "matrix":
        n, m = node["dim"]
        flat = _values({**node, "rtype": node.get("type", "double")})
        return [[flat[j * n + i] for j in range(m)] for i in range(n)]
    if kind == "list":
        values = [load_value(spark, n) for n in node.get("values", [])]
        return dict(zip(node["names"], values, strict=True)) if node.get("names") else values
    if kind in _TYPES:
        return _values(node)
    if kind is None:
        return {k: load_value(spark, v) for k, v in node.items()}
    raise TubeError(f"typed JSON of kind {kind!r} isn't supported")


def _frame(spark: SparkSession, node: dict) -> DataFrame:
    names, nodes = node["names"], node["columns"]
    fields = []
    for name, col in zip(names, nodes, strict=True):
        if col["rtype"] not in _TYPES:
            raise TubeError(f"column {name!r}: kind {col['rtype']!r} isn't supported")
        meta = {"levels": col["levels"], "ordered": bool(col.get("ordered"))} if col["rtype"] == "factor" else {}
        fields.append(T.StructField(name, _TYPES[col["rtype"]], True, meta))
    return spark.createDataFrame(list(zip(*map(_values, nodes), strict=True)), T.StructType(fields))


def read_rjson(spark: SparkSession, path: str):
    """Reads a typed JSON file, gzipped or not."""
    try:
        with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8") as f:
            return load_value(spark, json.load(f))
    except FileNotFoundError as e:
        raise TubeError(f"no typed JSON file at {path}") from e
