"""Streams of measurements: stateless tags, windowed statistics with late data, and coverage kept per place."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from airloom.functions.expressions import Compiler
from airloom.functions.statistics import as_stat
from airloom.session import c


def windowed_stat(events: DataFrame, value: str, time: str, by=(), width: str = "1 day", late: str = "1 hour", stat=None) -> DataFrame:
    """Statistics of ``value`` in tumbling windows, per key; rows later than ``late`` behind are left out of a stream.

    The same plan runs on a bounded frame, where nothing is late."""
    stat = as_stat(stat)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    keys = [by] if isinstance(by, str) else list(by)
    aggregates: list[Column] = [column.alias(label) for label, column, _ in stat.columns(c(value), value)]
    grouped = rows.groupBy(F.window(c(time), width).alias("__w"), *map(c, keys)).agg(*aggregates)
    rest = [n for n in grouped.columns if n != "__w" and n not in keys]
    return grouped.select(F.col("__w.start").alias(".start"), F.col("__w.end").alias(".end"), *map(c, keys), *map(c, rest))


def where_term(events: DataFrame, text: str) -> DataFrame:
    """Rows for which an expression holds; whole-column scalars aren't possible in a stream."""
    return events.where(Compiler(events).compile(text).truth())


def running_coverage(events: DataFrame, key: str, day: str, late: str = "1 day") -> DataFrame:
    """key, days: how many different days each key has been seen on, updated as the stream goes.

    A key's state is its days as ranges, so it grows with the gaps in them and not with the rows."""
    rows = events.select(c(key).cast("string").alias("key"), c(day).cast("timestamp").alias("at")).withWatermark("at", late)

    def update(group: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        spans = list(state.get[0]) if state.exists else []
        seen: set[int] = set()
        for frame in frames:
            seen.update((frame["at"].dropna().astype("datetime64[ns]").astype("int64") // 86_400_000_000_000).tolist())
        spans = merge_days([(a, b) for a, b in zip(spans[0::2], spans[1::2], strict=True)] + [(d, d) for d in seen])
        state.update(([v for s in spans for v in s],))
        yield pd.DataFrame({"key": [group[0]], "days": [sum(b - a + 1 for a, b in spans)]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return rows.groupBy("key").applyInPandasWithState(update, "key string, days long", "spans array<long>", "update", GroupStateTimeout.NoTimeout)


def merge_days(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of days joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
