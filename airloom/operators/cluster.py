"""Clustering of sites by their series: features and the sites' distances in Spark, medoids from passes over these."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from airloom.functions.expressions import attach
from airloom.operators.tagging import tag_tube_required
from airloom.session import TubeError, c, null_safe_join

#: Bytes of the sites' distances that the driver takes itself; beyond that each pass over them is a job.
LOCAL_BYTES = 64 << 20
#: Bytes of the distinct sites' series that the driver takes and sends to all tasks; beyond that features are made for all sites.
TABLE_BYTES = 64 << 20
#: Bytes of a row of stored distances, about: the JVM holds some of each task for seconds after it.
STRIP_BYTES = 256 << 10
#: Bytes of the features of a block of sites, at most (a block has a site at least).
BLOCK_BYTES = 24 << 20
#: Sites that are compared at once with those of another part.
PAIR_BLOCK = 256
#: Parts that the sites are dealt into where all pairs are made, where there are as many blocks; each row goes to as many tasks.
PAIR_PARTS = 16
#: Rows of a batch of pairs.
BATCH_ROWS = 1 << 16


def site_series(df: DataFrame, tube: str = ".value", by: str = "site", date: str = ".date", extra: list[str] | None = None, steady: bool = False, **options) -> DataFrame:
    """site, date, v: the mean of each site and date (and what ``extra`` terms tell apart), missing ones left out.

    ``steady`` adds the values up in their order, so that sites with equal values have means equal in every bit."""
    terms = list(extra or [])
    d = attach(tag_tube_required(df, [tube, by, date, *terms], **options), [tube, by, *terms], on_error="stop<<cluster_tube_data>>tube")
    when = F.concat_ws("|", c(date).cast("string"), *[F.coalesce(c(t).cast("string"), F.lit("NA")) for t in terms]) if terms else c(date)
    d = d.where(c(date).isNotNull())
    return d.groupBy(c(by).cast("string").alias("site"), when.alias("date")).agg((in_order(c(tube)) if steady else F.avg(c(tube))).alias("v")).where("site is not null and date is not null and v is not null")


def in_order(v):
    """The mean of a column as an aggregate whose bits don't depend on the order of the rows."""
    total = F.aggregate(F.array_sort(F.collect_list(v.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.count(v))


def wide(series: DataFrame) -> DataFrame:
    """The series with a column per site; Spark refuses more columns than spark.sql.pivotMaxValues."""
    return series.groupBy("date").pivot("site").agg(F.avg("v")).orderBy("date")


def wide_rows(series: DataFrame) -> DataFrame:
    """The series with a row per date and its sites' values as a map, for any number of sites."""
    at = series.groupBy("date", "site").agg(F.avg("v").alias("v"))
    return at.groupBy("date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", "v")))).alias("sites"))


def check_sites(series: DataFrame, max_sites: int | None = None) -> int:
    """How many sites there are: what is made of their pairs is as large as the square of their number."""
    return allow_sites(series.select("site").distinct().count(), max_sites)


def allow_sites(n: int, max_sites: int | None) -> int:
    if max_sites is not None and n > max_sites:
        raise TubeError(f"[cluster_tube_data]> more than {max_sites} sites; allow more with max_sites")
    return n


def correlation(x: str, y: str):
    """The correlation of two columns as an aggregate; NULL where one of them doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def extent(series: DataFrame) -> tuple[int, list[str]]:
    """How many sites there are, and their dates as text, in order."""
    got = series.agg(F.count_distinct("site").alias("n"), F.collect_set(F.col("date").cast("string")).alias("dates")).first()
    return got.n, sorted(got.dates)


def site_table(series: DataFrame, dates: list[str], parts: int) -> DataFrame:
    """own, site, x: each site's values at all dates, 8 bytes each and NaN where missing, and the part it is dealt to."""
    width = len(dates)
    numbered = F.broadcast(series.sparkSession.createDataFrame(list(zip(dates, range(width), strict=True)), "date string, k int"))
    rows = series.select("site", F.col("date").cast("string").alias("date"), "v").join(numbered, "date")

    def dense(key, group):
        import pandas as pd

        at, sites = pd.factorize(group["site"])
        x = np.full((len(sites), width), np.nan)
        x[at, group["k"].to_numpy()] = group["v"]
        return pd.DataFrame({"own": int(key[0]), "site": sites, "x": [row.tobytes() for row in x]})

    rows = rows.select(F.pmod(F.xxhash64("site"), F.lit(parts)).alias("own"), "site", "k", "v")
    return rows.groupBy("own").applyInPandas(dense, "own bigint, site string, x binary")


def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows less their means, 0 where missing, and 1 for each value that is there."""
    known = ~np.isnan(x)
    mean = np.where(known, x, 0.0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
    return np.where(known, x - mean[:, None], 0.0), known.astype(float)


def correlations(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The correlation of each row of x with each of y over what both have (p and q), 0 without one, and how much that is."""
    shared = p @ q.T
    n, sx, sy = np.maximum(shared, 1), x @ q.T, p @ y.T
    xx, yy = (x * x) @ q.T, p @ (y * y).T
    vx, vy = xx - sx * sx / n, yy - sy * sy / n
    varies = (vx > 1e-12 * xx) & (vy > 1e-12 * yy)
    return np.where(varies, (x @ y.T - sx * sy / n) / np.sqrt(np.where(varies, vx * vy, 1.0)), 0.0), shared


def _pair_batches(a: pa.Array, b: pa.Array, d: np.ndarray, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """a, b, d of all wanted pairs (or all), a's rows one after the other, in batches."""
    step, every, repeated = max(1, BATCH_ROWS // max(1, len(b))), np.arange(len(b)), None
    for at in range(0, len(a) if len(b) else 0, step):
        count = min(step, len(a) - at)
        if repeated is None or len(repeated) != count * len(b):
            repeated = b.take(pa.array(np.tile(every, count)))
        batch = pa.RecordBatch.from_arrays([a.take(pa.array(np.repeat(np.arange(at, at + count), len(b)))), repeated, pa.array(d[at:at + count].ravel())], ["a", "b", "d"])
        yield batch if wanted is None else batch.filter(pa.array(wanted[at:at + count].ravel()))


def correlation_distance(series: DataFrame, max_sites: int | None = None, shared: bool = False) -> DataFrame:
    """a, b, d = 1 - correlation of each pair of sites over their shared dates; 1 where there is none, or no row if
    ``shared``.

    Sites are dealt into parts as rows of numbers; each pair of parts is one task, which makes its part of the matrix by
    products of blocks and hands it on in batches. Each row goes to as many tasks as there are parts: ``PAIR_PARTS``,
    more only where the tasks or the rows are many, so what is shuffled grows with the sites, not with their pairs."""
    n, dates = extent(series)
    allow_sites(n, max_sites)
    blocks, block = -(-n // PAIR_BLOCK) or 1, PAIR_BLOCK
    cores = series.sparkSession.sparkContext.defaultParallelism
    parts = min(blocks, max(PAIR_PARTS, math.isqrt(8 * cores), 8 * n * len(dates) // BLOCK_BYTES))
    last = F.lit(parts - 1).cast("bigint")
    sent = site_table(series, dates, parts).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    sent = sent.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "site", "x")

    def part(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (k.as_py() for k in key)
        sides = {i: ([], []), j: ([], [])}
        for batch in batches:
            for own, site, x in zip(*(batch.column(n).to_pylist() for n in ("own", "site", "x")), strict=True):
                sides[own][0].append(site)
                sides[own][1].append(x)
        named = {own: pa.array(sites, pa.string()) for own, (sites, _) in sides.items()}
        values = {own: centred(np.frombuffer(b"".join(x)).reshape(len(x), -1)) for own, (_, x) in sides.items() if x}
        if len(values) < len(sides):
            return
        for at in range(0, len(named[i]), block):
            r, together = correlations(*(v[at:at + block] for v in values[i]), *values[j])
            d, wanted = 1 - r, together > 0 if shared and (together == 0).any() else None
            names = named[i].slice(at, block)
            yield from _pair_batches(names, named[j], d, wanted)
            if i != j:
                yield from _pair_batches(named[j], names, d.T, None if wanted is None else wanted.T)

    return sent.repartition(parts * (parts + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(part, "a string, b string, d double")


def related(distances: DataFrame) -> DataFrame:
    """The distances of sites that aren't at 1 from all, their own included."""
    kept = distances.where("d <> 1").select("a").distinct()
    return distances.join(kept, "a").join(kept.withColumnRenamed("a", "b"), "b").select("a", "b", "d")


def scaled(series: DataFrame, method: int) -> DataFrame:
    """Methods 1 raw, 3 between least and most, 4 in standard deviations, 5 by the mean; site, date, v."""
    site = Window.partitionBy("site")
    v = F.col("v")
    lo, hi = F.min("v").over(site), F.max("v").over(site)
    out = {1: v, 3: F.try_divide(v - lo, hi - lo), 4: F.try_divide(v - F.avg("v").over(site), F.stddev_samp("v").over(site)), 5: F.try_divide(v, F.avg("v").over(site))}
    return series.select("site", "date", out[method].alias("v"))


def trend(series: DataFrame) -> DataFrame:
    """Method 6: site and v = 1 - correlation of its values with the time left until the last date, in steps of the
    dates there are; sites without a correlation go. The dates are numbered in one task, a row a date."""
    last = Window.orderBy(F.desc("date"))
    steps = series.select("date").distinct().withColumn("left", (F.row_number().over(last) - 1).cast("double"))
    return series.join(steps, "date").groupBy("site").agg(correlation("v", "left").alias("r")).where("r is not null").select("site", (1 - F.col("r")).alias("v"))


def distances_of(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of the rows of x to those of y (or x), from the differences themselves; 64 rows at a time."""
    y = x if y is None else y
    out = np.zeros((len(x), len(y)))
    for j, row in enumerate(y):
        for at in range(0, len(x), 64):
            gap = x[at:at + 64] - row
            out[at:at + 64, j] = np.sqrt((gap * gap).sum(axis=1))
    return out


class Distances:
    """Distances of n rows that the driver has, as ``medoids`` asks for them; a row stands for ``times`` equal ones."""

    def __init__(self, d: np.ndarray, times: np.ndarray | None = None):
        self.d, self.n, self.times = d, len(d), times

    def row(self, at: int) -> np.ndarray:
        return self.d[at]

    def totals(self, rest: np.ndarray) -> np.ndarray:
        """Of each row the sum over all rows of the lesser of ``rest`` and the distance to it."""
        least = np.minimum(self.d, rest)
        return least.sum(axis=1) if self.times is None else least @ self.times


class StoredDistances:
    """The same of strips of rows that Spark holds (first, d: a block of rows by all rows), read by a job a pass."""

    times = None

    def __init__(self, strips: DataFrame, n: int):
        self.strips, self.n = strips, n

    def row(self, at: int) -> np.ndarray:
        strip = self.strips.where((F.col("first") <= at) & (F.col("first") + F.col("rows") > at))
        wanted = strip.select(F.expr(f"substring(d, ({at} - first) * {8 * self.n} + 1, {8 * self.n})").alias("d"))
        return np.frombuffer(bytes(wanted.first().d), float)

    def totals(self, rest: np.ndarray) -> np.ndarray:
        n = self.n

        def part(batches):
            import pandas as pd

            for batch in batches:
                sums = [np.minimum(np.frombuffer(d, float).reshape(-1, n), rest).sum(axis=1).tobytes() for d in batch["d"]]
                yield pd.DataFrame({"first": batch["first"], "t": sums})

        got = self.strips.select("first", "d").mapInPandas(part, "first bigint, t binary").collect()
        return np.concatenate([np.frombuffer(bytes(r.t), float) for r in sorted(got, key=lambda r: r.first)])


class StoredPairs:
    """The same of blocks of ``size`` rows by as many that Spark holds for i <= j only, in strips of rows (i, j, at, d:
    from row ``at`` of the block on), read by a job a pass."""

    def __init__(self, strips: DataFrame, n: int, size: int, times: np.ndarray):
        self.strips, self.n, self.size, self.times = strips, n, size, times

    def _joined(self, part, wanted: DataFrame) -> np.ndarray:
        """The sums of what part gives for blocks of rows, over the blocks that they meet, always in one order."""
        n, size = self.n, self.size

        def read(batches):
            import pandas as pd

            sums = {}
            for batch in batches:
                for i, j, at, d in zip(batch["i"], batch["j"], batch["at"], batch["d"], strict=True):
                    for to, by, first, v in part(i, j, at, np.frombuffer(d, float).reshape(-1, min(size, n - j * size))):
                        if (to, by) not in sums:
                            sums[to, by] = np.zeros(min(size, n - to * size))
                        sums[to, by][first:first + len(v)] += v
            yield pd.DataFrame([(to, by, v.tobytes()) for (to, by), v in sums.items()], columns=["to", "by", "v"])

        out = np.zeros(n)
        for r in sorted(wanted.mapInPandas(read, "to int, by int, v binary").collect(), key=lambda r: (r.to, r.by)):
            out[r.to * size:(r.to + 1) * size] += np.frombuffer(bytes(r.v), float)
        return out

    def row(self, at: int) -> np.ndarray:
        block, place = divmod(at, self.size)

        def part(i, j, first, d):
            if i == block:
                return [(j, i, 0, d[place - first])] if 0 <= place - first < len(d) else []
            return [(i, j, first, d[:, place])]

        return self._joined(part, self.strips.where((F.col("i") == block) | (F.col("j") == block)))

    def totals(self, rest: np.ndarray) -> np.ndarray:
        size, times = self.size, self.times

        def part(i, j, first, d):
            at = i * size + first
            one, two = slice(at, at + len(d)), slice(j * size, (j + 1) * size)
            out = [(i, j, first, np.minimum(d, rest[two]) @ times[two])]
            return out if i == j else [*out, (j, i, 0, np.minimum(d.T, rest[one]) @ times[one])]

        return self._joined(part, self.strips)


def pam(x: np.ndarray, k: int, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Medoids and labels of the rows of x."""
    return medoids(Distances(distances_of(x)), k, sweeps)


def medoids(d, k: int, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Medoids and labels of rows by their distances: the medoids come greedily, then rows are swapped in while that helps.

    Ties go to the row that comes first. A sweep goes through the medoids and, for each, through the rows in order; a
    row that lowers the cost takes the place at once. Labels are the places of the medoids. Of rows that stand for
    several equal ones, no more are medoids than there are."""
    n, k = d.n, min(k, d.n)
    if k >= n and d.times is None:
        return np.arange(n), np.arange(n)
    summed = (lambda v: v.sum()) if d.times is None else (lambda v: v @ d.times)
    chosen = [int(d.totals(np.full(n, np.inf)).argmin())]
    to = {chosen[0]: d.row(chosen[0])}
    while len(chosen) < k:
        total = d.totals(np.min([to[m] for m in chosen], axis=0)).copy()
        total[chosen] = np.inf
        chosen.append(int(total.argmin()))
        to[chosen[-1]] = d.row(chosen[-1])
    cost = summed(np.min([to[m] for m in chosen], axis=0))
    for _ in range(sweeps):
        before = cost
        for place in range(k):
            others = [m for j, m in enumerate(chosen) if j != place]
            total = d.totals(np.min([to[m] for m in others], axis=0) if others else np.full(n, np.inf)).copy()
            total[others] = np.inf
            gain = 1e-12 * max(1.0, cost)  # of large sums no more is certain
            for row in np.flatnonzero(total < cost - gain):
                if total[row] < cost - gain:
                    chosen[place], cost = int(row), total[row]
            if chosen[place] not in to:
                to = {m: to[m] for m in others} | {chosen[place]: d.row(chosen[place])}
        if cost == before:
            break
    return np.array(chosen), np.stack([to[m] for m in chosen]).argmin(axis=0)


def features(series: DataFrame, method: int, max_sites: int | None = None) -> DataFrame:
    """site, key, v rows that describe each site for a method 1 to 6."""
    if method == 2:
        return related(correlation_distance(series, max_sites)).selectExpr("a as site", "b as key", "d as v")
    if method == 6:
        return trend(series).selectExpr("site", "'trend' as key", "v")
    return scaled(series, method).selectExpr("site", "cast(date as string) as key", "v")


def cluster_tube_data(df: DataFrame, tube: str = ".value", by="site", clusters: int = 2, method: int = 2, rename: str = ".cluster", output: str | None = None, max_sites: int | None = None, **options) -> DataFrame:
    """Adds each site's cluster, 1 to ``clusters``; sites without features go.

    ``by`` names the site; further terms tell dates apart. output="common.data" gives the wide series and "data" the
    features; "common.rows" is the wide series with a map of the sites, for any number of them. The sites' distances
    stay in Spark where they are many; work and disk grow with the square of the sites times their features.
    ``max_sites`` refuses more sites than that."""
    if method not in range(1, 7):
        raise TubeError("[cluster_tube_data]> method must be 1 to 6")
    keys = [by] if isinstance(by, str) else list(by)
    paired = method == 2 and output is None
    series = site_series(df, tube, keys[0], extra=keys[1:], steady=paired, **options)
    if output == "common.data":
        return wide(series)
    if output == "common.rows":
        return wide_rows(series)
    label = correlation_labels(series, clusters, max_sites) if paired else None
    if label is None:
        rows = features(series, method, max_sites).where("v is not null")
        if output == "data":
            return rows
        if max_sites is not None:
            check_sites(series, max_sites)
        label = labels(rows, clusters)
    found = df.sparkSession.createDataFrame([(site, str(la + 1)) for site, la in label], "site string, label string")
    d = attach(tag_tube_required(df, keys, **options), keys)
    kind = dict(d.dtypes)[keys[0]]
    named = found.select(F.col("site").cast(kind).alias(keys[0]), F.col("label").alias(rename, metadata={"levels": [str(k) for k in range(1, clusters + 1)], "ordered": False}))
    return null_safe_join(d.drop(rename), named, [keys[0]])


def profile_distances(x: np.ndarray, p: np.ndarray, times: np.ndarray, one: slice, two: slice, step: int = 512) -> np.ndarray:
    """Euclidean distances of rows by their correlations with all rows, each counted ``times``; of rows one to rows two.

    From products; those of rows much alike, where these would cancel, from the differences themselves."""

    def profiles():
        for at in range(0, len(x), step):
            to = slice(at, at + step)
            left = correlations(x[one], p[one], x[to], p[to])[0]
            yield left, left if one == two else correlations(x[two], p[two], x[to], p[to])[0], times[to]

    a, b, product = np.zeros(len(x[one])), np.zeros(len(x[two])), np.zeros((len(x[one]), len(x[two])))
    for left, right, count in profiles():
        a += (left * left) @ count
        b += (right * right) @ count
        product += left @ (right * count).T
    size = a[:, None] + b
    square = size - 2 * product
    near = np.argwhere(square < 1e-3 * size)
    if one == two:
        square, near = np.triu(square, 1), near[near[:, 0] < near[:, 1]]
    if len(near):
        sums = np.zeros(len(near))
        for left, right, count in profiles():
            for at in range(0, len(near), 1024):
                i, j = near[at:at + 1024].T
                sums[at:at + 1024] += (left[i] - right[j]) ** 2 @ count
        square[near[:, 0], near[:, 1]] = sums
    d = np.sqrt(np.maximum(square, 0.0))
    return d + d.T if one == two else d


def correlation_labels(series: DataFrame, clusters: int, max_sites: int | None = None) -> list[tuple[str, int]] | None:
    """Each site with the place of its medoid, sites described by their correlations with all; None beyond ``TABLE_BYTES``.

    Sites with equal series (in every bit) are one that counts as often. The driver takes the series of these and the
    sites' names, and sends the series to all tasks; a task makes the correlations of two blocks of sites with all, a
    few at a time, and their distances, so only these are kept: half of their matrix, or the driver's up to
    ``LOCAL_BYTES``."""
    from pyspark import StorageLevel

    series = series.persist(StorageLevel.MEMORY_AND_DISK)
    table = None
    try:
        n, dates = extent(series)
        allow_sites(n, max_sites)
        first = F.min("site").over(Window.partitionBy("x"))
        table = site_table(series, dates, -(-n // 1024) or 1).select("site", "x", first.alias("first")).persist(StorageLevel.MEMORY_AND_DISK)
        stands = {r.site: r.first for r in table.select("site", "first").collect()}
        if 8 * len(set(stands.values())) * len(dates) > TABLE_BYTES:
            return None
        got = sorted((r.site, bytes(r.x)) for r in table.where("site = first").select("site", "x").collect())
    finally:
        for held in (table, series):
            if held is not None:
                held.unpersist()
    if not got:
        return []
    raw = np.frombuffer(b"".join(x for _, x in got)).reshape(len(got), -1)
    x, p = centred(raw)
    own, total = (x * x).sum(axis=1), x.sum(axis=1)
    varies = own - total * total / np.maximum(p.sum(axis=1), 1) > 1e-12 * own
    raw, kept = raw[varies], [site for (site, _), v in zip(got, varies, strict=True) if v]
    place = {site: k for k, site in enumerate(kept)}
    sites = sorted(site for site, head in stands.items() if head in place)
    if clusters >= len(sites):
        return [(site, k) for k, site in enumerate(sites)]
    times = np.bincount([place[stands[site]] for site in sites], minlength=len(kept)).astype(float)
    size = max(PAIR_BLOCK, min(8 * PAIR_BLOCK, -(-len(kept) // 16)))
    local = 8 * len(kept) ** 2 <= LOCAL_BYTES
    strips = _profile_strips(series.sparkSession, raw, times, size).persist(StorageLevel.MEMORY_AND_DISK if local else StorageLevel.DISK_ONLY)
    try:
        d = StoredPairs(strips, len(kept), size, times)
        if local:
            whole = np.zeros((len(kept), len(kept)))
            for r in strips.collect():
                part = np.frombuffer(bytes(r.d), float).reshape(-1, min(size, len(kept) - r.j * size))
                one, two = slice(r.i * size + r.at, r.i * size + r.at + len(part)), slice(r.j * size, (r.j + 1) * size)
                whole[one, two], whole[two, one] = part, part.T
            d = Distances(whole, times)
        label = medoids(d, clusters)[1]
    finally:
        strips.unpersist()
    return [(site, int(label[place[stands[site]]])) for site in sites]


def _profile_strips(spark, raw: np.ndarray, times: np.ndarray, size: int) -> DataFrame:
    """i, j, at, d: the distances of blocks of rows i <= j by their correlations, in strips of ``STRIP_BYTES``.

    Tasks are as many as blocks of 16 MB of these, or two a core if that is more, and no more than pairs of blocks."""
    blocks, bytes_ = -(-len(raw) // size), STRIP_BYTES
    numbered = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    tasks = min(len(numbered), max(4 * len(raw) ** 2 >> 24, 2 * spark.sparkContext.defaultParallelism))

    def compared(batches):
        import pandas as pd

        x, p = centred(raw)
        for batch in batches:
            for at in batch["id"]:
                i, j = numbered[at]
                d = profile_distances(x, p, times, *(slice(k * size, (k + 1) * size) for k in (i, j)))
                step = max(1, bytes_ // (8 * d.shape[1]))
                starts = range(0, len(d), step)
                yield pd.DataFrame({"i": i, "j": j, "at": starts, "d": [d[k:k + step].tobytes() for k in starts]})

    return spark.range(0, len(numbered), 1, tasks).mapInPandas(compared, "i int, j int, at int, d binary")


def labels(rows: DataFrame, clusters: int) -> list[tuple[str, int]]:
    """Each site of the features with the place of its medoid; missing features are 0.

    Sites are dealt in order into blocks; a task compares two of them from their features, and the results make strips
    of the matrix of distances. The driver holds the sites' names and some rows of the matrix, all of it only up to
    ``LOCAL_BYTES``."""
    from pyspark import StorageLevel

    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sites = sorted(r.site for r in rows.select("site").distinct().collect())
        keys = sorted(r.key for r in rows.select("key").distinct().collect())
        if not sites:
            return []
        strips = _strips(rows, sites, keys).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if 8 * len(sites) ** 2 <= LOCAL_BYTES:
                got = sorted(strips.collect(), key=lambda r: r.first)
                d = Distances(np.concatenate([np.frombuffer(bytes(r.d), float).reshape(-1, len(sites)) for r in got]))
            else:
                d = StoredDistances(strips, len(sites))
            return list(zip(sites, medoids(d, clusters)[1].tolist(), strict=True))
        finally:
            strips.unpersist()
    finally:
        rows.unpersist()


def _strips(rows: DataFrame, sites: list[str], keys: list[str]) -> DataFrame:
    """first, rows, d: the distances of a block of sites, the first of them and their number, to all sites."""
    spark, n, width = rows.sparkSession, len(sites), len(keys)
    size = max(1, min(2 * PAIR_BLOCK, BLOCK_BYTES // (8 * width)))
    blocks = -(-n // size)
    numbered = lambda names, name, at: F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{name} string, {at} int"))
    long = rows.join(numbered(sites, "site", "r"), "site").join(numbered(keys, "key", "k"), "key")
    long = long.select((F.col("r") / size).cast("int").alias("own"), "r", "k", "v")

    def dense(key, group):
        import pandas as pd

        first = int(key[0]) * size
        table = np.zeros((min(size, n - first), width))
        table[group["r"].to_numpy() - first, group["k"].to_numpy()] = group["v"]
        return pd.DataFrame({"own": [int(key[0])], "x": [table.tobytes()]})

    tables = long.groupBy("own").applyInPandas(dense, "own int, x binary")
    one = tables.withColumn("other", F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))))
    two = tables.selectExpr("own as theirs", "x as y").withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("theirs"))))

    def compared(key, left, right):
        import pandas as pd

        x, y = (np.frombuffer(t.iloc[0], float).reshape(-1, width) for t in (left["x"], right["y"]))
        d, (a, b) = distances_of(x, y), (int(key[0]), int(key[1]))
        sides = [(a, b, d)] if a == b else [(a, b, d), (b, a, d.T)]
        return pd.DataFrame([(i, j, part.tobytes()) for i, j, part in sides], columns=["i", "j", "d"])

    parts = one.groupBy("own", "other").cogroup(two.groupBy("mine", "theirs")).applyInPandas(compared, "i int, j int, d binary")

    def strip(key, group):
        import pandas as pd

        count = min(size, n - int(key[0]) * size)
        d = np.concatenate([np.frombuffer(v, float).reshape(count, -1) for v in group.sort_values("j")["d"]], axis=1)
        return pd.DataFrame({"first": [int(key[0]) * size], "rows": [count], "d": [d.tobytes()]})

    return parts.groupBy("i").applyInPandas(strip, "first bigint, rows int, d binary")
