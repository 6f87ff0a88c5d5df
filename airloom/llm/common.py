"""Pieces shared by the training-data operators: word hashing, arrow batches, bounded label samples."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The ASCII white space that separates words.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[list(SPACES)] = 0
_LONG_WORD = 4096
_POW = np.multiply.accumulate(np.full(_LONG_WORD, 0x9E3779B97F4A7C55, np.uint64))
_PIECE = 1 << 22


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in parts of bounded size, cut at white space where there is any."""
    at = 0
    while len(raw) - at > _PIECE:
        end = max(raw.rfind(b" ", at + 1, at + _PIECE), raw.rfind(b"\n", at + 1, at + _PIECE))
        if end < 0:
            nexts = [e for e in (raw.find(b" ", at + _PIECE), raw.find(b"\n", at + _PIECE)) if e >= 0]
            end = min(nexts, default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where each word starts and ends."""
    space = np.concatenate(([True], _IS_SPACE[np.frombuffer(raw, np.uint8)], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; words are maximal runs without ASCII white space."""
    found = []
    for part in _pieces(raw):
        starts, ends = word_bounds(part)
        if not len(starts):
            continue
        buf = np.frombuffer(part, np.uint8)[starts[0]:]
        starts, ends = starts - starts[0], ends - starts[0]
        long = int((ends - starts).max()) > _LONG_WORD
        at = np.arange(len(buf), dtype=np.int32)
        at -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(buf))))
        if long:
            at &= _LONG_WORD - 1
        else:
            np.minimum(at, _LONG_WORD - 1, out=at)
        hashes = np.add.reduceat(_BYTE[buf] * _POW[at], starts) + (ends - starts).astype(np.uint64)
        if long:  # the powers repeat there, so these words get a digest
            for k in np.flatnonzero(ends - starts > _LONG_WORD):
                hashes[k] = np.frombuffer(hashlib.blake2b(bytes(buf[starts[k]:ends[k]]), digest_size=8).digest(), np.uint64)[0]
        found.append(mix64(hashes))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` words; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    width_used = min(width, len(words))
    n = len(words) - width_used + 1
    out = np.full(n, width_used, np.uint64)
    for k in range(width_used):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n])
    return out


def raw_texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    """The texts of a batch as UTF-8 bytes, one at a time."""
    values = batch.column(column)
    values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return (v.as_py() for v in values)


#: Arrow batches hold at most this much, so that a task's memory doesn't grow with the length of its texts.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, its session set to send batches of at most BATCH_BYTES to Python (a lower setting is kept)."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(key)) or 0) > BATCH_BYTES or not conf.get(key).rstrip("b").isdigit():
        conf.set(key, str(BATCH_BYTES))
    return df


def released() -> None:
    """Gives memory that a task has freed back to the machine: workers stay for later tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def driver_released(spark) -> None:
    """The same on the driver, its JVM included, before a fit takes memory there."""
    spark.sparkContext._jvm.System.gc()
    released()


#: Entries that a step of a fit works on at once, so that its temporary arrays stay small.
FIT_BLOCK = 1 << 18


def slices(n: int) -> list[slice]:
    """Places 0 to ``n`` in blocks of FIT_BLOCK."""
    return [slice(k, min(k + FIT_BLOCK, n)) for k in range(0, n, FIT_BLOCK)]


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over bounded batches, with the memory given back at each task's end."""

    def task(batches):
        yield from run(batches)
        released()

    return bounded_batches(df).mapInArrow(task, schema)


def in_batches(df: DataFrame, score: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Applies ``score`` to each arrow batch; it returns columns by name, in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cols = score(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, schema)


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as remainder -1."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % by, F.lit(-1))


#: Text that a fit reads at most, all sampled rows together.
SAMPLE_BYTES = 32 << 20


def bounded_ids(rows: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """At most ``max_rows`` rows of (doc_id, y, rank), chosen by a hash of the id: the documented bound of every fit.

    Duplicate ids count once, with their largest label. Only ids whose hash lies below a threshold are ordered; it is
    raised until enough are found, so the choice is that of the smallest hashes whatever the size."""
    spark, h = rows.sparkSession, F.xxhash64(F.lit(seed), "doc_id")
    rows = rows.where("doc_id is not null and y is not null").select("doc_id", "y", h.alias("h"))
    share = min(1.0, 2.0 * max_rows / max(rows.count(), 1))
    while True:
        below = rows if share >= 1 else rows.where(F.col("h") < -(1 << 63) + int(share * 2**64))
        found = below.groupBy("doc_id", "h").agg(F.max("y").alias("y")).orderBy("h", "doc_id").limit(max_rows).collect()
        if share >= 1 or len(found) >= max_rows:
            break
        share = min(1.0, 4 * share)
    kind = rows.schema["y"].dataType.simpleString()
    return spark.createDataFrame([(r.doc_id, r.y, k) for k, r in enumerate(found)], f"doc_id bigint, y {kind}, rank int")


def sample_with_text(docs: DataFrame, ids: DataFrame, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, y of the sampled rows; ``ids`` has a bounded number of rows, so it is sent to every task.

    One text of each id is read, that with the smallest hash; null texts are left out, and so are those that would
    bring the texts read, in the sample's order, over ``max_bytes``."""
    texts = docs.select("doc_id", "text").where("text is not null")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")))
    sizes = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "rank").agg(one.alias("one")).collect()  # a row an id
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: r["rank"]):
        if total + r.one.n <= max_bytes:
            total += r.one.n
            chosen.append((r.doc_id, r.y, r.one.h))
    kind = ids.schema["y"].dataType.simpleString()
    named = docs.sparkSession.createDataFrame(chosen, f"doc_id bigint, y {kind}, __h bigint")
    found = texts.withColumn("__h", F.xxhash64("text")).join(F.broadcast(named), ["doc_id", "__h"])
    return found.select("doc_id", "text", "y").dropDuplicates(["doc_id"])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adaptive steps for a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def class_weights_off(y: np.ndarray) -> bool:
    """Whether a sample has only one class, so that nothing can be learned from it."""
    return len(y) == 0 or y.min() == y.max()


def shared_folder(spark) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; set here only where the session has none.

    A machine-local folder is used only when the whole of Spark runs in one process."""
    import tempfile

    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = f"file://{tempfile.gettempdir()}/airloom-shared"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders written for this session that haven't been removed yet.
_written: dict[str, object] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written once to the shared folder and read again: cuts lineage, survives lost executors.

    The folder stays until ``forget``, or until the driver ends."""
    import atexit
    import uuid

    path = f"{shared_folder(df.sparkSession)}/airloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if not _written:
        atexit.register(_remove, _written)
    _written[path] = df.sparkSession
    out._airloom_path = path
    return out


def kept_folder(spark, what: str) -> str:
    """A new folder in the shared one for files that tasks write themselves; it stays until the driver ends."""
    import atexit
    import uuid

    path = f"{shared_folder(spark)}/airloom-{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove, _written)
    _written[path] = spark
    return path


def belongs(frame: DataFrame, to: DataFrame) -> DataFrame:
    """The frame, to be forgotten with the written one that it reads."""
    frame._airloom_path = to._airloom_path
    return frame


def finished(make, what: str) -> DataFrame:
    """The frame that ``make()`` plans, written; what planning it wrote on the way is removed."""
    before = set(_written)
    frame = make()
    between = set(_written) - before
    out = written(frame, what)
    _remove({p: _written.pop(p) for p in between})
    return out


def forget(*frames: DataFrame) -> None:
    """Removes the folders of written frames that nothing will read again."""
    paths = [p for p in (getattr(f, "_airloom_path", None) for f in frames) if p in _written]
    _remove({p: _written.pop(p) for p in paths})


def _remove(paths: dict) -> None:
    for path, spark in paths.items():
        context = spark.sparkContext
        if context._jsc is not None:  # the session may have been stopped
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
