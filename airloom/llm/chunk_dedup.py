"""Operator 4, substring dedup by content-defined chunks.

Method: a gear rolling hash over the last 16 bytes decides at each word start whether a chunk ends there (also
at each line start), so cuts follow the content and an insertion moves only the chunks around it. Chunks are
identified by a digest of their words. What is compared are runs of chunks: from each chunk start, and back from each
chunk end, the shortest run of ``MIN_WORDS`` words or more. The first occurrence of a run in (doc_id, position) order
holds it; later ones are cut out. So every stretch of whole chunks with that many words that stands earlier goes, in
whatever documents its single chunks were seen first; shorter common phrases and lines stay. A text of fewer words is one run,
which meets only other whole texts.

Plan: rows are dealt once, by a hash, into parts of about ``PART_BYTES`` of text. Each part sends every run's digest
once, with its first document, to a bucket of digests; so a passage that a third of the corpus shares is one entry per
part there, and no group grows with its copies. Buckets answer the parts whose runs are held elsewhere, and
each part cuts its own texts. Numbers of parts and buckets follow the measured bytes, and are at least the session's
number of shuffle partitions. Beyond ``SLICE`` parts a bucket is dealt by slices of that many parts: each slice finds
its first holders, the slices' are compared, and each slice then answers its own parts, so that also a digest that
every part holds is never more than SLICE entries, or one a slice, in one task.

Defined results: null texts stay null, empty ones empty; a text copied whole becomes empty in all but the first
document; repeated rows count as copies of the first; rows without doc_id come last in the order; a text of one
endless word is one chunk; an empty table gives no rows. Other columns pass through ``cut_repeats`` unchanged
(n_chars is counted again); ``duplicate_spans`` ignores them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

#: Words from which a stretch that stands earlier is cut out.
MIN_WORDS = 20
PART_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
SLICE = 4096
#: A word start ends a chunk in one of so many cases (a power of two), so chunks have about as many words.
MEAN_WORDS = 4
_GEAR = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 16, 256, dtype=np.uint16)
_NO_ID = np.iinfo(np.int64).max
_STEP = np.uint64(0xA24BAED4963EE407)
_BASE = 0x9FB21C651E98DF25
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte, h = 2 * h + gear[byte] modulo 2**16, which depends on the last 16 bytes only."""
    h = _GEAR[raw]
    for width in (1, 2, 4, 8):
        if len(h) > width:
            longer = h.copy()
            longer[width:] += h[:-width] << np.uint16(width)
            h = longer
    return h


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, number of words and digest of each chunk; a chunk ends where the next one starts."""
    starts, _ = C.word_bounds(raw)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    buf = np.frombuffer(raw, np.uint8)
    before = starts[1:] - 1
    cut = (gear_hash(buf)[before] < (1 << 16) // MEAN_WORDS) | (buf[before] == 10)
    first = np.concatenate(([0], np.flatnonzero(cut) + 1))
    n = np.diff(np.append(first, len(starts)))
    place = (np.arange(len(starts)) - np.repeat(first, n)).astype(np.uint64)
    hashes = C.mix64(C.word_hashes(raw) + (place + np.uint64(1)) * _STEP)
    digests = C.mix64(np.add.reduceat(hashes, first) + n.astype(np.uint64))
    begin = starts[first]
    begin[0] = 0
    return begin, n, digests


def _powers(base, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(min(n, 1), np.uint64), np.full(max(n - 1, 0), base, np.uint64))))


def runs(row: np.ndarray, words: np.ndarray, digests: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, past the last chunk and digest of each run compared, in order; ``row`` tells the texts apart."""
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    to = np.searchsorted(total, total[:-1] + min_words)
    back = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    ahead = np.flatnonzero(to <= n)
    ahead = ahead[row[to[ahead] - 1] == row[ahead]]
    behind = np.flatnonzero(back >= 0)
    behind = behind[(row[back[behind]] == row[behind]) & (to[back[behind]] != behind + 1)]
    lo, hi = np.concatenate((ahead, back[behind])), np.concatenate((to[ahead], behind + 1))
    by = np.lexsort((hi, lo))
    lo, hi = lo[by], hi[by]
    summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digests * _powers(_BASE, n), dtype=np.uint64)))
    return lo, hi, C.mix64((summed[hi] - summed[lo]) * _powers(_BACK, n)[lo] + (hi - lo).astype(np.uint64))


def whole_texts(row: np.ndarray, words: np.ndarray, digests: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts of fewer words, each as one run that meets only other whole texts."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    if not len(first):
        return first, first, digests
    past = np.append(first[1:], len(row))
    few = np.add.reduceat(words, first) < min_words
    place = (np.arange(len(row)) - np.repeat(first, past - first)).astype(np.uint64)
    found = C.mix64(np.add.reduceat(C.mix64(digests + place * _STEP), first) ^ _BACK)
    return first[few], past[few], found[few]


def _stretches(*keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of meeting runs with equal keys begin among the sorted runs, and past their last chunk."""
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, hi[np.append(first[1:], len(lo)) - 1] if len(lo) else hi


def cut_spans(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, holder: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(row, first chunk, past the last chunk, holder) of the stretches that repeated runs cover, without overlaps.

    A holder is named for what it holds beyond larger ones if that comes to ``min_words`` words; less goes to the one beside."""
    by = np.lexsort((hi, lo, row))
    start, end = _stretches(row[by], lo=lo[by], hi=hi[by])
    stretch = np.empty(len(by), np.int64)
    stretch[by] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(by))))
    start, rows = lo[by][start], row[by][start]
    by = np.lexsort((hi, lo, holder, stretch))
    stretch, lo, hi, holder = stretch[by], lo[by], hi[by], holder[by]
    at, past = _stretches(stretch, holder, lo=lo, hi=hi)
    edges = np.searchsorted(stretch[at], np.arange(len(start) + 1))
    lo, holder = lo[at], holder[at]
    total = np.concatenate(([0], np.cumsum(words)))
    found = []
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        mine = np.arange(edges[k], edges[k + 1])
        if len(mine) == 1:
            found.append((int(rows[k]), a, b, int(holder[mine[0]])))
            continue
        owner = np.full(b - a, -1)
        for j in mine[np.argsort(total[lo[mine]] - total[past[mine]], kind="stable")]:
            free = np.flatnonzero(owner[lo[j] - a:past[j] - a] < 0) + lo[j]
            if words[free].sum() >= min_words:
                owner[free - a] = j
        known = np.flatnonzero(owner >= 0)
        owner = owner[known[np.maximum(np.searchsorted(known, np.arange(b - a), side="right") - 1, 0)]]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(holder[owner])) + 1, [b - a]))
        found += [(int(rows[k]), int(a + x), int(a + y), int(holder[owner[x]])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return found


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _part_runs(table: pa.Table):
    """The rows' order by (doc_id, text), their chunks, and for all runs in that order: row, chunks, digest."""
    raw = [x or b"" for x in C.raw_texts(table.combine_chunks().to_batches()[0], "text")] if table.num_rows else []
    ids = _ids(table)
    order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
    parts = [chunks(raw[i]) for i in order]
    row = np.repeat(np.arange(len(order)), [len(p[0]) for p in parts])
    words, digests = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((1, np.int64), (2, np.uint64)))
    lo, hi, found = (np.concatenate(x) for x in zip(runs(row, words, digests), whole_texts(row, words, digests), strict=True))
    by = np.argsort(lo, kind="stable")
    lo, hi, found = lo[by], hi[by], found[by]
    return raw, ids, order, parts, row[lo], lo, hi, found


def _first_places(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(digests, return_index=True, return_inverse=True)


def _send(buckets: int):
    def run(key, table):
        part = key[0].as_py()
        _, ids, order, _, row, _, _, digests = _part_runs(table)
        own, at, _ = _first_places(digests)
        docs = ids[np.array(order, np.int64)][row[at]] if len(own) else np.zeros(0, np.int64)
        bucket = (own >> np.uint64(33)) % np.uint64(buckets)
        by = np.lexsort((docs, bucket))
        own, docs, bucket = own[by], docs[by], bucket[by]
        edges = np.flatnonzero(np.diff(bucket.astype(np.int64))) + 1
        lo = np.concatenate(([0], edges)) if len(own) else np.zeros(0, int)
        hi = np.append(edges, len(own))
        C.released()
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a in lo], pa.int32()),
            "part": pa.array([part] * len(lo), pa.int32()),
            "digests": pa.array([own[a:b].tobytes() for a, b in zip(lo, hi, strict=False)], pa.binary()),
            "docs": pa.array([_packed(docs[a:b]) for a, b in zip(lo, hi, strict=False)], pa.binary()),
        })

    return run


def _packed(docs: np.ndarray) -> bytes:
    return pa.compress(np.diff(docs, prepend=0).tobytes(), "zstd", asbytes=True)


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests, documents and parts of the rows of a bucket, by digest, document and part, and which ones are a digest's first."""
    dig = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("digests")]
    part = np.repeat(table.column("part").to_numpy(), [len(x) for x in dig])
    packed = zip(table.column("docs"), dig, strict=True)
    docs = np.concatenate([np.cumsum(np.frombuffer(pa.decompress(x.as_py(), d.nbytes, "zstd", asbytes=True), np.int64)) for x, d in packed])
    dig = np.concatenate(dig)
    by = np.lexsort((part, docs, dig))
    dig, docs, part = dig[by], docs[by], part[by]
    return dig, docs, part, np.concatenate(([True], dig[1:] != dig[:-1]))


_ROWS = "bucket int, part int, digests binary, docs binary"


def _first_holders(key, table):
    """One row for a slice of a bucket, which counts as a part: each digest once, with its first document."""
    dig, docs, _, new = _entries(table)
    dig, docs = dig[new], docs[new]
    by = np.argsort(docs, kind="stable")
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "digests": pa.array([dig[by].tobytes()], pa.binary()), "docs": pa.array([_packed(docs[by])], pa.binary())})


def _answer(key, table):
    """For each part of a bucket, the digests that an earlier document of another part holds; part -1 gets no answer."""
    dig, docs, part, new = _entries(table)
    holder = docs[np.maximum.accumulate(np.where(new, np.arange(len(dig)), 0))]
    told = np.flatnonzero(~new & (part >= 0))
    told = told[np.argsort(part[told], kind="stable")]
    edges = np.flatnonzero(np.diff(part[told])) + 1
    lo = np.concatenate(([0], edges)) if len(told) else np.zeros(0, int)
    hi = np.append(edges, len(told))
    groups = [told[a:b] for a, b in zip(lo, hi, strict=False)]
    return pa.table({
        "bucket": pa.array([key[0].as_py()] * len(groups), pa.int32()),
        "part": pa.array([int(part[g[0]]) for g in groups], pa.int32()),
        "digests": pa.array([dig[g].tobytes() for g in groups], pa.binary()),
        "docs": pa.array([_packed(holder[g]) for g in groups], pa.binary()),
    })


def _answers(sent: DataFrame, parts: int) -> DataFrame:
    """part, digests, docs: what each part is told."""
    if parts <= SLICE:
        return sent.groupBy("bucket").applyInArrow(_answer, _ROWS).drop("bucket")
    sliced = sent.withColumn("slice", F.floor(F.col("part") / SLICE).cast("int"))
    least = sliced.groupBy("bucket", "slice").applyInArrow(_first_holders, _ROWS)
    elsewhere = least.groupBy("bucket").applyInArrow(_answer, _ROWS).selectExpr("bucket", "-1 as part", "digests", "docs", "part as slice")
    return sliced.unionByName(elsewhere).groupBy("bucket", "slice").applyInArrow(_answer, _ROWS).drop("bucket")


def _cut(names: list[str], spans_too: bool, schema: pa.Schema):
    def run(table, answers):
        raw, ids, order, parts, row, first_chunk, past_chunk, digests = _part_runs(table)
        own, first, at = _first_places(digests)
        held = ids[np.array(order, np.int64)][row[first]] if len(own) else np.zeros(0, np.int64)
        mine = np.ones(len(own), bool)
        if answers.num_rows:
            theirs = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in answers.column("digests")])
            told = zip(answers.column("docs"), answers.column("digests"), strict=True)
            docs = np.concatenate([np.cumsum(np.frombuffer(pa.decompress(x.as_py(), len(d.as_py()), "zstd", asbytes=True), np.int64)) for x, d in told])
            k = np.searchsorted(own, theirs)
            held[k], mine[k] = docs, False
        dup = ~(mine[at] & (first[at] == np.arange(len(at)))) if len(at) else np.zeros(0, bool)
        holder = held[at] if len(at) else np.zeros(0, np.int64)
        all_words = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        cuts_of = [[] for _ in order]
        for k, a, b, doc in cut_spans(row[dup], first_chunk[dup], past_chunk[dup], holder[dup], all_words):
            cuts_of[k].append((a, b, doc))
        texts, spans, holders, gone = [None] * len(raw), [None] * len(raw), [None] * len(raw), [0] * len(raw)
        lo = 0
        for k, ((begin, words, _), i) in enumerate(zip(parts, order, strict=True)):
            hi = lo + len(begin)
            cuts = [(a - lo, b - lo, doc) for a, b, doc in cuts_of[k]]
            ends = np.append(begin, len(raw[i]))
            left, pos, places, who = [], 0, [], []
            for a, b, doc in cuts:
                a, b = int(ends[a]), int(ends[b])
                left.append(raw[i][pos:max(a, pos)])
                places.append({"start": a, "end": b})
                who.append(None if doc == _NO_ID else doc)
                pos = max(pos, b)
            left.append(raw[i][pos:])
            removed = np.zeros(len(words), bool)
            for a, b, _ in cuts:
                removed[a:b] = True
            texts[i], spans[i], holders[i], gone[i] = b"".join(left), places, who, int(words[removed].sum())
            lo = hi
        C.released()
        null = table.column("text").is_null().to_pylist()
        text = pa.array([None if z else t for z, t in zip(null, texts, strict=True)], pa.binary()).cast(pa.string())
        cols = {n: table.column(n) for n in names} | {"text": text}
        if spans_too:
            cols |= {"n_removed_words": gone, "spans": spans, "held_by": holders}
        elif "n_chars" in names:
            import pyarrow.compute as pc

            cols["n_chars"] = pc.utf8_length(text).cast(schema.field("n_chars").type)
        return pa.table([pa.chunked_array([pa.array(c, f.type)]) if isinstance(c, list) else c.cast(f.type) for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)

    return run


def _dedup(docs: DataFrame, spans_too: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = C.bounded_batches(docs).columns
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, buckets = max(tasks, -(-size // PART_BYTES)), max(tasks, -(-size * 9 // 10 // BUCKET_BYTES))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    dealt = docs.withColumn("__airloom_part", key)
    # Both uses of the parts group the same frame, so the texts are dealt once and read twice.
    sent = dealt.groupBy("__airloom_part").applyInArrow(_send(buckets), _ROWS)
    answers = _answers(sent if parts <= SLICE else C.written(sent, "digests"), parts)
    schema = StructType([f for f in docs.schema])
    if spans_too:
        schema = StructType(schema.fields + StructType.fromDDL("n_removed_words bigint, spans array<struct<start:bigint,end:bigint>>, held_by array<bigint>").fields)
    run = _cut(names, spans_too, to_arrow_schema(schema))
    return dealt.groupBy("__airloom_part").cogroup(answers.withColumnRenamed("part", "__airloom_part").groupBy("__airloom_part")).applyInArrow(run, schema)


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text without the repeated stretches, n_removed_words, spans (bytes of the given text) and, for each span, the document that holds it (but for less than MIN_WORDS words)."""
    return _dedup(docs.select("doc_id", "text"), True)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated stretches cut out of their texts; n_chars is counted again."""
    return _dedup(docs, False)
