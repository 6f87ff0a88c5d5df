"""Operator 8, near-duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

Method: two small collections of ``SIDE`` half-keys (each of ``ROWS`` minhashes) are computed for each text; a
table key joins one half-key of either collection, so ``SIDE**2`` tables need only ``2 * SIDE * ROWS`` minhashes.
Two sets of similarity s share a table with probability ``(1 - (1 - s**ROWS)**SIDE)**2`` (0.9995 at 0.75).

Plan: texts with the same shingle set form a class, which gets a number of its own and is represented by one of its
texts; classes that share a doc_id are linked. Half-keys that only one
representative has are left out before the tables are formed. In each bucket every member is linked to one
hub only; what that leaves apart is searched by the rarest shingles that different parts share
(``rare_pairs``), so no large group is expanded into all its pairs and no link between different parts is lost. Every link is
confirmed on the full sets, as sizes of intersection and union. Components come from ``components``.

Defined results: null and empty texts and texts without words have n_shingles 0 and link with nothing; a text
with fewer words than ``WIDTH`` is one shingle; rows with the same doc_id share one component, also where their texts
differ (an empty text's row keeps its own id), and are kept or dropped together; rows without doc_id get their class's component (null if no row of it has
an id) and are kept only without one; an empty table gives no rows. Columns other than doc_id and text are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C
from .components import components

WIDTH = 5
PERCENT = 75
ROWS = 2
SIDE = 10
#: 64-bit words of the odd sketch.
ODD = 8
#: Ids are sent to every task only up to this many (8 bytes each); beyond it they are joined by a shuffle.
MAX_SENT_IDS = 1_000_000
#: Sets that meet in one shingle are compared in blocks of so many by all.
MEET = 500
_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**62, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(raw: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text, A-Z lower-cased."""
    return np.unique(C.shingle_hashes(C.word_hashes((raw or b"").lower()), WIDTH))


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """2 * SIDE half-keys; the first SIDE form one collection, the rest the other."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = (shingles[at:at + 4096, None] ^ _XOR) * _MUL
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, x.min(axis=0), out=low)
    out = np.arange(2 * SIDE, dtype=np.uint64)
    for k in range(ROWS):
        out = C.mix64(out * np.uint64(0xD6E8FEB86659FD93) + low[k::ROWS])
    return out.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """ODD * 64 bits: each shingle flips one; two sketches differ in no more bits than the sets in shingles."""
    place = (shingles >> np.uint64(17)) % np.uint64(ODD * 64)
    bits = np.bincount(place.astype(np.int64), minlength=ODD * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _signatures(batch) -> dict:
    n, key, half, odd = [], [], [], []
    for raw in C.raw_texts(batch, "text"):
        s = shingle_set(raw)
        n.append(len(s))
        key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        half.append(half_keys(s).tolist() if len(s) else None)
        odd.append(odd_sketch(s).tolist() if len(s) else None)
    return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n_shingles": n, "set_key": key, "half": half, "odd": odd}


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets reach the similarity; ``texts`` has (rep, text) once per class."""
    first = pairs.join(texts.selectExpr("rep as a", "text as text_a"), "a")
    second = first.join(texts.selectExpr("rep as b", "text as text_b"), "b")

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            ids = batch.column("b").to_pylist()
            for b, ta, tb in zip(ids, C.raw_texts(batch, "text_a"), C.raw_texts(batch, "text_b"), strict=True):
                if last[0] != b:  # the rows of one b stand together, so its set is made once
                    last = (b, shingle_set(tb))
                x, y = shingle_set(ta), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    return C.map_batches(second.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint")


def table_rows(reps: DataFrame) -> DataFrame:
    """(key, rep, n): a row for each table key that another representative may share."""
    halves = reps.select("rep", "n", F.posexplode("half").alias("at", "h"))
    shared = halves.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    left = halves.join(shared, "h", "left_semi")
    sides = left.groupBy("rep", "n").agg(
        F.collect_list(F.when(F.col("at") < SIDE, F.col("h"))).alias("us"),
        F.collect_list(F.when(F.col("at") >= SIDE, F.col("h"))).alias("vs"),
    )
    return sides.select("rep", "n", "vs", F.explode("us").alias("u")).select("rep", "n", "u", F.explode("vs").alias("v")).select(F.xxhash64("u", "v").alias("key"), "rep", "n")


def class_links(docs: DataFrame, reps: DataFrame) -> list[DataFrame]:
    """Confirmed links (a, b) between representatives that connect all of them that are similar, in written parts."""
    rows = C.written(table_rows(reps), "tables")
    buckets = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = rows.join(buckets, "key")
    # The member that shares most tables with others lies in the middle of its group: it is the hub.
    score = C.written(shared.groupBy("rep", "n").agg(F.sum("c").alias("score")), "scores")
    scored = shared.select("key", "rep", "n").join(score.select("rep", "score"), "rep")
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", "rep", "n")).alias("hub"))
    stars = scored.join(hubs, "key").where("rep <> hub.rep").where(_sizes("n", "hub.n"))
    stars = stars.selectExpr("rep as a", "n as na", "hub.rep as b", "hub.n as nb", "hub.score as score").distinct()
    for end in ("a", "b"):
        stars = stars.join(reps.selectExpr(f"rep as {end}", f"odd as odd_{end}"), end)
    stars = stars.where(_differ(_odd_bits("odd_a", "odd_b"), F.col("na") + F.col("nb")))
    stars = C.written(stars.select("a", "b", "score"), "stars")
    texts = C.written(_texts_of(docs, reps.join(score.select("rep"), "rep").select("rep", "doc_id", "th")), "texts")

    best = stars.groupBy("a").agg(F.max(F.struct("score", "b")).alias("x")).selectExpr("a", "x.b as b")
    first = C.written(confirm(best, texts), "confirmed")
    apart = stars.select("a", "b").join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        apart = apart.join(first.selectExpr(f"a as {end}", f"b as r{end}"), end, "left")
    apart = apart.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    second = C.written(confirm(apart, texts), "confirmed")

    links = first.unionByName(second)
    roots = components(links)
    # What the stars left apart: members of one bucket in different components are compared exactly.
    labelled = rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left").selectExpr("key", "rep", "n", "coalesce(root, rep) as root")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    apart = labelled.join(mixed, "key", "left_semi").select("rep", "n", "root").distinct()
    tested = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs, between = rare_pairs(apart, texts, reps)
    pairs = pairs.join(tested, ["a", "b"], "left_anti")
    third = C.written(confirm(pairs, texts), "confirmed")
    C.forget(rows, score, stars, texts, roots, *between)
    return [first, second, third]


def rare_pairs(apart: DataFrame, texts: DataFrame, reps: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of different roots that can reach the similarity, and the frames written on the way; no pair that
    does reach it is missing.

    Let k of a set's n shingles be found under several roots, and u = n - k under its own only. Sets a and b that
    reach the similarity share at least PERCENT of either's n, all of it among the k; so a set with fewer has no
    partner, and of the others two partners meet in one of their rarest ones: all but as many as they must
    share, and one more. They differ in u_a + u_b + |k_a - k_b| shingles at least, and may in (n_a + n_b) *
    (100 - PERCENT) / (100 + PERCENT) at most; nor can their odd sketches differ in more bits. These bounds leave
    out most sets of a group that are far from all, without a look at their texts."""

    def explode(batches):
        for batch in batches:
            sets = [shingle_set(raw).view(np.int64) for raw in C.raw_texts(batch, "text")]
            if sets:
                at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                cols = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[at]) for c in ("rep", "n", "root")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(sets))], names=["rep", "n", "root", "s"])

    found = texts.join(apart, "rep").select("rep", "n", "root", "text")
    shingles = C.written(C.map_batches(found, explode, "rep bigint, n bigint, root bigint, s bigint"), "shingles")
    several = shingles.groupBy("s").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s", "c")
    own = Window.partitionBy("rep")
    need = F.ceil(F.col("n") * PERCENT / 100)
    ranked = shingles.join(several, "s").withColumn("k", F.count("*").over(own)).where(F.col("k") >= need)
    ranked = ranked.withColumn("at", F.row_number().over(own.orderBy("c", "s"))).where(F.col("at") <= F.col("k") - need + 1)
    kept = C.written(ranked.select("rep", "n", "root", "s", "k", "at"), "rare")
    # The most similar partner that sets of these sizes could be has no shingles of its own and m = least n of those met.
    least = kept.groupBy("s").agg(F.min("n").alias("m"), F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s", "m", "c")
    least = C.written(least, "least")  # a sum by s in the same stage would keep the join from being split
    alike = F.greatest("m", "k")
    rare = kept.join(least, "s").where(_differ(F.col("n") - F.col("k") + alike - F.col("k"), F.col("n") + alike)).drop("m")
    rare = C.written(rare.join(reps.select("rep", "odd"), "rep"), "rare")
    # A shingle with many sets is dealt over several tasks: a block of its sets meets all of them.
    blocks = F.ceil(F.col("c") / MEET).cast("int")
    one = rare.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).drop("c").alias("one")
    two = rare.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("c").alias("two")
    meet = (F.col("one.s") == F.col("two.s")) & (F.col("one.block") == F.col("two.block")) & (F.col("one.rep") > F.col("two.rep")) & (F.col("one.root") != F.col("two.root"))
    apart = F.expr("one.n - one.k + two.n - two.k + abs(one.k - two.k)")
    meet = meet & _sizes("one.n", "two.n") & _differ(apart, F.col("one.n") + F.col("two.n"))
    meet = meet & _differ(_odd_bits("one.odd", "two.odd"), F.col("one.n") + F.col("two.n"))
    # At the first shingle where two partners meet, they can still share what either has from there on.
    still = F.expr("1 + least(one.k - one.at, two.k - two.at)")
    meet = meet & (still * (100 + PERCENT) >= (F.col("one.n") + F.col("two.n")) * PERCENT)
    return one.join(two, meet).selectExpr("one.rep as a", "two.rep as b").distinct(), [shingles, kept, least, rare]


def _odd_bits(odd: str, other: str):
    """In how many bits two odd sketches differ."""
    return F.expr(" + ".join(f"bit_count({odd}[{k}] ^ {other}[{k}])" for k in range(ODD)))


def _differ(shingles, sizes):
    """Whether sets of these sizes may differ in so many shingles."""
    return shingles * (100 + PERCENT) <= sizes * (100 - PERCENT)


def _sizes(n: str, m: str):
    """Sets can reach the similarity only if their sizes do."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and text of the wanted (rep, doc_id, th): a text is named by its document and its hash."""
    few = wanted.limit(MAX_SENT_IDS // 4 + 1).count() <= MAX_SENT_IDS // 4
    named = wanted.withColumnRenamed("doc_id", "named_id")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = texts.join(F.broadcast(named) if few else named, (texts["th"] == named["th"]) & texts["doc_id"].eqNullSafe(named["named_id"]))
    return found.select("rep", "text").dropDuplicates(["rep"])


def shared_ids(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between classes that a doc_id with several texts belongs to."""
    rows = signed.where("set_key is not null and doc_id is not null")
    ends = rows.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("low"), F.max(F.xxhash64("set_key")).alias("high"))
    several = ends.where("low < high").select("doc_id")
    member = rows.select("doc_id", "set_key").join(several, "doc_id").distinct().join(reps.select("set_key", "rep"), "set_key")
    least = member.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return member.join(least, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    signed = C.written(C.in_batches(docs.withColumn("th", F.xxhash64("text")), _signatures, "doc_id bigint, th bigint, n_shingles bigint, set_key binary, half array<bigint>, odd array<bigint>"), "signatures")
    # A class's half-keys are the same in all its rows; the written number stands for the class from here on.
    reps = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("half").alias("half"), F.first("odd").alias("odd"), F.first("n_shingles").alias("n"))
    reps = C.written(reps.select(F.monotonically_increasing_id().alias("rep"), "set_key", "least", "at.doc_id", "at.th", "half", "odd", "n"), "classes")
    first, second, third = class_links(docs, reps)
    roots = components(first.unionByName(second).unionByName(third).unionByName(shared_ids(signed, reps)))
    C.forget(first, second, third)
    linked = roots.unionByName(roots.selectExpr("root as node", "root").distinct())
    named = linked.join(reps.selectExpr("rep as node", "least"), "node").groupBy("root").agg(F.min("least").alias("smallest"))
    named = linked.join(named, "root").selectExpr("node as rep", "smallest", "true as in_group")
    classes = reps.select("set_key", "rep", "least").join(named, "rep", "left").select("set_key", F.when(F.col("in_group"), F.col("smallest")).otherwise(F.col("least")).alias("class_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one document of each group: that with the group's smallest id."""
    lost = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    few = lost.limit(MAX_SENT_IDS + 1).count() <= MAX_SENT_IDS
    return docs.join(F.broadcast(lost) if few else lost, "doc_id", "left_anti").select(*[f"`{n}`" for n in docs.columns])
