"""Operator 5, benchmark decontamination, in DataFrame and SQL functions only.

Method: windows of a text as long as a benchmark item get a 64-bit SimHash of their distinct words. The fingerprint is
split into ``BLOCKS`` blocks; an item is indexed under each block's value and all values up to ``OFF`` bits off it, so
a window within ``RADIUS`` = (OFF + 1) * BLOCKS - 1 bits of it meets it in some block (were all blocks further off,
the distance would be more). Candidates within the radius are verified exactly: the windows' 5-word shingles, weighted
by how often they occur, must have a weighted Jaccard similarity of ``PERCENT`` or more.

Plan: a window that verifies shares 5-word shingles with its item, wherever they stand in either. Windows that such a
shingle anchors (its place in the text less its place in the item) are fingerprinted, and so are those that begin with
one (end, where the text's start cuts them) and hold enough of them: whichever window verifies, one of these does, also
where an item's parts are in another order. Each meets in the index only the items that anchored it; all shingles of all
texts are looked up. Windows of equal words are compared once with an item.
Shingles are weighted by counting them, so the work on a window grows with its length. The item tables are sent to
every task only up to ``MAX_SENT`` bytes, summed first; beyond that they are joined by a shuffle.

Defined results: words are runs without ASCII white space, lower-cased; null and empty texts and texts with fewer
than 5 words match nothing, nor do items with fewer than 5 words or null ones; a window that would start before
or end after the text is cut there; repeated rows are judged alike, each with its own row, and items of the same
item_id each by their own text; rows without doc_id
are judged too; empty tables match nothing. Columns other than those named are ignored or passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import common as C

WIDTH = 5
PERCENT = 75
BLOCKS = 8
OFF = 3
RADIUS = (OFF + 1) * BLOCKS - 1
#: Bytes of a table that is sent to every task, at most.
MAX_SENT = 64 << 20
_BITS = 64 // BLOCKS


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row; a plain one would be computed again in each lambda call."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _word_hashes(df: DataFrame) -> DataFrame:
    """Adds ``wh``, the hash of each word of ``text``."""
    clean = F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "[ \\t-\\r]+"))
    df = _once(df, "w", words)
    return _once(df, "wh", F.transform("w", lambda x: F.xxhash64(x))).drop("w")


def _shingles(wh: str) -> Column:
    """Hashes of the WIDTH-word shingles of an array of word hashes."""
    ahead = ", ".join(f"get({wh}, i + {k})" for k in range(1, WIDTH))
    return F.expr(f"if(size({wh}) < {WIDTH}, array(), transform(slice({wh}, 1, greatest(size({wh}) - {WIDTH - 1}, 0)), (x, i) -> xxhash64(x, {ahead})))").cast("array<bigint>")


def simhash(wh: str) -> Column:
    """Bit b is set where more than half of the word hashes have it."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(aggregate({wh}, 0L, (s, h) -> s + (shiftrightunsigned(h, b) & 1L)) * 2 > size({wh}), shiftleft(1L, b), 0L))")


def _blocks(fingerprint: str) -> list[Column]:
    return [F.struct(F.lit(k).alias("block"), (F.shiftrightunsigned(fingerprint, k * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))).alias("value")) for k in range(BLOCKS)]


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    parts = [F.lit(16)]
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            parts.append(F.size(f.name) * (8 * len(inner) if isinstance(inner, T.StructType) else 8))
        else:
            parts.append(F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8))
    return sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), parts[0])


def _small(df: DataFrame) -> DataFrame:
    """The table marked to be sent to every task if the sum of its rows' bytes allows it."""
    return F.broadcast(df) if (df.agg(F.sum(_bytes(df))).first()[0] or 0) <= MAX_SENT else df


def _key() -> Column:
    """Tells rows apart by content, so that rows without id or with the same one are judged by their own text."""
    return F.xxhash64("doc_id", "text")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n, sh, fingerprint of each item that has a shingle; ``item`` tells items of one id apart."""
    items = _word_hashes(benchmark.select("item_id", "text").where("text is not null")).drop("text")
    items = _once(items, "sh", _shingles("wh")).where(F.size("sh") > 0)
    items = items.select(F.xxhash64("wh", "item_id").alias("item"), "item_id", F.size("wh").alias("n"), "sh", F.array_distinct("wh").alias("distinct_wh"))
    items = items.select("item", "item_id", "n", "sh", simhash("distinct_wh").alias("fingerprint"))
    return C.written(items.dropDuplicates(["item", "item_id"]), "items")


def anchors(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, doc_id, start, n, item, extra: the item-sized windows of a text that can match an item.

    Those that share a shingle with the item at that place, and (``extra``) those that start with a shared shingle or,
    cut at the text's start, end with one: sliding any other window to the next of these loses no shared shingle. Of
    the extra ones only those are kept that hold as many shared shingles as the similarity needs at least."""
    places = items.select("item", "n", F.posexplode("sh").alias("q", "h")).distinct()
    rows = _once(_word_hashes(docs.select("doc_id", "text").where("text is not null").withColumn("key", _key())).drop("text"), "sh", _shingles("wh"))
    rows = rows.select("key", "doc_id", F.size("sh").alias("size"), F.posexplode("sh").alias("p", "h"))
    met = rows.join(_small(places), "h")
    met = met.groupBy("key", "doc_id", "item", "n", "size").agg(F.array_sort(F.collect_set("p")).alias("ps"), F.collect_set(F.col("p") - F.col("q")).alias("same"))
    need = lambda s: f"(({PERCENT} * ({s} + m) + {99 + PERCENT}) div {100 + PERCENT})"
    right, left = "least(m, size - p)", "(p + 1)"
    begin = f"filter(transform(ps, (p, i) -> if(get(ps, int(i + {need(right)} - 1)) <= p + {right} - 1, p, null)), x -> x is not null)"
    end = f"filter(transform(ps, (p, i) -> if(p + 1 <= m and i + 1 >= {need(left)}, p + {WIDTH} - n, null)), x -> x is not null)"
    met = met.withColumn("m", F.col("n") - (WIDTH - 1)).withColumn("more", F.array_except(F.expr(f"array_union({begin}, {end})"), F.col("same")))
    both = F.concat(F.transform("same", lambda x: F.struct(x.alias("start"), F.lit(False).alias("extra"))), F.transform("more", lambda x: F.struct(x.alias("start"), F.lit(True).alias("extra"))))
    return met.select("key", "doc_id", "n", "item", F.explode(both).alias("x")).select("key", "doc_id", "x.start", "n", "item", "x.extra")


def windows_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """key, doc_id, start, n_words, words, content, item, extra of the windows; ``content`` tells their words."""
    places = found.groupBy("key", "doc_id").agg(F.collect_list(F.struct("start", "n", "item", "extra")).alias("places"))
    texts = docs.select("doc_id", "text").where("text is not null").withColumn("key", _key()).withColumnRenamed("doc_id", "own_id")
    places = _small(C.written(places, "places"))
    rows = texts.join(places, (texts["key"] == places["key"]) & texts["own_id"].eqNullSafe(places["doc_id"])).select(places["key"], "doc_id", "text", "places").dropDuplicates(["key", "doc_id"])
    cut = "transform(places, x -> named_struct('start', greatest(x.start, 0), 'item', x.item, 'extra', x.extra, 'words', slice(wh, greatest(x.start, 0) + 1, least(x.start + x.n, size(wh)) - greatest(x.start, 0))))"
    windows = _word_hashes(rows).select("key", "doc_id", F.explode(F.expr(cut)).alias("x"))
    return windows.select("key", "doc_id", "x.start", F.size("x.words").alias("n_words"), "x.words", F.xxhash64("x.words").alias("content"), "x.item", "x.extra")


def candidates(marked: DataFrame, items: DataFrame) -> DataFrame:
    """content, item of the windows within RADIUS bits of an item that anchored them, by way of the block index."""
    probes = marked.select("content", "item", "fingerprint", F.explode(F.array(*_blocks("fingerprint"))).alias("at")).select("content", "item", "fingerprint", "at.*")
    index = items.select("item", F.col("fingerprint").alias("item_fingerprint"), F.explode(F.array(*_blocks("fingerprint"))).alias("at")).select("item", "item_fingerprint", "at.*")
    masks = [m for m in range(1 << _BITS) if m.bit_count() <= OFF]
    index = index.select("item", "item_fingerprint", "block", F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("value").bitwiseXOR(m.cast("bigint")))).alias("value"))
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS
    return probes.join(_small(index), ["item", "block", "value"]).where(close).select("content", "item").distinct()


def verified(pairs: DataFrame, marked: DataFrame, items: DataFrame) -> DataFrame:
    """content, item, similarity of the pairs whose weighted shingles are alike enough."""
    sides = _once(pairs.join(marked, ["content", "item"]).select("content", "item", "wh"), "sh", _shingles("wh"))
    counted = sides.select("content", "item", F.size("sh").alias("size"), F.explode("sh").alias("h")).groupBy("content", "item", "size", "h").agg(F.count("*").alias("c"))
    wanted = items.select("item", F.size("sh").alias("item_size"), F.explode("sh").alias("h")).groupBy("item", "item_size", "h").agg(F.count("*").alias("item_c"))
    met = counted.join(_small(C.written(wanted, "weights")), ["item", "h"]).groupBy("content", "item", "size", "item_size").agg(F.sum(F.least("c", "item_c")).alias("both"))
    union = F.col("size") + F.col("item_size") - F.col("both")
    return met.where(F.col("both") * 100 >= union * PERCENT).select("content", "item", (F.col("both") / union).alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, item_id, start, n_words, similarity: each verified window; of the extra ones the most alike, where
    an item matches only by these."""
    items = items_of(benchmark)
    windows = C.written(windows_of(docs, C.written(anchors(docs, items), "anchors")), "windows")
    distinct = windows.groupBy("content", "item").agg(F.first("words").alias("wh"))
    marked = _once(_once(distinct, "distinct_wh", F.array_distinct("wh")), "fingerprint", simhash("distinct_wh"))
    marked = C.written(marked.drop("distinct_wh"), "fingerprints")
    passed = C.written(verified(candidates(marked, items), marked, items), "passed")
    named = passed.join(_small(items.select("item", "item_id")), "item")
    found = windows.drop("words").join(_small(named), ["content", "item"])
    of = Window.partitionBy("key", "doc_id", "item")
    found = found.withColumns({"only": F.min("extra").over(of), "at": F.row_number().over(of.orderBy("extra", F.desc("similarity"), "start"))})
    return found.where("not extra or only and at = 1").select("key", "doc_id", "item_id", "start", "n_words", "similarity")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, kept (false if a window of the text matches an item), n_matches, item_ids, best_similarity, spans."""
    found = C.written(matches(docs, benchmark), "matches")
    span = F.struct("item_id", "start", "n_words", "similarity")
    hits = found.groupBy("key", "doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("best_similarity"), F.array_sort(F.collect_set(span)).alias("spans"))
    hits = _small(C.written(hits, "hits")).withColumnRenamed("doc_id", "__airloom_hit_id").withColumnRenamed("key", "__airloom_hit_key")
    rows = docs.select("doc_id", _key().alias("key"))
    out = rows.join(hits, (F.col("key") == F.col("__airloom_hit_key")) & F.col("doc_id").eqNullSafe(F.col("__airloom_hit_id")), "left")
    return out.select("doc_id", F.col("__airloom_hit_key").isNull().alias("kept"), F.coalesce(F.size("spans").cast("bigint"), F.lit(0)).alias("n_matches"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a window that matches an item, all columns as they were."""
    hits = C.written(matches(docs, benchmark).select(F.col("key").alias("__airloom_hit_key"), F.col("doc_id").alias("__airloom_hit_id")).distinct(), "hits")
    keyed = docs.withColumn("__airloom_key", _key())
    out = keyed.join(_small(hits), (F.col("__airloom_key") == F.col("__airloom_hit_key")) & F.col("doc_id").eqNullSafe(F.col("__airloom_hit_id")), "left_anti")
    return out.select(*[f"`{n}`" for n in docs.columns])
