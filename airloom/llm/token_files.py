"""Operator 3, token-id output: a binary format of patched frame-of-reference blocks.

Format of a shard file, little-endian: the magic ``PFR1``; u32 documents, u64 tokens, u32 blocks, u32 leading documents
without an id, u64 place of the first token in its range of documents; the documents' ids (i64 each, 0 where there is
none) and token counts (u32 each); the index, u32 byte place of each block; then the blocks. A block holds up to
``BLOCK`` ids: u32 minimum, u8 width, u16 number of ids, u16 exceptions, the ids less the minimum packed in ``width``
bits (low bits only for exceptions), then the exceptions: u16 place and u32 whole difference each. The width is the
smallest that holds ``PERCENTILE`` of the block's differences, unless packing all of them takes fewer bytes. The index
finds the block of any token, so a range is read without the rest. Files are named ``<range>-<number>.pfr``; a table
of them with their numbers of tokens tells where each range starts in the whole.

Plan: rows are dealt by ranges of doc_id and of the text's hash, as many as there are ``RANGE_BYTES`` of text, and
sorted; each task encodes its texts and writes shard files of about ``SHARD_TOKENS`` ids into the shared folder, each
under a name of its own first and then renamed, so that a lost or repeated attempt leaves the same whole file. The
sums of the ranges before each, a few numbers a range, give the shards' places; then the files are read back.

Encoding is what the tokenizers library gives for the whole text. Its splitting never joins a character that isn't
white space with white space after it, so a text without adjacent white space around a blank is cut into runs of
letters, digits, other signs and line ends, each with the blank before it, and each different run goes through the
library's model once while a bounded table keeps it (``WordCache``; runs are told apart by 96 bits of hash). Words with
an apostrophe or letters beyond the Latin ones are split by the library's pattern, other texts are encoded whole by the
library, long ones in parts that end between a letter, a blank and a letter, where no piece can join.

Defined results: null and empty texts have the end id only; rows with the same doc_id are each written, in the
order of their texts' hashes; rows without doc_id come first; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

MAGIC = b"PFR1"
BLOCK = 512
PERCENTILE = 95
END_ID = 2
SHARD_TOKENS = 1 << 20
CACHE_PIECES = 100_000
#: Texts of about so many bytes are encoded together; longer ones in parts.
GROUP = 1 << 20
#: Bytes of text in a range of documents.
RANGE_BYTES = 128 << 20
#: Ranges whose starts are sent to every task at most (16 bytes each).
MAX_RANGES = 1_000_000
_HEAD = struct.Struct("<4sIQIIQ")
_BLOCK_HEAD = struct.Struct("<IBHH")


#: Widths that are whole machine numbers.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def _packed(diff: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each number of each row, one after the other from the lowest bit, as bytes."""
    if width in _WHOLE:
        return np.ascontiguousarray(diff.astype(_WHOLE[width])).view(np.uint8)
    bits = (diff[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(diff), -1), axis=1, bitorder="little")


def pack_block(ids: np.ndarray) -> bytes:
    """One block of at most BLOCK ids."""
    low = int(ids.min())
    diff = (ids - low).astype(np.uint32)
    full = int(diff.max()).bit_length()
    width = int(np.sort(diff)[min(len(diff) - 1, len(diff) * PERCENTILE // 100)]).bit_length()
    out = np.flatnonzero(diff >> np.uint32(width)) if width < full else np.zeros(0, int)
    if len(out) * 6 >= (full - width) * len(diff) / 8:
        width, out = full, np.zeros(0, int)
    packed = _packed(diff[None], width)[0].tobytes()
    return _BLOCK_HEAD.pack(low, width, len(diff), len(out)) + packed + out.astype("<u2").tobytes() + diff[out].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int) -> np.ndarray:
    low, width, n, patched = _BLOCK_HEAD.unpack_from(data, at)
    at += _BLOCK_HEAD.size
    size = (n * width + 7) // 8
    if width in _WHOLE:
        diff = np.frombuffer(data, _WHOLE[width], n, at)
    elif width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width)
        diff = bits.reshape(n, width) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    else:
        diff = np.zeros(n, np.uint32)
    at += size
    place = np.frombuffer(data, "<u2", patched, at)
    diff = diff.astype(np.uint32)
    diff[place] = np.frombuffer(data, "<u4", patched, at + 2 * patched)
    return diff + np.uint32(low)


def _pack_many(ids: np.ndarray) -> list[bytes]:
    """``pack_block`` of each BLOCK ids, the whole blocks computed together by width."""
    whole = len(ids) // BLOCK
    out: list[bytes] = [b""] * whole
    grid = ids[:whole * BLOCK].reshape(whole, BLOCK).astype(np.uint32)
    for at in range(0, whole, 256):
        g = grid[at:at + 256]
        low = g.min(axis=1)
        diff = g - low[:, None]
        top = diff.max(axis=1)
        cut = np.partition(diff, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
        length = lambda x: np.ceil(np.log2(x.astype(float) + 1)).astype(int)  # noqa: E731  bit_length
        full, width = length(top), length(cut)
        over = (diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]) & (width < full)[:, None]
        count = over.sum(axis=1)
        plain = count * 6 >= (full - width) * BLOCK / 8
        width = np.where(plain, full, width)
        over[plain] = False
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            for p, r in zip(_packed(diff[rows], int(w)), rows, strict=True):
                x = np.flatnonzero(over[r])
                out[at + r] = _BLOCK_HEAD.pack(int(low[r]), int(w), BLOCK, len(x)) + p.tobytes() + x.astype("<u2").tobytes() + diff[r][x].astype("<u4").tobytes()
    if len(ids) > whole * BLOCK:
        out.append(pack_block(ids[whole * BLOCK:]))
    return out


def write_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, start: int = 0, missing: int = 0) -> bytes:
    """A shard of whole documents, the first ``missing`` of them without an id."""
    blocks = _pack_many(ids)
    places = np.cumsum([0] + [len(b) for b in blocks[:-1]]).astype("<u4")[:len(blocks)]
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), missing, start)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), places.tobytes(), *blocks])


class Shard:
    """Reads a shard: ``doc_ids``, ``counts``, ``missing``, ``start``, and ``tokens(lo, hi)`` of any range by way of the block index."""

    def __init__(self, data: bytes):
        magic, docs, self.n_tokens, blocks, self.missing, self.start = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.counts = np.frombuffer(data, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        self._places = np.frombuffer(data, "<u4", blocks, at)
        self._data, self._base = data, at + 4 * blocks

    def tokens(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n_tokens if hi is None else min(hi, self.n_tokens)
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // BLOCK, (hi - 1) // BLOCK
        got = [unpack_block(self._data, self._base + int(self._places[k])) for k in range(first, last + 1)]
        return np.concatenate(got)[lo - first * BLOCK:hi - first * BLOCK]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTable:
    """Ids of words by a 64-bit hash and a check value: one place for each hash prefix, the newer word stays there."""

    def __init__(self, small: bool = False, bits: int = 22, room: int = 1 << 24):
        self.shift = np.uint64(64 - bits)
        self.key, self.check = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32)
        self.start, self.size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint16)
        self.ids, self.used = np.zeros(room, np.uint16 if small else np.uint32), 0

    def make_room(self, n: int) -> None:
        """Forgets all words if fewer than n ids fit."""
        if self.used + n > len(self.ids):
            self.key[:], self.used = 0, 0

    def add(self, ids: list[int]) -> int:
        """Puts ids behind those there are; gives their place."""
        at = self.used
        self.ids[at:at + len(ids)] = ids
        self.used += len(ids)
        return at

    def put(self, slot: np.ndarray, key: np.ndarray, check: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.key[slot], self.check[slot], self.start[slot], self.size[slot] = key, check, start, size


_rng = np.random.Generator(np.random.PCG64(3))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE32 = _rng.integers(1, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACES = 2 * GROUP
_POWER = np.multiply.accumulate(np.full(_PLACES + 1, 0xC2B2AE3D27D4EB4F, np.uint64))
_POWER32 = np.multiply.accumulate(np.full(_PLACES + 1, 0x85EBCA77, np.uint32), dtype=np.uint32)
#: Runs of more bytes aren't kept.
_LONGEST_KEPT = 256
_NO_BLANK, _AT_END = np.uint64(0x5851F42D4C957F2C), np.uint64(0x2545F4914F6CDD1C)
#: Kinds of bytes: 0 blank, 1 line end, 2 letter, 3 digit, 4 other; 8 more where the pattern has to split the word:
#: apostrophes, and what may be a character beyond U+00C0 to U+024F without the signs for times and divided by.
_KIND = np.full(256, 4, np.uint8)
_KIND[32], _KIND[10], _KIND[48:58] = 0, 1, 3
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 2
_KIND[[0x97, 0xB7, 0xC2, *range(0xCA, 0x100)]] = 10
_KIND[39] = 12
_PART = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


def _parts(text: bytes) -> list[bytes]:
    """The text in parts of about GROUP bytes, all but the first beginning with a blank between two letters."""
    out, at = [], 0
    while len(text) - at > GROUP and (hit := _PART.search(text, at + GROUP)):
        out.append(text[at:hit.start()])
        at = hit.start()
    out.append(text[at:] if at else text)
    return out


def _runs(buf: np.ndarray, own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """First byte, past the last, whether a blank belongs to it, line ends (1) or at a text's end (2), word to be split.

    ``own`` says where texts begin in the buffer; those of ``first`` have no blank before them."""
    raw = _KIND[buf]
    kind = raw & 7
    starts = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
    kinds = kind[starts]
    split = np.zeros(len(starts), bool)
    hard = np.flatnonzero(raw >= 8)
    if len(hard):
        heads = np.flatnonzero((kinds >= 2) & (np.concatenate(([0], kinds[:-1])) < 2))
        odd = np.unique(np.searchsorted(starts[heads], hard, side="right") - 1)
        split[heads[odd]] = True
        past = np.append(heads[1:], len(starts))[odd]
        change = np.zeros(len(starts) + 1, np.int32)
        change[heads[odd]] += 1
        change[past] -= 1
        inner = (np.cumsum(change[:-1]) > 0) & (kinds >= 2) & ~split
        starts, kinds, split = starts[~inner], kinds[~inner], split[~inner]
    ends = np.append(starts[1:], len(buf))
    word = kinds > 0
    starts, ends, kinds, split = starts[word], ends[word], kinds[word], split[word]
    blank = buf[starts - 1] == 32
    heads = np.searchsorted(starts, own)
    blank[heads[first]] = False
    line = (kinds == 1).astype(np.uint8)
    line[(line == 1) & (buf[np.minimum(ends, len(buf) - 1)] == 32)] = 2
    return starts, ends, blank, line, split


class WordCache:
    """Encodes texts as the tokenizers library does, each different run of letters, digits or signs once while it is kept."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._split = regex.compile(public_tokenizers.PATTERN).findall
        self._letters, self._model = _byte_letters(), self._tokenizer.model
        self._pieces: dict[bytes, list[int]] = {}
        self._most, self._table = pieces, WordTable(self._tokenizer.get_vocab_size() <= 1 << 16)

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: bytes) -> list[int]:
        """The ids of a piece that the pattern doesn't split."""
        ids = self._pieces.get(piece)
        if ids is None:
            if len(self._pieces) >= self._most:
                self._pieces.clear()
            ids = self._pieces[piece] = [t.id for t in self._model.tokenize(piece.decode("latin-1").translate(self._letters))]
        return ids

    def _word(self, word: bytes) -> list[int]:
        """The ids of a word with the blank before it; where Unicode tables could differ, the library splits it."""
        text = word.decode()
        if not text.isascii() and max(text) >= "\u0250":
            return self._whole(text)
        return [i for piece in self._split(text) for i in self._piece(piece.encode())]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return self.encode_many([text.encode()])[0]

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and how many each has."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, bytes, bool]] = []

        def cut() -> None:
            if waiting:
                ids, n = self._cut_words([x for _, x, _ in waiting], np.array([f for _, _, f in waiting]))
                out.append(ids)
                np.add.at(sizes, [k for k, _, _ in waiting], n)
                waiting.clear()

        size = 0
        for k, text in enumerate(texts):
            for j, part in enumerate(_parts(text)):
                plain = part if j == 0 else part[1:]
                if plain and len(plain) < _PLACES - 1 and not _touching(plain):
                    if size + len(plain) >= GROUP:
                        cut()
                        size = 0
                    waiting.append((k, plain, j == 0))
                    size += len(plain) + 1
                elif part:
                    cut()
                    size = 0
                    ids = self._whole(part.decode())
                    out.append(np.array(ids, np.uint32))
                    sizes[k] += len(ids)
        cut()
        return np.concatenate(out) if out else np.zeros(0, np.uint32), sizes

    def _cut_words(self, texts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that can be cut into runs, and how many each has; ``first`` ones have no blank before."""
        raw = b" ".join(texts) + b" "
        buf = np.frombuffer(raw, np.uint8)
        own = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
        starts, ends, blank, line, split = _runs(buf, own, first)
        table = self._table
        table.make_room(2 * len(buf))
        sizes = ends - starts
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _POWER[:len(buf)], out=sums[1:])
        key = C.mix64((sums[ends] - sums[starts]) * _POWER[_PLACES - starts] + sizes.astype(np.uint64))
        key ^= np.where(blank, np.uint64(0), _NO_BLANK) ^ np.where(line == 2, _AT_END, np.uint64(0))
        key |= np.uint64(1)
        sums = np.zeros(len(buf) + 1, np.uint32)
        np.cumsum(_BYTE32[buf] * _POWER32[:len(buf)], dtype=np.uint32, out=sums[1:])
        check = (sums[ends] - sums[starts]) * _POWER32[_PLACES - starts]
        slot = (key >> table.shift).astype(np.int64)
        known = (table.key[slot] == key) & (table.check[slot] == check)
        place, count = table.start[slot].astype(np.int64), table.size[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        fresh, many = [], []
        begin = (starts - blank)[new].tolist()
        for lo, hi, of_line, odd in zip(begin, ends[new].tolist(), line[new].tolist(), split[new].tolist(), strict=True):
            run = raw[lo:hi]
            if odd:
                ids = self._word(run)
            elif of_line == 1 and hi - lo > 1:  # the last line end before a word is a piece of its own
                ids = self._piece(run[1:]) + self._piece(run[:1])
            else:
                ids = self._piece(run)
            fresh += ids
            many.append(len(ids))
        count[new] = many
        place[new] = table.add(fresh) + np.cumsum(many, dtype=np.int64) - count[new]
        kept = new[sizes[new] <= _LONGEST_KEPT]
        table.put(slot[kept], key[kept], check[kept], place[kept], count[kept])
        past = np.cumsum(count)
        at = np.repeat(place - (past - count), count)
        at += np.arange(len(at))
        return table.ids[at].astype(np.uint32), np.add.reduceat(count, np.searchsorted(starts, own))


#: Bytes of white space in UTF-8 besides the blank and the line end.
_OTHER_SPACE = [bytes([b]) for b in (*range(9, 10), *range(11, 14), *range(28, 32))] + [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"] + [b"\xe2\x80"]


def _touching(raw: bytes) -> bool:
    """Whether white space may stand on both sides of a blank, or at an end; or a special token may occur."""
    if b"  " in raw or b" \n" in raw or b"\n " in raw or b"<|" in raw or raw[:1] == b" " or raw[-1:] == b" ":
        return True
    return any(s in raw for s in _OTHER_SPACE)


#: The caches of this Python worker, which later tasks find warm.
_caches: dict[str, WordCache] = {}


def _file_system(folder: str):
    """The file system of a folder that driver and executors share, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", folder)))


def _put(folder: str, name: str, data: bytes) -> str:
    """Writes a file under a name of its own and renames it; gives its final place."""
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")
    return name


def _encode(path: str, folder: str):
    def run(batches):
        from pyspark import TaskContext

        from . import token_files

        caches = token_files._caches
        if path not in caches:
            caches[path] = WordCache(path)
        cache, part, seq, start = caches[path], TaskContext.get().partitionId(), 0, 0
        docs, counts, ids, size, missing = [], [], [], 0, 0

        def shard():
            data = write_shard(np.array(docs, np.int64), np.concatenate(counts), np.concatenate(ids), start, missing)
            name = _put(folder, f"{part:08d}-{seq:06d}.pfr", data)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_tokens": [size], "n_docs": [len(docs)], "name": [name]})

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), [x or b"" for x in C.raw_texts(batch, "text")]
            bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + GROUP)) - 1)
                got, n = cache.encode_many(texts[lo:hi])
                got, n = np.insert(got, np.cumsum(n), END_ID), n + 1
                missing += sum(d is None for d in names[lo:hi])
                docs += [0 if d is None else d for d in names[lo:hi]]
                counts.append(n)
                ids.append(got)
                size += len(got)
                lo = hi
                if size >= SHARD_TOKENS:
                    yield shard()
                    docs, counts, ids, start, size, seq, missing = [], [], [], start + size, 0, seq + 1, 0
        if docs:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Writes the shard files of all rows in ascending doc_id order: the table of them (part, seq, n_tokens, n_docs,
    name), and the folder that holds them until the driver ends."""
    rows = docs.select("doc_id", "text")
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-size // RANGE_BYTES))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    folder = C.kept_folder(spark, "shards")
    return C.written(C.map_batches(dealt, _encode(path, folder), "part int, seq int, n_tokens bigint, n_docs bigint, name string"), "tokens"), folder


def starts_of(shards: DataFrame) -> DataFrame:
    """part, base: the tokens of all ranges before each, a row a range."""
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard files."""
    bases = starts_of(shards)
    few = bases.limit(MAX_RANGES + 1).count() <= MAX_RANGES
    tasks = max(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    files = shards.join(F.broadcast(bases) if few else bases, "part").select("name", "base").repartition(tasks, "name")

    def run(batches):
        system, path = _file_system(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with system.open_input_stream(f"{path}/{name}") as source:
                    shard = Shard(source.read())
                ids = shard.tokens().astype("<u4")
                edges = np.concatenate(([0], np.cumsum(shard.counts.astype(np.int64))))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                doc = pa.array(shard.doc_ids, pa.int64(), mask=np.arange(len(crc)) < shard.missing)
                yield pa.RecordBatch.from_arrays([doc, pa.array(edges[:-1] + (base + shard.start)), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return C.map_batches(files, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes the shard files and reads them back."""
    return read_tokens(*write_tokens(docs, path))
