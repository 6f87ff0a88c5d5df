"""Operator 6, SentencePiece encoding and decoding with byte offsets.

Method: ``Normaliser`` applies the model's own normalisation: at each place the longest prefix found in the
compiled character map (a double-array trie with a table of replacements) is replaced, or one character is copied;
white space is collapsed, escaped and given its dummy mark as the model asks. It records for each normalised byte
where in the source it comes from. The normalised text goes to the library's model with its normaliser set to copy,
and each piece's bytes are projected through the record to the span of source bytes that it stands for.

Defined results: null and empty texts give the end id only and decode to an empty text; repeated rows and rows
without doc_id are encoded alike; an empty table gives no rows; other columns are ignored. Any length is encoded
whole. A piece's span is empty only where the source has nothing for it (the dummy mark).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import common as C

MARK = "▁".encode()
_BAD = "�".encode()


class CharacterMap:
    """The compiled map of a model: u32 size of the trie, the trie's u32 units, then replacements ended by NUL."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self._units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self._texts = blob[4 + size:]
        self.first = bytes(b for b in range(256) if self._step(self._root(), b) is not None) if self._units else b""

    def _root(self) -> int:
        return self._offset(self._units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, at: int, byte: int) -> tuple[int, bool] | None:
        """The node below ``at`` for a byte, and whether a key ends there."""
        at ^= byte
        if at >= len(self._units) or self._units[at] & 0x800000FF != byte:
            return None
        unit = self._units[at]
        return at ^ self._offset(unit), bool(unit & 256)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``raw`` has at a place."""
        if not self._units:
            return None
        node, found = self._root(), None
        for k in range(at, len(raw)):
            step = self._step(node, raw[k])
            if step is None:
                break
            node, ends = step
            if ends:
                found = (k + 1 - at, self._units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self._texts[found[1]:self._texts.index(b"\0", found[1])]


@dataclass
class Normaliser:
    chars: CharacterMap
    dummy: bool
    collapse: bool
    escape: bool
    suffix: bool

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte where it comes from."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        if not self.chars.first and not self.collapse and not self.suffix:
            return self._plain(raw)
        out, at = [], []
        for text, lo in self._replaced(raw):
            out.append(text)
            at.append(np.full(len(text), lo, np.int64))
        end = len(raw)
        return self._spaces(b"".join(out), np.concatenate([*at, [end]]))

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map or collapsing, only blanks change."""
        mark = MARK if self.escape else b" "
        width = np.where(np.frombuffer(raw, np.uint8) == 32, len(mark), 1)
        at = np.append(np.repeat(np.arange(len(raw)), width), len(raw))
        text = raw.replace(b" ", mark)
        return (mark + text, np.concatenate((np.zeros(len(mark), np.int64), at))) if self.dummy else (text, at)

    def _replaced(self, raw: bytes):
        """Replacements and copied characters, with their places."""
        first, k = set(self.chars.first), 0
        while k < len(raw):
            hit = self.chars.longest(raw, k) if raw[k] in first else None
            if hit:
                yield hit[1], k
                k += hit[0]
                continue
            n = 1
            while k + n < len(raw) and raw[k + n] & 0xC0 == 0x80:
                n += 1
            yield raw[k:k + n], k
            k += n

    def _spaces(self, text: bytes, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        buf, src, end = np.frombuffer(text, np.uint8), at[:-1], at[-1]
        if self.collapse:
            blank = buf == 32
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            if not keep.any():
                return b"", np.zeros(1, np.int64)
            buf, src = buf[keep], src[keep]
        mark = MARK if self.escape else b" "
        width = np.where(buf == 32, len(mark), 1)
        text, src = buf.tobytes().replace(b" ", mark), np.repeat(src, width)
        if self.dummy and not self.suffix:
            text, src = mark + text, np.concatenate((np.full(len(mark), src[0]), src))
        while self.collapse and text.endswith(mark):  # a mark that stood in the source goes with the blanks
            text = text[:-len(mark)]
            end, src = src[len(text)], src[:len(text)]
        if self.dummy and self.suffix:
            text, src = text + mark, np.append(src, np.full(len(mark), end))
        return text, np.append(src, end)


@dataclass
class Encoded:
    ids: list[int]  # with the end id
    begins: np.ndarray  # of each piece but the end id, in source bytes
    ends: np.ndarray


class Codec:
    """Encodes and decodes with one model file; ``path`` is a parameter, the file is read on the executor."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.normalise = Normaliser(CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self._copying = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = pb.ModelProto.SentencePiece
        self._bytes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces])
        self._unknown = self.model.unk_id()
        self.end_id = self.model.eos_id()

    def encode(self, text: str | None) -> Encoded:
        normal, at = self.normalise((text or "").encode())
        if not normal:
            return Encoded([self.end_id], np.zeros(0, np.int64), np.zeros(0, np.int64))
        word = normal.decode()
        ids = self._copying.encode(word)
        size = self._bytes[ids]
        if self._unknown in ids:  # an unknown piece has the bytes that the text has there
            size = np.array([len(p.encode()) for p in self._copying.encode(word, out_type=str)])
        edges = np.concatenate(([0], np.cumsum(size)))
        if edges[-1] != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        return Encoded([*ids, self.end_id], at[edges[:-1]], at[edges[1:]])

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def encode_spans(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, begins, ends (source bytes of each piece) and decoded, a row per row of ``docs``."""

    def run(batches):
        import pyarrow as pa

        codec = Codec(path)
        for batch in batches:
            rows = [(d, codec.encode(t.as_py())) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in rows], pa.int64()), pa.array([e.ids for _, e in rows], pa.list_(pa.int32())),
                pa.array([e.begins for _, e in rows], pa.list_(pa.int64())), pa.array([e.ends for _, e in rows], pa.list_(pa.int64())),
                pa.array([codec.decode(e.ids) for _, e in rows], pa.string()),
            ], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return C.map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spanned_bytes (source bytes within pieces): the digests of ``Codec``'s outputs."""

    def run(batches):
        import pyarrow as pa

        codec = Codec(path)
        names = [str(k) for k in range(codec.model.get_piece_size())]
        for batch in batches:
            n, a, b, spanned = [], [], [], []
            for text in batch.column("text"):
                got = codec.encode(text.as_py())
                n.append(len(got.ids))
                a.append(hashlib.sha256(" ".join([names[k] for k in got.ids]).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(got.ids).encode()).hexdigest())
                spanned.append(int((got.ends - got.begins).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(spanned, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"])

    return C.map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spanned_bytes bigint")
