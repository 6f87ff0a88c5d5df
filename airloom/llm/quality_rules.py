"""Operator 1, quality rules: fixed base rules, then a calibrated logistic regression over hashed n-grams.

Method: word 1- and 2-grams and character 3- and 4-grams (over UTF-8 bytes) of each whole text are hashed
into buckets; a logistic regression over their relative frequencies is fitted in numpy on a bounded sample of
labelled rows (``MAX_LABELLED``, ``MAX_BYTES`` of text), its margin is turned into a probability by a fitted sigmoid on rows held back
from the fit, and every text is scored in arrow batches against the fixed threshold ``KEEP_FROM``.

Defined results: a null text counts as an empty one (0 words, rejected by the base rules); documents without an
id are scored alike; repeated rows are scored each; an empty table gives no rows; without labels of both classes
the learned verdict is "keep". Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import common as C

#: Rows of the labelled sample at most; the fit needs no more, and the driver's memory is bounded by it.
MAX_LABELLED = 2500
#: Their text at most, in bytes.
MAX_BYTES = 16 << 20
#: Buckets of each of the four kinds of n-grams.
BUCKETS = 1 << 13
#: A text is kept if its calibrated probability of good quality is at least this.
KEEP_FROM = 0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_KINDS = 4
_SCALE = 30.0


def base_counts(raw: bytes, words: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text given as UTF-8."""
    words = C.word_hashes(raw) if words is None else words
    return (len(words), *_char_counts(raw), dup_lines(raw), repeat_words(words))


def _char_counts(raw: bytes) -> tuple[int, int]:
    follow = len(raw.translate(None, _LEADING))
    return len(raw) - follow - (len(raw) - len(raw.translate(None, C.SPACES))), len(raw) - len(raw.translate(None, SYMBOLS))


_LEADING = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(C.SPACES)]
    return len(lines) - len(set(lines))


def repeat_words(words: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    grams = C.shingle_hashes(words, 3)
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:k + len(grams)] |= twice
    return int(inside.sum())


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def ngram_buckets(raw: bytes, words: np.ndarray) -> list[np.ndarray]:
    """The bucket of every n-gram, by kind."""
    out = [_bucket(words), _bucket(C.shingle_hashes(words, 2) if len(words) > 1 else words[:0])]
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    for n in (3, 4):
        if len(b) < n:
            out.append(np.zeros(0, np.uint32))
            continue
        x = b[:len(b) - n + 1].copy()
        for k in range(1, n):
            x |= b[k:len(b) - n + 1 + k] << np.uint32(8 * k)
        x *= np.uint32(0x9E3779B1)
        out.append(x >> np.uint32(19))
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(51)).astype(np.uint32)


@dataclass
class Model:
    weights: np.ndarray  # kinds x buckets
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, buckets: list[np.ndarray]) -> float:
        return self.bias + _SCALE * sum(float(self.weights[k][x].mean()) for k, x in enumerate(buckets) if len(x))

    def probability(self, margin: float) -> float:
        return float(C.sigmoid(self.slope * margin + self.shift))


def _sparse(batch) -> dict:
    ids, vals = [], []
    for raw in C.raw_texts(batch, "text"):
        at, val = [], []
        for k, x in enumerate(ngram_buckets(raw, C.word_hashes(raw))):
            if len(x):
                n = np.bincount(x, minlength=BUCKETS)
                here = np.flatnonzero(n)
                at.append(here + k * BUCKETS)
                val.append(n[here] * (_SCALE / len(x)))
        ids.append(np.concatenate(at or [np.zeros(0)]).astype(np.int32))
        vals.append(np.concatenate(val or [np.zeros(0)]).astype(np.float32))
    return {"y": batch.column("y"), "at": [x.tobytes() for x in ids], "val": [x.tobytes() for x in vals]}


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fits on at most ``max_labelled`` labelled documents; None where both classes aren't found."""
    ids = C.bounded_ids(labels.selectExpr("doc_id", "cast(quality as int) as y"), max_labelled, 101)
    rows = C.in_batches(C.sample_with_text(docs, ids, MAX_BYTES).select("doc_id", "text", "y"), lambda b: {"doc_id": b.column("doc_id"), **_sparse(b)}, "doc_id bigint, y int, at binary, val binary")
    rows = sorted(rows.collect(), key=lambda r: (r.doc_id, r.at))
    y = np.array([r.y for r in rows], float)
    if C.class_weights_off(y):
        return None
    edges = np.cumsum([len(r.at) // 4 for r in rows])[:-1]
    at = np.split(np.frombuffer(b"".join(r.at for r in rows), np.int32), edges)
    val = np.split(np.frombuffer(b"".join(r.val for r in rows), np.float32), edges)
    rows.clear()  # the collected copies are as large again
    C.driver_released(docs.sparkSession)
    held = np.arange(len(y)) % 4 == 3
    if C.class_weights_off(y[held]) or C.class_weights_off(y[~held]):
        held = np.zeros(len(y), bool)
    use = np.flatnonzero(~held)
    model = _fit_linear([at[i] for i in use], [val[i] for i in use], y[use])
    scored = np.flatnonzero(held) if held.any() else use
    margins = np.array([model.bias + float((model.weights.ravel()[at[i]] * val[i]).sum()) for i in scored])
    model.slope, model.shift = calibrate(margins, y[scored])
    del at, val
    C.released()
    return model


def _fit_linear(at, val, y, steps: int = 100, decay: float = 1e-4) -> Model:
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in at])
    at, val = np.concatenate(at), np.concatenate(val)
    size = _KINDS * BUCKETS
    w, b = np.zeros(size), np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    adam = C.Adam([w, b], 0.05)
    blocks = C.slices(len(at))
    for _ in range(steps):
        z, short = np.full(len(y), b[0]), w.astype(np.float32)
        for s in blocks:
            z += np.bincount(row[s], weights=short[at[s]] * val[s], minlength=len(y))
        r = (C.sigmoid(z) - y) / len(y)
        pull, short = decay * w, r.astype(np.float32)
        for s in blocks:
            pull += np.bincount(at[s], weights=val[s] * short[row[s]], minlength=size)
        adam.step([pull, np.array([r.sum()])])
    return Model(w.reshape(_KINDS, BUCKETS).astype(np.float32), float(b[0]))


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the sigmoid that best maps margins to labels, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(steps):
        p = C.sigmoid(ab[0] * margins + ab[1])
        g = np.array([((p - t) * margins).sum() + 1e-3 * (ab[0] - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        ab -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def score(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, base_failed, probability, kept: one row per row of ``docs``."""

    def run(batch):
        out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")}
        for raw in C.raw_texts(batch, "text"):
            raw = raw or b""
            words = C.word_hashes(raw)
            n = base_counts(raw, words)
            failed = base_failed(n[0], n[4])
            p = 1.0 if model is None else model.probability(model.margin(ngram_buckets(raw, words)))
            for k, v in zip(out, (*n, failed, p, not failed and p >= keep_from), strict=True):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    return C.in_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labels, then scores every document."""
    return score(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    model = fit(docs, labels)
    names, schema = docs.columns, docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for raw in C.raw_texts(batch, "text"):
                raw = raw or b""
                words = C.word_hashes(raw)
                good = not base_failed(len(words), repeat_words(words))
                keep.append(good and (model is None or model.probability(model.margin(ngram_buckets(raw, words))) >= KEEP_FROM))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return C.map_batches(docs, run, schema).select(*[f"`{n}`" for n in names])
