"""Operator 10, quality classifier: a generalised additive model with pairwise interactions.

Method: each text gets ``FEATURES`` numbers, each cut into at most ``BINS`` bins at quantiles of the training rows.
Boosting goes round the features in turn; each step fits a tree of depth two on one feature's bins to the gradient
and adds it to that feature's lookup table. Then the ``PAIRS`` pairs whose residual gains most get tables of their
own on coarser bins, boosted round in turn by trees that split either feature once. A score is the sigmoid of the
intercept and one table entry per feature and pair, looked up for whole arrow batches at a time.

Fitted in numpy on a bounded sample of labelled rows (``MAX_LABELLED``); only their feature numbers reach the driver.

Defined results: null and empty texts have all-zero features and are scored by them; repeated rows are scored alike;
rows without doc_id are scored and never learned from; an empty table gives no rows; without labels every score is
0.5, with labels of one class it is near that class. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import common as C
from .quality_rules import dup_lines, repeat_words

FEATURES = ("words", "word_bytes", "symbols", "dup_lines", "repeats", "capitals", "digits", "points", "distinct", "line_words", "blanks", "beyond_ascii", "bars", "short_words", "long_words", "blank_lines")
MAX_LABELLED = 12_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
THRESHOLD = 0.3
FOLDS = 5
HELD_OUT = 0


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _members(b"#*$%&|<>"), _members(bytes(range(65, 91))), _members(b"0123456789"), _members(b".,;:!?\"'()-"),
    _members(C.SPACES), _members(bytes(range(128, 256))), _members(b"|"), _members(b"\n"), _members(bytes(range(65, 91)) + bytes(range(97, 123))),
])


def text_features(raw: bytes) -> list[float]:
    """The FEATURES of a text given as UTF-8."""
    if not raw:
        return [0.0] * len(FEATURES)
    symbols, capitals, digits, points, blanks, beyond, bars, lines, letters = (_CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)).tolist()
    starts, ends = C.word_bounds(raw)
    n, size = len(starts), len(raw)
    if not n:
        return [0.0] * 10 + [blanks / size] + [0.0] * 5
    words, length = C.word_hashes(raw), ends - starts
    empty = raw.count(b"\n\n")
    return [
        float(np.log1p(n)), float(length.mean()), symbols / size, dup_lines(raw) / (lines + 1), repeat_words(words) / n, capitals / max(1, letters), digits / size, points / size,
        len(np.unique(words)) / n, float(np.log1p(n / (lines + 1))), blanks / size, beyond / size, bars / n, float((length <= 3).mean()), float((length >= 15).mean()), empty / (lines + 1),
    ]


def _features(batch) -> np.ndarray:
    rows = [text_features(raw or b"") for raw in C.raw_texts(batch, "text")]
    return np.array(rows, float).reshape(-1, len(FEATURES))


@dataclass
class Model:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Adds up the table entries of all rows at once."""
        out = np.full(len(x), self.intercept)
        for k, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cut, x[:, k], side="right")]
        coarse = [np.searchsorted(cut, x[:, k], side="right") for k, cut in enumerate(self.pair_cuts)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[coarse[a], coarse[b]]
        return out


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges at quantiles, between different values."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _split(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, int]:
    """Gain and place of the best cut of bins with summed gradient and curvature; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(np.clip(-g.sum() / (h.sum() + 1.0), -4, 4))


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step of a tree of some depth over ordered bins, for each bin."""
    _, k = _split(g, h) if depth else (0, 0)
    if not k:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate((tree(g[:k], h[:k], depth - 1), tree(g[k:], h[k:], depth - 1)))


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of a tree over a grid: it cuts one axis, then the other axis in each part."""
    best, out = 0.0, np.full(g.shape, _leaf(g, h))
    root = g.sum() ** 2 / (h.sum() + 1.0)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, a.shape[0]):
            step, gain = np.empty(a.shape), -root
            for part in (slice(0, k), slice(k, None)):
                gp, hp = a[part].sum(axis=0), b[part].sum(axis=0)
                _, j = _split(gp, hp)
                for cols in ((slice(0, j), slice(j, None)) if j else (slice(None),)):
                    step[part, cols] = _leaf(gp[cols], hp[cols])
                    gain += gp[cols].sum() ** 2 / (hp[cols].sum() + 1.0)
            if gain > best:
                best, out = gain, step if axis == 0 else step.T
    return best, out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15) -> Model:
    """Cyclic boosting of the feature tables, then of the chosen pairs' tables."""
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(mean / (1 - mean))), [_cuts(c, BINS) for c in x.T], [], [], [_cuts(c, PAIR_BINS) for c in x.T], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    margin = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for b, table in zip(bins, model.tables, strict=True):
            p = C.sigmoid(margin)
            step = rate * tree(np.bincount(b, p - y, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            margin += step[b]
    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    p = C.sigmoid(margin)
    gains = [(pair_tree(grid(a, b, p - y), grid(a, b, p * (1 - p)))[0], a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, key=lambda z: (-z[0], z[1:]))[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            p = C.sigmoid(margin)
            step = rate * pair_tree(grid(a, b, p - y), grid(a, b, p * (1 - p)))[1]
            table += step
            margin += step[coarse[a], coarse[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fits on at most ``max_labelled`` labelled documents that aren't held out; None without any."""
    rows = labels.where(C.remainder("doc_id", FOLDS) != HELD_OUT).where(C.remainder("doc_id", FOLDS) >= 0)
    ids = C.bounded_ids(rows.selectExpr("doc_id", "cast(quality as int) as y"), max_labelled, 1010)
    names = [f"f{k}" for k in range(len(FEATURES))]
    found = C.in_batches(C.sample_with_text(docs, ids).select("doc_id", "text", "y"), lambda b: {"y": b.column("y"), **dict(zip(names, _features(b).T, strict=True))}, "y int, " + ", ".join(f"{n} double" for n in names))
    rows = np.array(sorted(tuple(r) for r in found.collect()), float).reshape(-1, len(FEATURES) + 1)
    return train(rows[:, 1:], rows[:, 0]) if len(rows) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``."""

    def run(batch):
        x = _features(batch)
        scores = np.full(len(x), 0.5) if model is None else C.sigmoid(model.margin(x))
        return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

    return C.in_batches(docs.select("doc_id", "text"), run, "doc_id bigint, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (C.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
