"""Operator 2, toxicity by multiple-instance learning.

Method: a text is a bag of sentences (cut at . ! ? and line ends). A sentence's margin is a bias plus the weights of
its distinct hashed words and word beginnings (of ``PREFIXES`` bytes); its score is the sigmoid of that, and the document's score is the
noisy-or 1 - prod(1 - p). The weights are trained through the noisy-or from document labels only, in numpy, on a
bounded sample of labelled rows (``MAX_LABELLED``, ``MAX_BYTES`` of text), with a part of the words left out at random
in each step (``LEFT_OUT``); words found in fewer than ``MIN_DOCS`` of them get no weight. A
sentence whose own score reaches ``THRESHOLD`` is reported with its byte span.

Defined results: null and empty texts, and texts without words, have one sentence without words, so they score
the sigmoid of the bias; repeated rows are scored alike; rows without doc_id are scored and never learned from; an
empty table gives no rows; without labels of both classes every score is 0. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common as C

#: Rows of the labelled sample at most.
MAX_LABELLED = 7000
#: Their text at most, in bytes.
MAX_BYTES = 24 << 20
#: Share of the words and beginnings that each step of the fit leaves out, so that one bad word is enough.
LEFT_OUT = 0.15
BUCKETS = 1 << 18
MIN_DOCS = 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
HELD_OUT = 2
FOLDS = 4
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]{}<>|*#&%$/\\-_")] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def sentences(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and past-the-end byte of each sentence with a word, and the sentence of each word."""
    starts, ends = C.word_bounds(raw)
    if not len(starts):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    buf = np.frombuffer(raw, np.uint8)
    marks = np.concatenate(([0], np.cumsum(_END[buf])))
    # A word starts a sentence if an end stands between the word before and it: as its last letter or a line end.
    new = np.concatenate(([False], marks[starts[1:]] > marks[ends[:-1] - 1]))
    of = np.cumsum(new)
    first = np.concatenate(([0], np.flatnonzero(new)))
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], ends[last], of


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Sentence and bucket of each distinct word and word beginning of a sentence, and the number of sentences."""
    clean = raw.lower().translate(_CLEAN)
    starts, ends = C.word_bounds(clean)
    begin, _, of_all = sentences(raw)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), max(1, len(begin))
    words_at, _ = C.word_bounds(raw)
    of = of_all[np.searchsorted(words_at, starts, side="right") - 1]
    keys = [of * BUCKETS + (C.word_hashes(clean) >> np.uint64(46)).astype(np.int64)]
    buf = np.frombuffer(clean, np.uint8)
    beginning = np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        beginning = beginning * np.uint64(256) + buf[np.minimum(starts + k, len(buf) - 1)].astype(np.uint64)
        if k + 1 in PREFIXES:
            longer = ends - starts > k + 1
            bucket = C.mix64(beginning[longer] * np.uint64(8) + np.uint64(k)) >> np.uint64(46)
            keys.append(of[longer] * BUCKETS + bucket.astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key // BUCKETS, key % BUCKETS, len(begin)


_CLEAN = bytes(32 if _TRIM[b] else b for b in range(256))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, of: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return C.sigmoid(np.bincount(of, weights=self.weights[at], minlength=n) + self.bias)


def noisy_or(scores: np.ndarray) -> float:
    return float(1 - np.exp(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def _collect(batch) -> dict:
    got = [features(raw) for raw in C.raw_texts(batch, "text")]
    return {"y": batch.column("y"), "n": [n for _, _, n in got], "of": [a.astype(np.int32).tobytes() for a, _, _ in got], "at": [b.astype(np.int32).tobytes() for _, b, _ in got]}


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fits on at most ``max_labelled`` labelled documents that aren't held out."""
    rows = labels.where(C.remainder("doc_id", FOLDS) != HELD_OUT).selectExpr("doc_id", "cast(toxic as int) as y")
    ids = C.bounded_ids(rows, max_labelled, 202)
    bags = C.in_batches(C.sample_with_text(docs, ids, MAX_BYTES).select("doc_id", "text", "y"), lambda b: {"doc_id": b.column("doc_id"), **_collect(b)}, "doc_id bigint, y int, n int, of binary, at binary")
    rows = sorted(bags.collect(), key=lambda r: (r.doc_id, r.at))
    y = np.array([r.y for r in rows], float)
    if C.class_weights_off(y):
        return None
    of, at, n = [np.frombuffer(r.of, np.int32) for r in rows], [np.frombuffer(r.at, np.int32) for r in rows], np.array([r.n for r in rows])
    rows.clear()
    C.driver_released(docs.sparkSession)
    return train(of, at, n, y)


def train(of: list[np.ndarray], at: list[np.ndarray], n: np.ndarray, y: np.ndarray, steps: int = 130, decay: float = 5e-5) -> Model:
    """Full-batch fit of the noisy-or likelihood; empties the lists ``of`` and ``at``, whose rows it joins."""
    docs = np.zeros(BUCKETS, np.int64)
    for x in at:
        docs[np.unique(x)] += 1
    known = np.flatnonzero(docs >= MIN_DOCS)
    place = np.full(BUCKETS, -1, np.int64)
    place[known] = np.arange(len(known))
    base = np.concatenate(([0], np.cumsum(n)[:-1]))
    place = place.astype(np.int32)
    for k, b in enumerate(base):
        there = place[at[k]]
        of[k], at[k] = (of[k] + np.int32(b))[there >= 0], there[there >= 0]
    all_of, all_at = np.concatenate(of), np.concatenate(at)
    of.clear()
    at.clear()
    C.released()
    doc = np.repeat(np.arange(len(n)), n)
    total = int(n.sum())
    w = np.zeros(len(known))
    b = np.array([np.log(max(y.mean(), 1e-3) / max(n.mean(), 1)) - 3])
    adam = C.Adam([w, b], 0.12)
    rng = np.random.default_rng(5)
    blocks = C.slices(len(all_of))
    for _ in range(steps):
        margin, lefts = np.full(total, b[0]), []
        for k in blocks:
            lefts.append(rng.random(k.stop - k.start, np.float32) >= LEFT_OUT)
            margin += np.bincount(all_of[k][lefts[-1]], weights=w[all_at[k][lefts[-1]]], minlength=total)
        p = C.sigmoid(margin)
        s = np.bincount(doc, weights=-np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(n))
        pull = np.where(y > 0, -1 / np.expm1(np.clip(s, 1e-6, 50)), 1.0)  # derivative of the loss by the bag's sum
        g = np.clip(pull[doc], -1e4, 1) * p / len(n)
        slope = decay * np.sign(w)
        for k, left in zip(blocks, lefts, strict=True):
            slope += np.bincount(all_at[k][left], weights=g[all_of[k][left]], minlength=len(w))
        adam.step([slope, np.array([g.sum()])])
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = w
    return Model(weights, float(b[0]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted and the offending sentences' spans and scores: one row per row of ``docs``."""

    def run(batch):
        scores, spans = [], []
        for raw in C.raw_texts(batch, "text"):
            raw = raw or b""
            if model is None:
                scores.append(0.0)
                spans.append([])
                continue
            of, at, n = features(raw)
            each = model.sentence_scores(of, at, n)
            scores.append(noisy_or(each))
            bad = np.flatnonzero(each >= THRESHOLD)
            if len(bad) and of.size:
                begin, end, _ = sentences(raw)
                spans.append([{"start": int(begin[k]), "end": int(end[k]), "score": float(each[k])} for k in bad])
            else:
                spans.append([])
        return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores], "sentences": spans}

    return C.in_batches(docs.select("doc_id", "text"), run, "doc_id bigint, score double, predicted int, sentences array<struct<start:bigint,end:bigint,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (C.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted", "sentences")
