"""Operator 9, language identification by a small convolutional network over bytes.

Method: a text is cut into windows of ``WINDOW`` bytes, the last one padded with zeros. Filters of the widths in
``WIDTHS`` run over byte embeddings, each filter's largest response over the window (after a rectifier) is pooled,
and a softmax layer gives the languages. The network is trained in numpy by back-propagation on windows of a bounded
sample of rows with a language (``MAX_LABELLED`` rows, ``MAX_BYTES`` of text), all windows of each. At scoring, embedding and
filter are folded into one table per filter place, so a response is a sum of table rows; windows of an arrow batch go
through together, and a text's score is the mean over all its windows, weighted by their bytes.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the first language by name;
repeated rows are scored alike; rows without doc_id are scored and never learned from; null languages aren't learned;
an empty table gives no rows; with one language learned it is always predicted, with none every text is ``und``.
Other columns are ignored. Any length is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common as C

MAX_LABELLED = 1500
MAX_BYTES = 4 << 20
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
EPOCHS = 3
FOLDS = 4
HELD_OUT = 2
#: Windows that go through the network together.
TOGETHER = 256
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, one a row."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def has_letter(raw: bytes) -> bool:
    if len(raw.translate(None, _LETTERS)) < len(raw):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # width x EMBEDDING x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray  # pooled x languages
    out_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each width, width x 256 x FILTERS: a byte's share of the responses at each filter place."""
        return [np.einsum("be,wef->wbf", self.embedding, f).astype(np.float32) for f in self.filters]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        got = []
        for table, bias in zip(tables, self.biases, strict=True):
            width = len(table)
            size = x.shape[1] - width + 1
            response = table[0][x[:, :size]]
            for k in range(1, width):
                response += table[k][x[:, k:k + size]]
            got.append(np.maximum(response.max(axis=1) + bias, 0))
        return np.concatenate(got, axis=1)

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        z = self.pooled(x, tables or self.tables()) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 9) -> Network:
    """Mini-batch training with exact gradients through softmax, pooling, filters and embedding."""
    rng = np.random.default_rng(seed)
    pooled = FILTERS * len(WIDTHS)
    net = Network(
        languages, rng.normal(0, 0.3, (256, EMBEDDING)), [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 1 / np.sqrt(pooled), (pooled, len(languages))), np.zeros(len(languages)),
    )
    adam = C.Adam([net.embedding, *net.filters, *net.biases, net.out, net.out_bias], 0.01)
    for epoch in range(epochs):
        adam.rate = 0.01 if epoch < epochs - 1 else 0.003
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at:at + 64]
            b, t = x[rows], y[rows]
            n = np.arange(len(rows))
            tables, places, parts = net.tables(), [], []
            for table, bias in zip(tables, net.biases, strict=True):
                size = WINDOW - len(table) + 1
                response = sum(table[k][b[:, k:k + size]] for k in range(len(table)))
                top = response.argmax(axis=1)
                places.append(top)
                parts.append(np.take_along_axis(response, top[:, None], 1)[:, 0] + bias)
            flat = np.concatenate(parts, axis=1)
            hidden = np.maximum(flat, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[n, t] -= 1
            p /= len(rows)
            back = (p @ net.out.T) * (flat > 0)
            g_embedding, g_filters, g_biases = np.zeros_like(net.embedding), [], []
            for j, (f, top) in enumerate(zip(net.filters, places, strict=True)):
                g = back[:, j * FILTERS:(j + 1) * FILTERS]
                g_biases.append(g.sum(axis=0))
                g_filter = np.empty_like(f)
                for k in range(len(f)):  # only the pooled places carry a gradient
                    byte = b[n[:, None], top + k]
                    g_filter[k] = np.einsum("nf,nfe->ef", g, net.embedding[byte])
                    np.add.at(g_embedding, byte, g[:, :, None] * f[k].T[None])
                g_filters.append(g_filter)
            adam.step([g_embedding, *g_filters, *g_biases, hidden.T @ p, p.sum(axis=0)])
    return net


def _sampled(batch) -> dict:
    ids, langs, wins = [], [], []
    for doc, lang, raw in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), C.raw_texts(batch, "text"), strict=True):
        if not has_letter(raw):
            continue
        ids.append(doc)
        langs.append(lang)
        wins.append(windows(raw).tobytes())
    return {"doc_id": ids, "y": langs, "windows": wins}


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Network | None:
    """Fits on the windows of at most ``max_labelled`` documents that aren't held out and have a language."""
    rows = docs.where(C.remainder("doc_id", FOLDS) != HELD_OUT).where(C.remainder("doc_id", FOLDS) >= 0)
    ids = C.bounded_ids(rows.select("doc_id", F.col("lang").alias("y")), max_labelled, 909)
    found = C.in_batches(C.sample_with_text(docs, ids, MAX_BYTES).select("doc_id", "y", "text"), _sampled, "doc_id bigint, y string, windows binary").collect()
    if not found:
        return None
    found = sorted(found, key=lambda r: r.doc_id)
    languages = sorted({r.y for r in found})
    x = np.frombuffer(b"".join(bytes(r.windows) for r in found), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([languages.index(r.y) for r in found], [len(r.windows) // WINDOW for r in found])
    return train(x, y, languages)


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score: one row per row of ``docs``."""

    def run(batch):
        tables = net.tables() if net else None
        langs, scores = [], []

        def whole(part: list[bytes | None]) -> None:
            """Scores some texts; their windows go through together."""
            known = [i for i, raw in enumerate(part) if net and raw and has_letter(raw)]
            total = np.zeros((len(part), len(net.languages) if net else 1))
            if known:
                wins = [windows(part[i]) for i in known]
                of = np.repeat(known, [len(w) for w in wins])
                size = np.concatenate([np.append(np.full(len(w) - 1, WINDOW), len(part[i]) - WINDOW * (len(w) - 1)) for i, w in zip(known, wins, strict=True)])
                x = np.concatenate(wins)
                for at in range(0, len(x), TOGETHER):
                    to = slice(at, at + TOGETHER)
                    np.add.at(total, of[to], net.probabilities(x[to], tables) * size[to, None])
            for i, raw in enumerate(part):
                weight = total[i].sum()
                if weight > 0:
                    k = int(total[i].argmax())
                    langs.append(net.languages[k])
                    scores.append(float(min(1.0, total[i, k] / weight)))
                else:
                    langs.append("und")
                    scores.append(0.0)

        part, size = [], 0
        for raw in C.raw_texts(batch, "text"):
            part.append(raw)
            size += len(raw or b"")
            if size >= TOGETHER * WINDOW * 8:
                whole(part)
                part, size = [], 0
        whole(part)
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    return C.in_batches(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", "text", "lang")
    out = score(docs, fit(docs))
    return out.select("doc_id", (C.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
