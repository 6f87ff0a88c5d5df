"""Operators 1, 2, 9 and 10: rules, toxicity, language and quality scores."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from airloom.llm import common as C, language_id, quality_gam, quality_rules, toxicity

from .helpers import ODD_TEXTS, WORD, documents, sentence


def plain_counts(text):
    """The base counts by their definition."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab#|\n \t\x0b\x0cé漢 ")), max_size=60))
def test_base_counts(text):
    assert quality_rules.base_counts(text.encode()) == plain_counts(text)


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_base_counts_of_odd_texts(text):
    assert quality_rules.base_counts((text or "").encode()) == plain_counts(text)


def test_word_hashes_in_pieces(monkeypatch):
    text = ("ab cd\nefg  " * 50 + "z" * 9000 + " y").encode()
    whole = C.word_hashes(text)
    monkeypatch.setattr(C, "_PIECE", 64)
    assert (C.word_hashes(text) == whole).all() and len(set(whole.tolist())) == 5


@pytest.fixture(scope="module")
def corpus(spark):
    """Good prose, junk with symbols, and toxic prose with one bad sentence."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(400):
        kind = k % 4
        text = ". ".join(sentence(rng, 12) for _ in range(8)) + "."
        if kind == 1:
            text = " ".join(w + "###" for w in text.split())
        if kind == 2:
            text += " You are a vile " + ("idiot" if k % 8 == 2 else "moron") + " today. " + sentence(rng, 20) + "."
        rows.append((k, text))
        labels.append((k, int(kind != 1), int(kind == 2)))
    docs = documents(spark, rows + [(None, "no id here"), (1000, None), (1001, ""), (0, rows[0][1])])
    return docs, spark.createDataFrame(labels + [(0, 0, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int"), rows


def test_rules(spark, corpus):
    docs, labels, rows = corpus
    out = quality_rules.quality_rules(docs.withColumn("extra", docs.source), labels)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 404
    assert all(got[k].kept == (k % 4 != 1) for k in range(400) if k != 0)
    assert all((got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == plain_counts(t) for k, t in rows)
    assert got[1000].base_failed and not got[1001].kept and got[None].base_failed
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {2, 3, 4}


def test_rules_without_labels(spark, corpus):
    docs, labels, _ = corpus
    assert quality_rules.fit(docs, labels.limit(0)) is None
    out = quality_rules.score(docs, None)
    assert out.where("not base_failed and not kept").count() == 0
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_toxicity(spark, corpus):
    docs, labels, rows = corpus
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).where("doc_id is not null").collect()}
    right = [got[k].predicted == int(k % 4 == 2) for k in range(1, 400)]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in got.values())
    held = [got[k].predicted == int(k % 4 == 2) for k in range(1, 400) if got[k].held_out]
    assert 60 < len(held) < 140 and np.mean(held) > 0.95
    found = [k for k in range(2, 400, 4) if got[k].predicted and got[k].sentences]
    texts = dict(rows)
    spans = [texts[k].encode()[s.start:s.end].decode() for k in found for s in got[k].sentences]
    assert len(found) > 90 and np.mean(["vile" in s for s in spans]) > 0.95


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab.!? \n,é")), max_size=40))
def test_sentences_hold_all_words(text):
    raw = text.encode()
    begin, end, of = toxicity.sentences(raw)
    starts, ends = C.word_bounds(raw)
    assert len(of) == len(starts)
    for s, e, k in zip(starts, ends, of, strict=True):
        assert begin[k] <= s and e <= end[k]
    a, b, n = toxicity.features(raw)
    assert n == max(1, len(begin)) and (not len(a) or a.max() < n)


def test_noisy_or_gradient():
    """The trained model separates bags by one instance."""
    rng = np.random.default_rng(0)
    of = [np.array([0, 0, 1, 1]) for _ in range(200)]
    at = [np.array([rng.integers(5, 50), rng.integers(5, 50), 3 if k % 2 else 4, rng.integers(5, 50)]) for k in range(200)]
    model = toxicity.train(of, at, np.full(200, 2), np.arange(200) % 2.0)
    assert model.weights[3] > 3 > 0 >= model.weights[4] - 0.5
    assert toxicity.noisy_or(np.array([0.5, 0.5])) == pytest.approx(0.75)


def test_language(spark):
    rng = np.random.default_rng(2)
    sets = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuväö"}
    rows = []
    for k in range(300):
        lang = list(sets)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(list(sets[lang]), 5)) for _ in range(int(rng.integers(3, 120)))), lang))
    docs = documents(spark, rows + [(900, None, None), (901, "12 .. #", "aa"), (902, "", "bb"), (None, "abc abc abc", None)])
    got = {r.doc_id: r for r in language_id.languages(docs).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    held = [got[k].lang_pred == rows[k][2] for k in range(300) if got[k].held_out]
    assert len(held) > 40 and np.mean(held) > 0.95
    assert {r.lang_pred for r in language_id.score(docs, None).collect()} == {"und"}
    assert language_id.languages(docs.limit(0)).count() == 0


def test_convolution_is_folded_right():
    rng = np.random.default_rng(1)
    net = language_id.train(rng.integers(0, 256, (8, language_id.WINDOW), dtype=np.uint8), np.arange(8) % 2, ["a", "b"], epochs=1)
    x = rng.integers(0, 256, (3, language_id.WINDOW), dtype=np.uint8)
    slow = []
    for row in x:
        pooled = []
        for f, bias in zip(net.filters, net.biases, strict=True):
            e = net.embedding[row]
            at = [sum(e[t + k] @ f[k] for k in range(len(f))) for t in range(len(row) - len(f) + 1)]
            pooled.append(np.maximum(np.max(at, axis=0) + bias, 0))
        z = np.concatenate(pooled) @ net.out + net.out_bias
        slow.append(np.exp(z) / np.exp(z).sum())
    assert np.allclose(net.probabilities(x), slow, atol=1e-4)


def test_gam(spark, corpus):
    docs, labels, _ = corpus
    labels = labels.groupBy("doc_id").agg({"quality": "max"}).withColumnRenamed("max(quality)", "quality")
    got = {r.doc_id: r for r in quality_gam.quality(docs, labels).collect()}
    held = [got[k].predicted == int(k % 4 != 1) for k in range(400) if got[k].held_out]
    assert len(held) > 40 and np.mean(held) > 0.97 and len(got) == 403
    assert {r.score for r in quality_gam.score(docs, None).collect()} == {0.5}


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = np.zeros((3000, len(quality_gam.FEATURES)))
    x[:, 0], x[:, 1] = rng.uniform(-1, 1, 3000), rng.uniform(-1, 1, 3000)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_gam.train(x, y)
    assert (0, 1) in model.pairs and ((model.margin(x) > 0) == (y > 0)).mean() > 0.9


def test_calibration():
    rng = np.random.default_rng(6)
    margin = rng.normal(0, 2, 4000)
    y = (rng.uniform(size=4000) < C.sigmoid(0.5 * margin - 1)).astype(float)
    slope, shift = quality_rules.calibrate(margin, y)
    assert slope == pytest.approx(0.5, abs=0.08) and shift == pytest.approx(-1, abs=0.15)


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_odd_texts_have_features(text):
    raw = (text or "").encode()
    assert len(quality_gam.text_features(raw)) == len(quality_gam.FEATURES) and np.isfinite(quality_gam.text_features(raw)).all()
    assert len(quality_rules.ngram_buckets(raw, C.word_hashes(raw))) == 4
    assert toxicity.features(raw)[2] >= 1 and language_id.windows(raw).shape[1] == language_id.WINDOW


def test_fits_take_little_memory():
    """Temporary arrays of a step are of a block, not of all entries."""
    import tracemalloc

    rng = np.random.default_rng(9)
    y = np.arange(400) % 2.0
    of, at = [np.sort(rng.integers(0, 20, 5000)).astype(np.int32) for _ in y], [rng.integers(0, 50_000, 5000).astype(np.int32) for _ in y]
    val = [np.ones(5000, np.float32) for _ in y]
    size, peaks = 400 * 5000 * 8, []
    for run in (lambda: quality_rules._fit_linear([x % 8192 for x in at], val, y, steps=2), lambda: toxicity.train(of, at, np.full(400, 20), y, steps=2)):
        tracemalloc.start()
        run()
        peaks.append(tracemalloc.get_traced_memory()[1] / size)
        tracemalloc.stop()
    assert max(peaks) < 3.0, peaks
