"""Scores by slow forms of the same models, votes with ties, and the cases that every operator must handle."""

import math
import re

import numpy as np
import pytest

from airloom.llm import chunk_dedup, common as C, decontaminate, html_extract, language_id, minhash_dedup, piece_codec, quality_gam, quality_rules, token_files, toxicity

from .helpers import ODD_TEXTS, documents, sentence

P = pytest.importorskip("public_tokenizers")
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(61)
    rows = []
    for k in range(160):
        parts = [sentence(rng, int(rng.integers(4, 25)), 300) for _ in range(int(rng.integers(1, 8)))]
        if k % 3 == 0:
            parts[int(rng.integers(len(parts)))] += " vile scum"
        if k % 4 == 1:
            parts = [p.upper() + " ### $$ |" for p in parts]
        rows.append((k, ". ".join(parts) + ("!\n" if k % 2 else "."), "xx" if k % 2 else "yy"))
    rows += [(500 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "no id here"), (3, "another text of three"), (3, rows[3][1])]
    labels = [(k, int(k % 4 != 1), int(k % 3 == 0)) for k in range(160)] + [(3, None, None), (None, 1, 1), (9999, 1, 0)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-40, min(40, x))))


def test_rules_by_brute_force(spark, labelled):
    docs, labels, rows = labelled
    model = quality_rules.fit(docs, labels)

    def kept(text):
        raw = (text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        twice, seen = set(), {}
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k:k + 3]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                twice |= {k + j for k in places for j in range(3)}
        if len(words) < 50 or 100 * len(twice) > 50 * len(words):
            return False
        margin = model.bias
        for kind, found in enumerate(quality_rules.ngram_buckets(raw, C.word_hashes(raw))):
            if len(found):
                margin += 30.0 * sum(float(model.weights[kind][b]) for b in found.tolist()) / len(found)
        return sigmoid(model.slope * margin + model.shift) >= quality_rules.KEEP_FROM

    got = [(r.doc_id, r.kept) for r in quality_rules.score(docs, model).collect()]
    assert sorted(got, key=str) == sorted(((k, kept(t)) for k, t, *_ in rows), key=str) and sum(v for _, v in got) > 40


def test_toxicity_by_brute_force(spark, labelled):
    docs, labels, rows = labelled
    model = toxicity.fit(docs, labels)

    def slow(text):
        left = 1.0
        parts = [s for s in re.split(r"(?<=[.!?])[ \t-\r]+|\n", text or "") if s.strip(" \t\n\x0b\x0c\r")] or [""]
        for part in parts:
            of, at, n = toxicity.features(part.encode())
            assert n == 1
            left *= 1 - sigmoid(float(sum(float(model.weights[b]) for b in set(at.tolist()))) + model.bias)
        return 1 - left

    got = toxicity.score(docs.where("doc_id < 160"), model).collect()
    texts = {}
    for k, t, *_ in rows:
        texts.setdefault(k, []).append(slow(t))
    for r in got:
        assert min(abs(r.score - s) for s in texts[r.doc_id]) < 1e-4 and r.predicted == int(r.score >= 0.3)
    assert np.mean([(r.doc_id % 3 == 0) == bool(r.predicted) for r in got if r.doc_id != 3]) > 0.85


def test_gam_by_brute_force(spark, labelled):
    docs, labels, rows = labelled
    model = quality_gam.fit(docs, labels)

    def slow(text):
        x = quality_gam.text_features((text or "").encode())
        place = lambda cuts, v: sum(1 for c in cuts if c <= v)
        total = model.intercept + sum(float(t[place(c, v)]) for c, t, v in zip(model.cuts, model.tables, x, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += float(t[place(model.pair_cuts[a], x[a]), place(model.pair_cuts[b], x[b])])
        return round(sigmoid(total), 9)

    got = sorted(((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in quality_gam.score(docs, model).collect()))
    assert got == sorted((k is None, k or 0, slow(t)) for k, t, *_ in rows)


def test_language_by_brute_force(spark, labelled):
    docs, _, rows = labelled
    net = language_id.fit(docs)
    for r in language_id.score(docs.where("doc_id between 20 and 60"), net).collect():
        raw = rows[r.doc_id][1].encode()
        total = np.zeros(len(net.languages))
        for at in range(0, len(raw), language_id.WINDOW):
            part = raw[at:at + language_id.WINDOW]
            total += net.probabilities(np.frombuffer(part.ljust(language_id.WINDOW, b"\0"), np.uint8)[None])[0] * len(part)
        assert r.lang_pred == net.languages[int(total.argmax())] and r.score == pytest.approx(total.max() / total.sum(), abs=1e-6)


def test_samples_are_the_smallest_hashes(spark):
    rows = spark.range(3000).selectExpr("id % 1000 as doc_id", "cast(id % 2 as int) as y")
    few, many = C.bounded_ids(rows, 20, 7).collect(), C.bounded_ids(rows, 900, 7).collect()
    assert [r.doc_id for r in few] == [r.doc_id for r in many][:20] and len(many) == 900 and all(r.y == r.doc_id % 2 for r in many)
    assert len(C.bounded_ids(rows, 5000, 7).collect()) == 1000
    docs = documents(spark, [(k, "x" * (10 if k % 2 else 1000)) for k in range(40)] + [(1, "y" * 10), (2, None)])
    ids = C.bounded_ids(docs.selectExpr("doc_id", "1 as y"), 40, 3)
    got = C.sample_with_text(docs, ids, 1500).collect()
    assert sum(len(r.text) for r in got) <= 1500 and len({r.doc_id for r in got}) == len(got) == 21
    assert sorted(map(tuple, got)) == sorted(map(tuple, C.sample_with_text(docs.repartition(5), ids, 1500).collect()))


def test_ties_of_votes(spark):
    """Paths with as many votes: the one with more text wins, then the first by name."""
    one, two = "<div class='aa'><p>same text</p></div>", "<div class='bb'><p>same text</p></div>"
    long = "<div class='cc'><p>a longer same text</p></div>"
    pages = [(1, "http://t.example/1", one), (2, "http://t.example/2", two), (3, "http://u.example/1", one), (4, "http://u.example/2", long), (5, "http://U.example:80/3", "<p></p>")]
    got = {r.host: r.path for r in html_extract.host_paths(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {"t.example": "/div.aa", "u.example": "/div.cc"}


def test_marked_wrappers_keep_the_article():
    for wrapper in ("<article class='post category-social'>{}</article>", "<div class='wrapper sidebar-left'><main>{}</main></div>", "<main class='page-header-fixed'>{}</main>"):
        html = "<html><body>" + wrapper.format("<p>The article's text is here.</p><div class='comments'><p>nice</p></div><p>It ends.</p>") + "</body></html>"
        assert html_extract.Page.read(html).text(None) == "The article's text is here.\n\nIt ends."


LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(400_000))


def run_all(spark, docs, labels):
    """Each operator's main frame."""
    bench = spark.createDataFrame([(1, "word1x1 word2x2 word3x3 word4x4 word5x5 word6x6")], "item_id bigint, text string")
    return {
        "rules": quality_rules.quality_rules(docs, labels), "toxicity": toxicity.toxicity(docs, labels), "tokens": token_files.token_files(docs, BPE), "chunks": chunk_dedup.duplicate_spans(docs),
        "bench": decontaminate.contamination(docs, bench), "pieces": piece_codec.encode_digests(docs, PIECES), "near": minhash_dedup.near_duplicates(docs),
        "language": language_id.languages(docs), "gam": quality_gam.quality(docs, labels), "kept": quality_rules.keep_good(docs, labels), "cut": chunk_dedup.cut_repeats(docs),
        "one": minhash_dedup.keep_one(docs), "clean": decontaminate.drop_contaminated(docs, bench),
    }


def test_empty_tables(spark, labelled):
    docs, labels, _ = labelled
    for name, out in run_all(spark, docs.limit(0), labels).items():
        assert out.count() == 0, name
    none = run_all(spark, docs.where("doc_id < 4"), labels.limit(0))
    assert all(none[k].count() == 6 for k in ("rules", "toxicity", "gam", "language"))


def test_clashing_columns(spark, labelled):
    """Extra columns with the names that the operators use inside."""
    docs, labels, rows = labelled
    names = ["y", "rank", "h", "held_out", "score", "predicted", "n_tokens", "start", "key", "rep", "root", "part", "bucket", "host", "path", "probability", "kept", "component_id", "th", "set_key", "windows", "at", "of", "n"]
    wide = docs.selectExpr("*", *[f"'z' as {n}" for n in names])
    tags = labels.selectExpr("*", "1 as y", "2 as text", "3 as rank", "4 as h")
    for name, out in run_all(spark, wide, tags).items():
        n = out.count()
        assert n == len(rows) if name not in ("kept", "one", "clean") else 0 < n <= len(rows), name


def test_a_very_long_text(spark, labelled):
    docs, labels, _ = labelled
    rows = [(1, LONG), (2, "intro " + LONG[:1_000_000]), (3, "short text"), (4, LONG), (5, "x" * 3_000_000)]
    many = documents(spark, rows)
    out = run_all(spark, many, labels)
    got = {name: {r.doc_id: r for r in out[name].collect()} for name in ("rules", "tokens", "near", "pieces")}
    assert got["rules"][1].n_words == 400_000 and got["rules"][1].word_chars == len(LONG.replace(" ", ""))
    assert got["near"][4].component_id == 1 and not got["near"][4].kept and got["near"][5].n_shingles == 1
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    assert got["tokens"][1].n_tokens == len(library.encode(LONG, add_special_tokens=False).ids) + 1 == got["tokens"][4].n_tokens
    assert all(out[name].count() == 5 for name in ("toxicity", "chunks", "language", "gam", "bench"))
    texts = {r.doc_id: r.text for r in out["chunks"].collect()}
    assert texts[4] == "" and len(texts[1]) < len(LONG) / 10 and texts[3] == "short text"
