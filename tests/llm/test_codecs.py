"""Operators 3, 6 and 7: token files, piece spans and page texts."""

import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from airloom.llm import html_extract, piece_codec, token_files

from .helpers import ODD_TEXTS, documents, sentence

P = pytest.importorskip("public_tokenizers")
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "x1,", "é9", "×", "à!", "'t ", "\n\n", "ȏ", " ", "  ", "\n", "\t", "é", "漢", "😀", "▁", " the", " ing", "\x00", "1", "'s", " 'll", "...", "　", "<s>", " ", "ﬁ"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join)


# Token files ---------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1600), st.integers(1, 32), st.integers(0, 40), st.integers(0, 2**32))
def test_shards_round_trip(n, bits, outliers, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    if n:
        ids[rng.integers(0, n, outliers)] = rng.integers(0, 2**32, outliers, dtype=np.uint64)
    shard = token_files.Shard(token_files.write_shard(np.array([-5, 7]), np.array([n // 2, n - n // 2]), ids, 99, 1))
    assert (shard.tokens() == ids).all() and (shard.start, shard.missing) == (99, 1) and shard.doc_ids.tolist() == [-5, 7]
    lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
    assert (shard.tokens(lo, hi) == ids[lo:hi]).all()
    if n:
        assert b"".join(token_files._pack_many(ids)) == b"".join(token_files.pack_block(ids[k:k + token_files.BLOCK]) for k in range(0, n, token_files.BLOCK))


def test_outliers_are_patched():
    ids = np.full(512, 100, np.uint32)
    ids[::2] = 107
    ids[5] = 4_000_000_000
    block = token_files.pack_block(ids)
    assert len(block) < 512 * 3 // 8 + 20 and (token_files.unpack_block(block, 0) == ids).all()
    with pytest.raises(ValueError):
        token_files.Shard(b"x" * 64)


@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=12))
def test_cached_encoding_is_the_library_s(plain_tokenizer, texts):
    global _cache
    _cache = globals().get("_cache") or token_files.WordCache(BPE)
    ids, n = _cache.encode_many([t.encode() for t in texts])
    wanted = [plain_tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in wanted] and ids.tolist() == [v for w in wanted for v in w]


def test_small_table_forgets(plain_tokenizer):
    cache = token_files.WordCache(BPE, pieces=3)
    cache._table = token_files.WordTable(True, bits=3, room=8000)
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = sentence(rng, 60, 50)
        assert cache.encode(text).tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids


LONG = " ".join(["long words 12,5 of it's naïve ×3 café—x\n\nand"] * 40_000)


def test_each_run_goes_through_the_model_once(monkeypatch):
    cache = token_files.WordCache(BPE)
    text = b"some words, 12 of them\nsome words, again " + b"and" + b" words" * 500
    one = cache.encode_many([text])[0].tolist()
    monkeypatch.setattr(cache, "_piece", None)
    assert cache.encode_many([text])[0].tolist() == one


def test_long_texts_in_parts(plain_tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 1 << 16)
    texts = [LONG[:300_000], LONG.replace(" ", "  ", 1)[:200_000], "x" * 200_000, "e\n\n\n", "", "\n\n\n\nb\n", "don't 'll--'s ''s 'S"]
    ids, n = token_files.WordCache(BPE).encode_many([t.encode() for t in texts])
    wanted = [plain_tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in wanted] and ids.tolist() == [v for w in wanted for v in w]


def test_token_files(spark, plain_tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 500)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 20_000)
    rows = [(k * 7 % 50, t) for k, t in enumerate(ODD_TEXTS * 3)] + [(None, "no id"), (None, "none either"), (-4, "minus"), (3, "again 3"), (3, "again 3")] + [(60, LONG)] + [(9, f"many of one id {k}") for k in range(30)]
    docs = documents(spark, rows).selectExpr("*", "1 as part", "2 as h", "3 as name", "4 as start")
    shards, folder = token_files.write_tokens(docs, BPE)
    got = token_files.read_tokens(shards, folder).orderBy("start").collect()
    wanted = {}
    for k, text in rows:
        ids = np.array(plain_tokenizer.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID], "<u4")
        wanted.setdefault(k, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    found, start = {}, 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
    files = sorted(f for f in os.listdir(folder.removeprefix("file://")))
    opened = [token_files.Shard(open(os.path.join(folder.removeprefix("file://"), f), "rb").read()) for f in files]
    assert len(files) > 3 and all(f.endswith(".pfr") for f in files) and sum(s.n_tokens for s in opened) == start and sum(s.missing for s in opened) == 2
    bases = {r.part: r.base for r in token_files.starts_of(shards).collect()}
    assert [bases[int(f[:8])] + s.start for f, s in zip(files, opened, strict=True)] == np.cumsum([0] + [s.n_tokens for s in opened[:-1]]).tolist()
    assert token_files.token_files(documents(spark, rows).limit(0), BPE).count() == 0


# Pieces -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(PIECES)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces(codec, library, text):
    got, raw = codec.encode(text), text.encode()
    assert got.ids == library.encode(text, add_eos=True) and codec.decode(got.ids) == library.decode(got.ids)
    assert list(got.begins[1:]) == list(got.ends[:-1]) and (not len(got.ends) or (got.begins[0] == 0 and got.ends[-1] == len(raw)))
    for b, e, piece in zip(got.begins, got.ends, library.encode(text, return_type="proto").pieces, strict=True):
        assert piece.piece.startswith("<0x") or raw[b:e] == piece.surface.encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize(("dummy", "collapse"), [(False, False), (True, False), (False, True), (True, True)])
def test_normaliser(rule, dummy, collapse):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec = proto.normalizer_spec
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = dummy, collapse, True
    theirs = sentencepiece.SentencePieceNormalizer(model_proto=proto.SerializeToString())
    ours = piece_codec.Normaliser(piece_codec.CharacterMap(spec.precompiled_charsmap), dummy, collapse, True, False)

    @settings(max_examples=120, deadline=None)
    @given(st.lists(st.sampled_from([a for a in ALPHABET if a != "\x00"] + ["Å", "Ⅷ", "é", "ｱﾞ", "Straße", "①"]), max_size=10).map("".join))
    def agree(text):
        wanted, offsets = theirs.normalize(text, with_offsets=True)
        got, at = ours(text.encode())
        assert got.decode() == wanted
        if wanted:
            places, k = [], 0
            for c in wanted:
                places.append(int(at[k]))
                k += len(c.encode())
            assert places == [len(text[:o].encode()) for o in offsets][:len(places)]

    agree()


def test_encode_spans(spark, codec):
    docs = documents(spark, list(enumerate(ODD_TEXTS)) + [(None, "no id")])
    spans = {r.doc_id: r for r in piece_codec.encode_spans(docs, PIECES).collect()}
    digests = {r.doc_id: r for r in piece_codec.encode_digests(docs, PIECES).collect()}
    for k, text in enumerate(ODD_TEXTS):
        assert spans[k].decoded == (text or "") and spans[k].ids == codec.encode(text).ids
        assert digests[k].n_tokens == len(spans[k].ids) and digests[k].spanned_bytes == len((text or "").encode())
    assert piece_codec.encode_digests(docs.limit(0), PIECES).count() == 0


# Pages -------------------------------------------------------------------------------
def page(body, host="a.example"):
    return f"http://{host}/1", f"<html><head><title>T</title><script>if (a<b) '</p>'</script></head><body>{body}</body></html>"


CASES = [
    ("<article><h1>A &amp; B</h1><p>One  two\n three<p>Four<br>five</article><footer>f</footer>", "A & B\n\nOne two three\n\nFour five"),
    ("<nav><a href=x>m</a></nav><main><p>Text &lt;b&gt; <b>bold</b>.</p><aside>s</aside><ul><li>x<li>y</ul></main>", "Text <b> bold.\n\nx\n\ny"),
    ("<article><p>Keep</p><div class='ad-box'>buy</div><div id=comments><p>nice</p></div><form>f<input></form><p>this</p></article>", "Keep\n\nthis"),
    ("<header><h1>Site</h1></header><article><header><h2>Head</h2></header><p>Body text</p></article>", "Head\n\nBody text"),
    ("<article><p>a<!-- x > <p>no</p> -->b</p><style>p{}</style><p hidden>h</p></article>", "ab"),
    ("<div class=sidebar>s s s</div><div class='post-body'><div><p>Long enough text here</p><p>and more</p></div></div>", "Long enough text here\n\nand more"),
    ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<article><table><tr><td>c1<td>c2<tr><td>c3</table></article>", "c1\n\nc2\n\nc3"),
    ("<article><p>a < b and c > d</p></div></article><p>after</p>", "a < b and c > d"),
]


@pytest.mark.parametrize(("body", "wanted"), CASES)
def test_pages(body, wanted):
    assert html_extract.Page(page(body)[1]).text(None) == wanted


def test_hosts_vote(spark):
    story = "<div class='x'><div class='story-{}'><p>{}</p></div><div class='extra'><p>{}</p></div></div>"
    rows = [(k, *page(story.format(k, "main text " * 30, "side " * 3), "h.example")) for k in range(5)]
    rows.append((5, *page(story.format(5, "short", "but this side note is long here " * 20), "h.example")))  # outvoted
    rows += [(6, None, None), (7, "not a url [", "<p>x"), (8, *page(CASES[0][0], "b.example")), (9, "http://h.example/z", "<article>Own</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r for r in html_extract.main_text(pages.selectExpr("*", "1 as path", "2 as host")).collect()}
    assert len(got) == 10 and got[0].path.endswith("/div.x/div.story-")
    assert got[5].text == "short" and got[6].text == "" and got[7].text == "x" and got[8].text == CASES[0][1] and got[9].text == "Own"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.main_text(pages.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<", ">", "\"", "'", "x ", "<!--", "-->", "<li>", "</ul>", "<article>", "&amp;", "<a href='", "<script>", "</script>", "<br/>", "<td>"]), max_size=25).map("".join))
def test_any_markup_is_read(markup):
    p = html_extract.Page(markup)
    assert isinstance(p.text(None), str) and len(p.parents) == len(p.paths) == len(p.tags)
