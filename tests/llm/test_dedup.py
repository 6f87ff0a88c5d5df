"""Operators 4, 5 and 8: substrings, benchmark passages and near copies, against brute force."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from airloom.llm import chunk_dedup, decontaminate, minhash_dedup
from airloom.llm.components import components

from .helpers import ODD_TEXTS, documents, sentence, shingles, words


def brute_components(texts):
    """Smallest reachable id by links of 75 percent, over all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return {k: (len(sets[k]), root[k], root[k] == k) for k in texts}


def check_near(spark, texts):
    docs = documents(spark, list(texts.items())).withColumnRenamed("source", "set_key")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_near_copies(spark):
    rng = np.random.default_rng(8)
    base = [sentence(rng, int(n)) for n in rng.integers(3, 160, 25)]
    texts = {}
    for k in range(150):
        w = base[k % 25].split()
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
        texts[500 - k] = " ".join(w).upper() if k % 7 == 0 else " ".join(w)
    check_near(spark, texts | {1000 + k: t for k, t in enumerate(ODD_TEXTS)} | {2000: ODD_TEXTS[8], 2001: "A", 2002: "b c d", 2003: "B C D"})


def test_one_large_group_far_apart(spark):
    """Copies with many edits of a text that isn't there itself: links only between some."""
    rng = np.random.default_rng(9)
    base = sentence(rng, 120).split()
    texts = {}
    for k in range(160):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            w[at] = f"e{rng.integers(40)}"
        texts[k] = " ".join(w)
    check_near(spark, texts)


def test_chain(spark):
    """A component that only a chain of links holds together."""
    rng = np.random.default_rng(10)
    w = [f"c{k}" for k in range(100)]
    texts = {}
    for k in range(12):
        texts[50 - k] = " ".join(w)
        w[k * 8] = f"x{rng.integers(10**6)}"
    check_near(spark, texts)


def test_one_id_for_different_texts(spark):
    """A document of several texts links what is like any of them."""
    rng = np.random.default_rng(21)
    one, two, three, four = (sentence(rng, 60, 10**6) for _ in range(4))
    rows = [(1, one), (1, two), (2, one + " w"), (3, two + " w"), (7, three), (5, three), (5, four), (9, four + " w"), (9, ""), (8, one.upper()), (None, two + " x"), (None, four + " y"), (20, "")]
    got = {}
    for r in minhash_dedup.near_duplicates(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles > 0, r.component_id))
    assert got == {1: {(True, 1)}, 2: {(True, 1)}, 3: {(True, 1)}, 8: {(True, 1)}, 7: {(True, 5)}, 5: {(True, 5)}, 9: {(True, 5), (False, 9)}, None: {(True, 1), (True, 5)}, 20: {(False, 20)}}
    brute = brute_components({k: t for k, t in {10: one, 11: one + " w", 12: two}.items()})
    assert brute[11][1] == 10 and brute[12][1] == 12


def test_blocks_of_one_shingle(spark, monkeypatch):
    """Sets of one shingle that meet in blocks give the same links."""
    monkeypatch.setattr(minhash_dedup, "MEET", 3)
    test_one_large_group_far_apart(spark)


def test_keep_one(spark):
    docs = documents(spark, [(3, "a b c d e f"), (1, "A b c d e f"), (2, "other words that differ from all"), (None, "x y"), (4, None), (5, "")])
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "None"]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    root = {k: k for k in range(31)}
    for _ in range(31):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: r for k, r in root.items() if k != r}


def test_long_chain_of_links(spark):
    got = components(spark.range(200).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 200 and {r.root for r in got} == {0}


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 2**63, 60, dtype=np.uint64)
        b = np.concatenate((a[:int(rng.integers(0, 60))], rng.integers(0, 2**63, 30, dtype=np.uint64)))
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        x, y = (minhash_dedup.odd_sketch(v).view(np.uint64) for v in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y)) <= differ


# Substrings --------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("abcdé \n\t")), max_size=200))
def test_chunks_tile_the_text(text):
    raw = text.encode()
    begin, n, digests = chunk_dedup.chunks(raw)
    assert n.sum() == len(raw.split()) and len(begin) == len(n) == len(digests)
    if len(begin):
        edges = [*begin.tolist(), len(raw)]
        assert b"".join(raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)) == raw


def test_gear_hash_by_its_rule():
    raw = np.frombuffer(b"the quick brown fox jumps over it", np.uint8)
    h = 0
    for k, b in enumerate(raw):
        h = (2 * h + int(chunk_dedup._GEAR[b])) % 65536
        if k >= 15:
            assert chunk_dedup.gear_hash(raw)[k] == h


def test_cuts_resist_insertions():
    rng = np.random.default_rng(1)
    text = sentence(rng, 400)
    one = set(chunk_dedup.chunks(text.encode())[2].tolist())
    two = set(chunk_dedup.chunks(("some new words " + text).encode())[2].tolist())
    assert len(one & two) > 0.95 * len(one)


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(chunk_dedup, "PART_BYTES", 20_000)
    monkeypatch.setattr(chunk_dedup, "BUCKET_BYTES", 4_000)
    rng = np.random.default_rng(7)
    passage, line = sentence(rng, 60), sentence(rng, 10)
    rows = []
    for k in range(60):
        own = [sentence(rng, 80, 10**6), sentence(rng, 80, 10**6)]
        rows.append((k, f"{own[0]} {passage} {own[1]}" if k % 3 == 0 else f"{own[0]}\n{line}\n{own[1]}"))
    rows += [(100, rows[1][1]), (101, rows[1][1]), (102, None), (103, ""), (104, "x" * 5000), (None, rows[2][1]), (1, rows[1][1])]
    docs = documents(spark, rows)
    out = chunk_dedup.duplicate_spans(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    middle = " ".join(passage.split()[20:40])
    assert sum(middle in (r.text or "") for r in out) == 1 and middle in got[0].text
    for k in range(3, 60, 3):
        own = rows[k][1].split()
        assert own[:60] == got[k].text.split()[:60] and own[-60:] == got[k].text.split()[-60:] and got[k].held_by == [0] and 20 <= got[k].n_removed_words <= 60
        (span,) = got[k].spans
        raw = rows[k][1].encode()
        assert (raw[:span.start] + raw[span.end:]).decode() == got[k].text
    assert all(got[k].text == rows[k][1] for k in range(60) if k % 3 and k != 1)
    assert got[100].text == got[101].text == "" == got[103].text and got[102].text is None and got[None].text == ""
    assert sorted(len(r.text) for r in out if r.doc_id == 1) == [0, len(rows[1][1])]
    docs = docs.selectExpr("*", "1 as part", "2 as bucket", "3 as digests")
    cut = chunk_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.where("n_chars <> length(text)").count() == 0
    assert chunk_dedup.duplicate_spans(docs.limit(0)).count() == 0


def test_passage_of_chunks_seen_before(spark):
    """The chunks of each passage were first seen in many documents; only one of them holds it whole."""
    rng = np.random.default_rng(15)
    passages = [sentence(rng, 56, 300) for _ in range(6)]
    lines = [sentence(rng, 9, 300) for _ in range(8)]
    rows = []
    for p in passages:
        w = p.split()
        rows += [(len(rows) + k, f"a{k} " + " ".join(w[5 * k:5 * k + 12]) + f" z{len(rows)}") for k in range(10)]
    rows += [(len(rows) + k, f"q{k}\n{line}\ny{k}") for k, line in enumerate(lines)]
    rows += [(len(rows) + k, sentence(rng, 150, 300)) for k in range(150)]
    block = "\n".join(lines)
    first = len(rows)
    planted = passages + [block]
    rows += [(first + k, f"{sentence(rng, 30, 10**6)}\n{p}\n{sentence(rng, 30, 10**6)}") for k, p in enumerate(planted * 2)]
    got = {r.doc_id: r for r in chunk_dedup.duplicate_spans(documents(spark, rows)).collect()}
    for k, p in enumerate(planted):
        one, two = got[first + k], got[first + len(planted) + k]
        assert p in one.text and two.held_by == [first + k] and two.n_removed_words >= len(p.split()) - 8, (k, two.n_removed_words)


def brute_cuts(rows):
    """For each row the chunks that lie in a stretch of 20 words or more of whole chunks that stands earlier."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], (rows[i][1] or "").encode()))
    seen, cuts = set(), {}
    for i in order:
        raw = (rows[i][1] or "").encode()
        begin, n, _ = chunk_dedup.chunks(raw)
        edges = [*begin.tolist(), len(raw)]
        parts = [tuple(raw[a:b].split()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        cut, own = set(), []
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                size = sum(map(len, parts[a:b]))
                if size >= 20:
                    own.append((tuple(parts[a:b]), a, b))
                if size >= 45:
                    break
        for name, a, b in own:
            if name in seen:
                cut |= set(range(a, b))
            seen.add(name)
        cuts[i] = b"".join(raw[x:y] for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if k not in cut).decode()
    return cuts


def test_substrings_by_brute_force(spark, monkeypatch):
    """Every stretch that stands earlier goes, and nothing else: compared with all stretches of all rows."""
    monkeypatch.setattr(chunk_dedup, "PART_BYTES", 3_000)
    monkeypatch.setattr(chunk_dedup, "BUCKET_BYTES", 1_000)
    rng = np.random.default_rng(44)
    pool = [sentence(rng, int(n), 400) for n in rng.integers(8, 90, 14)]
    rows = []
    for k in range(120):
        parts = [pool[int(rng.integers(len(pool)))] if rng.random() < 0.45 else sentence(rng, int(rng.integers(5, 40)), 400) for _ in range(int(rng.integers(1, 6)))]
        cut = [" ".join(p.split()[int(rng.integers(0, 6)):]) if rng.random() < 0.3 else p for p in parts]
        rows.append((k, ("\n" if k % 4 == 0 else " ").join(cut) + f" end{k} of it"))
    pieces = sentence(rng, 75, 10**6).split()
    rows += [(200 + k, f"{sentence(rng, 30)} {' '.join(pieces[15 * k:15 * k + 15])} {sentence(rng, 30)}") for k in range(5)]
    rows += [(300 + k, f"{sentence(rng, 30)} {' '.join(pieces)} {sentence(rng, 30)}") for k in range(3)]
    docs = documents(spark, rows)
    got = {r.doc_id: r.text for r in chunk_dedup.duplicate_spans(docs).collect()}
    wanted = {rows[i][0]: text for i, text in brute_cuts(rows).items()}
    assert got == wanted and sum(len(t) for t in wanted.values()) < sum(len(t) for _, t in rows) - 2000


def test_slices_give_the_same_cuts(spark, monkeypatch):
    monkeypatch.setattr(chunk_dedup, "SLICE", 3)
    test_substrings_by_brute_force(spark, monkeypatch)


def test_texts_are_dealt_once(spark):
    plan = chunk_dedup.duplicate_spans(documents(spark, [(1, "a b c")]))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text


def test_short_texts_copied_whole(spark):
    rows = [(1, "a short text"), (2, "x" * 300), (3, "A short text"), (4, "a short text"), (5, "x" * 300), (6, f"a short text\n{'y ' * 5}"), (7, " "), (8, " ")]
    got = {r.doc_id: (r.text, r.held_by) for r in chunk_dedup.duplicate_spans(documents(spark, rows)).collect()}
    assert got == {k: ("", [k - 3]) if k in (4, 5) else (t, []) for k, t in rows}


def test_runs_reach_every_repeated_chunk():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 9, 400)
    row = np.sort(rng.integers(0, 12, 400))
    digests = rng.integers(1, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, 400)]
    lo, hi, found = chunk_dedup.runs(row, words, digests)
    names = [tuple(digests[a:b].tolist()) for a, b in zip(lo, hi, strict=True)]
    assert len(set(names)) == len(set(found.tolist())) == len(set(zip(names, found.tolist(), strict=True)))
    assert all(row[a] == row[b - 1] and words[a:b].sum() >= 20 for a, b in zip(lo, hi, strict=True))
    for a in range(400):
        for b in range(a + 1, 400):
            if row[a] != row[b - 1] or words[a:b].sum() > 60:
                break
            if words[a:b].sum() >= 20:
                inside = (lo >= a) & (hi <= b)
                assert lo[inside].min() == a and hi[inside].max() == b


# Benchmark passages ----------------------------------------------------------------
def brute_windows(text, item):
    """The best weighted similarity of an item with any window of its size."""
    def grams(w):
        return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))

    w, i = words(text), words(item)
    best, want = 0.0, grams(i)
    for p in range(-len(i) + 1, len(w)):
        have = grams(w[max(p, 0):p + len(i)])
        union = sum((have | want).values())
        best = max(best, sum((have & want).values()) / union if union else 0.0)
    return best


def test_contamination(spark):
    rng = np.random.default_rng(12)
    items = [sentence(rng, int(n)) for n in rng.integers(6, 60, 12)] + ["too few words", None, "a a a a a a a a a a"]
    rows = []
    for k in range(90):
        w = words(items[k % 12])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = "zz"
        inside = " ".join(w) if k % 3 else ""
        rows.append((k, f"{sentence(rng, int(rng.integers(0, 40)))} {inside} {sentence(rng, int(rng.integers(0, 40)))}"))
    rows += [(200 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(300, items[0].upper()), (301, "too few words"), (None, items[1]), (302, "b a a a a a a a a a a b")]
    docs = documents(spark, rows).withColumnRenamed("source", "key")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        wanted = {k for k, i in enumerate(items) if text and i and len(words(i)) >= 5 and brute_windows(text, i) >= 0.75}
        assert set(r.item_ids) == wanted and r.kept == (not wanted), (r.doc_id, r.item_ids, wanted)
    docs = docs.selectExpr("*", "1 as hit_key", "2 as hit_id", "3 as content", "4 as wh")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert decontaminate.contamination(docs, bench.limit(0)).where("not kept").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_no_python_in_the_plan(spark):
    docs = documents(spark, [(1, "a b c d e f g")])
    plan = decontaminate.contamination(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_simhash_by_its_rule(spark):
    rng = np.random.default_rng(2)
    hashes = [[int(v) for v in rng.integers(-2**63, 2**63, n)] for n in (1, 2, 7, 40)]
    df = spark.createDataFrame([(h,) for h in hashes], "wh array<bigint>")
    for h, r in zip(hashes, df.select("wh", decontaminate.simhash("wh").alias("f")).collect(), strict=True):
        bits = sum(1 << b for b in range(64) if 2 * sum((v >> b) & 1 for v in r.wh) > len(r.wh))
        assert r.f & (2**64 - 1) == bits and len(h)


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(5)
    for _ in range(500):
        x = int(rng.integers(0, 2**63))
        y = x
        for b in rng.choice(64, decontaminate.RADIUS, replace=False):
            y ^= 1 << int(b)
        assert any(((x ^ y) >> (8 * k) & 255).bit_count() <= decontaminate.OFF for k in range(8))


def test_all_windows_at_the_threshold_are_found(spark):
    """Items changed as far as the similarity allows: at one end, at both, or inside."""
    rng = np.random.default_rng(33)
    items, rows = [], []
    for k in range(40):
        w = sentence(rng, int(rng.integers(20, 130)), 10**6).split()
        items.append(" ".join(w))
        n = (len(w) - 4) // 7
        for kind in range(3):
            x = list(w)
            if kind < 2:
                tail = n if kind == 0 else n // 2
                x[len(x) - tail:] = [f"t{k}"] * tail
                x[:n - tail] = [f"h{k}"] * (n - tail)
            else:
                for at in range(n // 5):
                    x[(at + 1) * len(x) // (n // 5 + 1)] = "i"
            rows.append((len(rows), " ".join(x)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.contamination(documents(spark, rows), bench).collect()}
    wanted = {k: [k // 3] if brute_windows(t, items[k // 3]) >= 0.75 else [] for k, t in rows}
    assert sum(map(len, wanted.values())) > 100 and sum(got[k] != v for k, v in wanted.items()) <= 1


def test_items_with_their_parts_in_another_order(spark):
    """Windows count wherever the shared shingles stand in the item, also cut at the text's start or end."""
    rng = np.random.default_rng(44)
    items, rows = [], []
    for k in range(12):
        w = sentence(rng, int(rng.integers(50, 90)), 10**6).split()
        items.append(" ".join(w))
        a, b = len(w) // 3, 2 * len(w) // 3
        swapped = [w[len(w) // 2:] + w[:len(w) // 2], w[b:] + w[a:b] + w[:a], w[a:b] + w[b:] + w[:a], w[b:] + w[:a]]
        rows += [(10 * k + j, " ".join(f"{'x ' * before}".split() + part + ["y"] * after)) for j, (part, before, after) in enumerate(zip([*swapped, swapped[0]], (9, 0, 30, 4, 0), (5, 20, 0, 9, 0), strict=True))]
        rows += [(10 * k + 7, " ".join(swapped[0][6:] + ["y"] * 9)), (10 * k + 8, " ".join(["x"] * 9 + swapped[0][:-6]))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.contamination(documents(spark, rows), bench).collect()}
    wanted = {k: [k // 10] if brute_windows(t, items[k // 10]) >= 0.75 else [] for k, t in rows}
    assert got == wanted and 40 < sum(map(len, wanted.values())) < len(rows)


def test_items_of_one_id(spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (1, "p q r s t u"), (1, "p q r s t u"), (None, "g h i j k l")], "item_id bigint, text string")
    docs = documents(spark, [(1, "a b c d e f"), (2, "x p q r s t u"), (3, "g h i j k l"), (4, "a b c s t u")])
    assert {r.doc_id: r.kept for r in decontaminate.contamination(docs, bench).collect()} == {1: False, 2: False, 3: False, 4: True}


@pytest.mark.parametrize("cap", [0])
def test_joins_without_sending(spark, monkeypatch, cap):
    """Beyond the checked size the same rows come from shuffle joins."""
    monkeypatch.setattr(decontaminate, "MAX_SENT", cap)
    monkeypatch.setattr(minhash_dedup, "MAX_SENT_IDS", cap)
    docs = documents(spark, [(1, "a b c d e f g h"), (2, "p q r s t u v"), (3, "a b c d e f g h")])
    bench = spark.createDataFrame([(7, "p q r s t u")], "item_id bigint, text string")
    assert {r.doc_id: r.kept for r in decontaminate.contamination(docs, bench).collect()} == {1: True, 2: False, 3: True}
    assert {r.doc_id for r in minhash_dedup.keep_one(docs).collect()} == {1, 2}


def test_written_and_forgotten(spark):
    from airloom.llm import common as C

    kept, gone = C.written(spark.range(3).toDF("a"), "test"), C.written(spark.range(4).toDF("a"), "test")
    C.forget(gone, kept.where("a > 0"))
    assert kept.count() == 3 and gone._airloom_path not in C._written and kept._airloom_path in C._written
    out = C.finished(lambda: C.written(spark.range(5).toDF("a"), "between"), "test")
    assert out.count() == 5 and not [p for p in C._written if "between" in p]
