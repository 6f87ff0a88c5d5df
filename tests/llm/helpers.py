"""Small frames and brute-force forms for the tests of the training-data operators."""

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))}


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


ODD_TEXTS = [None, "", " ", "\n\n\t", "a", "x" * 20_000, "é漢😀   ü", "a\x00b c", "one two three four five six " * 50, "no no no no no no no no", "<|endoftext|> </s> <unk>", "   lead", "trail   ", "#*$%&|<>" * 40]
