import random
from collections import Counter

import pytest

from sievework.llm import quality


def brute(t):
    t = t or ""
    for b in quality.BLANKS[1:]:
        u = t.replace(b, " ") if b == quality.BLANKS[1] else u.replace(b, " ")  # noqa: F821
    w = [x for x in u.split(" ") if x]
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i, k in enumerate(zip(w, w[1:], w[2:])):
        if c[k] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if x.strip(quality.BLANKS)]
    return len(w), sum(map(len, w)), sum(t.count(z) for z in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    rng = random.Random(4)
    words = ["the", "of", "and", "to", "nation", "Émile", "x1", "a", "b c", "d\x0be"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 200))) + rng.choice(["", "\n", "\n\nz\nz"]), "en", "k") for i in range(150)]
    rows += [(500, None, "en", "k"), (501, "", None, "k"), (502, " \n\t", "xx", "k"), (503, "one two", None, "k"), rows[3], (504, "w " * 30000, "en", "k")]
    rows += [(600 + i, " ".join(f"{w}{rng.choice(['%%%', '&&&', '###'])}" for w in rng.choices(words, k=120)), "en", "k") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and r.kept is not None
    assert not any(r.kept for r in got if 600 <= r.doc_id)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert quality.quality(docs.limit(0)).count() == 0


def test_jensen_shannon(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.9, 0.1], [0.5, 0.5])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()]
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0)
    assert got[2] == pytest.approx(0.3834, abs=1e-3)


def histograms(text, lang):
    """Shares by class and by common word, counted letter by letter."""
    import re
    import unicodedata

    words, total = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], max(1, len(text))
    kinds = Counter()
    for ch in text:
        if "a" <= ch <= "z":
            kinds["lower"] += 1
        elif "A" <= ch <= "Z":
            kinds["upper"] += 1
        elif "0" <= ch <= "9":
            kinds["digit"] += 1
        elif ch in quality.BLANKS:
            kinds["blank"] += 1
        elif ch in "#*$%&|<>":
            kinds["symbol"] += 1
        else:
            kinds["letter" if unicodedata.category(ch)[0] == "L" else "rest"] += 1
    listed = quality.COMMON_WORDS.get(lang)
    common = None
    if listed:
        hits = [sum(w == x for w in words) for x in listed]
        common = [h / max(1, len(words)) for h in [*hits, len(words) - sum(hits)]]
    return [kinds[c] / total for c in quality.CLASSES], common


def distance(p, q):
    from math import log2, sqrt

    return sqrt(max(0.0, sum((x * log2(2 * x / (x + y)) if x else 0) + (y * log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2))


def test_distances_and_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    hists = {i: histograms(r.text or "", r.lang) for i, r in rows.items()}
    counts = {i: brute(r.text) for i, r in rows.items()}
    sound = {i for i, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    refs = {}
    for lang in {r.lang for r in rows.values()}:
        own = [hists[i] for i in sound if rows[i].lang == lang]
        if own:
            refs[lang] = [[sum(c) / len(own) for c in zip(*(h[k] for h in own))] if own[0][k] else None for k in (0, 1)]
    for r in quality.quality(docs).collect():
        ref, h = refs.get(r.lang, (None, None)), hists[r.doc_id]
        by_class = distance(h[0], ref[0]) if ref[0] and r.n_words >= 50 else None
        by_word = distance(h[1], ref[1]) if ref[1] and h[1] and r.n_words >= 100 else None
        assert r.class_distance == (by_class if by_class is None else pytest.approx(by_class, abs=1e-9))
        assert r.word_distance == (by_word if by_word is None else pytest.approx(by_word, abs=1e-9))
        assert r.kept == (r.doc_id in sound and (by_class or 0) <= 0.3 and (by_word or 0) <= 0.27)
