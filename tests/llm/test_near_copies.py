import random

import pytest

import corpus_pipeline
from sievework.llm import near_copies


def words_of(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_heads(rows):
    """The first document of each group, by id, nulls last."""
    sets = [words_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                label[root(i)] = root(j)
    place = lambda d: (d is None, d or 0)
    heads = {}
    for i, (d, _) in enumerate(rows):
        heads[root(i)] = min(heads.get(root(i), (True, 1 << 60)), place(d))
    return sorted(heads.values())


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "é"]
    passage = rng.choices(vocab, k=30)
    rows = []
    for _ in range(60):
        base = rng.choices(vocab, k=rng.choice([4, 20, 60, 120, 400])) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 4, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(w) // 50])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 2 + 5, rng.choice([" ", "\n", " \t"]).join(w)))
    rng.shuffle(rows)
    return rows + [(3, None), (9001, ""), (9002, "One"), (9003, "one two"), (9004, "ONE TWO"), rows[0], (None, "no id"), (None, "no id either"), (7001, "one id two texts"), (7001, "and another text"), (9005, "z " * 40_000)]


@pytest.mark.parametrize("chunk,small", [(1_000, 6), (1, 1), (1_000, 1), (3, 2)])
def test_heads_against_brute_force(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "SMALL", small)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, source string")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == brute_heads(rows)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_a_large_group_gives_a_star_and_not_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(10, 190)] = f"e{i}"
        rows.append((i, " ".join(w)))
    made = []
    whole = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda docs, classes, pairs: made.append(pairs.distinct().count()) or whole(docs, classes, pairs))
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0] and sum(made) < 300 * 40


def test_stage_finds_edited_copies_and_spares_others(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        w = [f"g{g}x{i}" for i in range(90)]
        v = list(w)
        v[rng.randrange(5, 85)] = "edit"
        rows += [(3 * g, " ".join(w)), (3 * g + 1, " ".join(v))]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "unused").collect()) == [3 * g for g in range(40)]
