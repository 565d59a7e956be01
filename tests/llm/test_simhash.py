import random

import numpy as np

from sievework.llm import simhash


def brute_components(fps, ids):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    distinct = list(fps)
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= 3:
                label[root(x)] = root(y)
    least = {}
    for f in distinct:
        r = root(f)
        least[r] = min(least.get(r, 1 << 62), ids[f])
    return {f: least[root(f)] for f in distinct}


def test_walk_finds_every_pair():
    rng = random.Random(1)
    for n, groups in ((300, 5), (50, 1), (1, 1)):
        centres = [rng.getrandbits(64) for _ in range(groups)]
        keys = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(n // groups)} | {rng.getrandbits(64) for _ in range(n)}
        a = np.array(sorted(keys), np.uint64)
        got = {(int(i), int(j)) for x, y in simhash.walk(a, a, 0, 0, True) for i, j in zip(x, y)}
        high = np.uint64(0xFFFFFFFF00000000)
        want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if np.bitwise_count(a[i] ^ a[j]) <= 3 and np.bitwise_count((a[i] ^ a[j]) & high) <= 1}
        assert want <= got
        assert all(np.bitwise_count(a[i] ^ a[j]) <= 3 for i, j in got)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE", 3)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(200)] + ["É", "é"]
    base = [rng.choices(vocab, k=rng.randint(40, 300)) for _ in range(60)]
    rows = []
    for i, words in enumerate(base):
        for _ in range(rng.choice([1, 1, 2, 30])):
            w = list(words)
            if rng.random() < 0.8:
                w[rng.randrange(len(w))] = "edit"
            rows.append((len(rows) * 2 + 5, rng.choice([" ", "\n", " \t"]).join(w), "x"))
    rows += [(3, None, "x"), (9001, "", "x"), (9002, "One", "x"), (9003, "one two", "x"), (9004, "ONE TWO", "x"), rows[0], (9005, "z " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.fingerprint_digest(docs).collect()
    assert len(got) == len(rows)
    fps, ids = {}, {}
    for d, t, _ in rows:
        fps[d] = simhash.fingerprint(t)
        ids[fps[d]] = min(ids.get(fps[d], 1 << 62), d)
    want = brute_components(set(fps.values()), ids)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[fps[r.doc_id]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.fingerprint_digest(docs.limit(0)).count() == 0


def test_documents_without_an_id(spark):
    rows = [(None, "a b c d e"), (None, "f g h i j"), (None, "a b c d e"), (4, "f g h i j"), (9, "k l m n o"), (9, "p q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.fingerprint_digest(docs).collect()}
    name = lambda t: f"{simhash.fingerprint(t):016x}"
    assert got[None, name("a b c d e")] is None and got[None, name("f g h i j")] == 4
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect())
    assert kept == [(0, "a b c d e"), (4, "f g h i j"), (9, "k l m n o"), (9, "p q r s t")]


def test_fingerprint_of_known_shingles():
    import xxhash

    text, words = "A b  C\nd", ["a", "b", "c", "d"]
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in (0, 1)]
    assert simhash.fingerprint(text) == hs[0] & hs[1]
    assert simhash.fingerprint("Ab") == xxhash.xxh64_intdigest("ab", 42) and simhash.fingerprint(" ") == 0
