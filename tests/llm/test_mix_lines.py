import hashlib
import random
from collections import Counter, defaultdict

import pytest

from sievework.llm import line_dedup, mixing

BLANKS = " \t\n\x0b\f\r"


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    lines = ["Shared  Line", " shared  line\t", "É one", "é one", "", "  ", "tail", "\x0bx"]
    rows = []
    for i in range(n):
        text = "\n".join(rng.choice(lines) if rng.random() < 0.4 else f"own {i} {j} " + "w " * rng.randint(0, 9) for j in range(rng.randint(1, 12)))
        rows.append((i, text, rng.choice(["a", "a", "a", "b", "Z", "é", None, "none"])))
    rows += [(1000, None, "a"), (1001, "", "none"), (None, "no id\ntail", "b"), (5, rows[5][1], rows[5][2]), (1002, "tail\n" * 3000, "b")]
    rows += [(2000, f"twice named\n{i}", "b") for i in range(12)] + [(2001 + i, "twice named", "b") for i in range(8)] + [(None, f"nameless\n{i}", None) for i in range(11)]
    return rows


def brute(rows, min_docs, keep_first):
    key = lambda line: line.strip(BLANKS).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    docs = defaultdict(set)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(t or "" if d is None else d)
    out, first = [], {}
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])) if keep_first else ():
        for i, x in enumerate((t or "").split("\n")):
            first.setdefault(key(x), (d, i))
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        drop = [len(key(x)) >= 1 and len(docs[key(x)]) >= min_docs and first.get(key(x)) != (d, i) for i, x in enumerate(lines)]
        kept = "\n".join(x for x, y in zip(lines, drop) if not y)
        out.append((d, len(lines), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_lines_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, tail string")
    got = [tuple(r) for r in line_dedup.line_digest(docs, min_docs=10).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, 10, False)))
    out = line_dedup.drop_lines(docs, min_docs=10)
    for r in out.collect():
        lines = (r.text or "").split("\n")
        assert r.kept_text == "\n".join(x for a, n in r.keep_runs for x in lines[a : a + n])
        assert r.tail in {x[2] for x in rows}
    assert line_dedup.line_digest(docs.limit(0)).count() == 0


def test_keep_first_spares_one_line_per_key(spark):
    rows = [(i, f"common\nown {i}\ncommon", "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept_text for r in line_dedup.drop_lines(docs, min_docs=10, keep_first=True).collect()}
    assert kept[0] == "common\nown 0" and kept[1] == "own 1"


def test_a_line_of_every_document_goes_and_own_columns_stay(spark):
    rows = [(i, f"everywhere\nown {i}", i * 7, "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, keep_runs string")
    got = line_dedup.without_shared_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(i, f"own {i}", i * 7, "x") for i in range(500)]


def fill(words, ranks, share=1.5, limit=2, weights=(3, 1, 2)):
    total, capped = share * sum(words), {}
    while True:
        free = [i for i in range(len(words)) if i not in capped]
        level = (total - sum(capped.values())) / sum(weights[i % 3] for i in free) if free else 0
        over = [i for i in free if level * weights[i % 3] > limit * words[i]]
        if not over:
            return [capped.get(i, level * weights[i % 3]) for i in range(len(words))]
        capped |= {i: limit * words[i] for i in over}


def test_mix_meets_its_targets(spark):
    rows = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = dict(block_words=16, shard_words=256)
    got = mixing.plan_mix(docs, **options).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for d, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, fill([size[s] for s in names], names)))
    taken, shards = Counter(), defaultdict(Counter)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
        taken[r.source] += r.taken
        for d in r.draws:
            shards[d.shard][r.source] += d.words
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    assert len(shards) == 1 << ((-(-sum(taken.values()) // 256)).bit_length() - 1)
    assert sum(v for c in shards.values() for v in c.values()) == sum(taken.values())
    again = mixing.plan_mix(docs.repartition(7), **options).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mix_documents(docs.withColumn("size", docs.doc_id), **options)
    assert mixed.columns == ["doc_id", "text", "source", "size"]
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())
    for frame in (docs.limit(0), docs.where("text is null")):
        assert sum(r.taken for r in mixing.plan_mix(frame).collect()) == 0


def test_tree_splits_quotas_exactly(spark):
    quotas = spark.createDataFrame([(1, 5000), (2, 0), (3, 70), (4, 1)], "rank int, blocks long")
    rows = {r["rank"]: r["offsets"] for r in mixing.splitting_tree(quotas, 8, 3).collect()}
    for rank, total in ((1, 5000), (2, 0), (3, 70), (4, 1)):
        assert len(rows[rank]) == 8 and rows[rank][0] == 0 and rows[rank] == sorted(rows[rank]) and rows[rank][-1] <= total
    first = [b - a for a, b in zip(rows[1], rows[1][1:])]
    assert all(abs(n - 625) < 30 for n in first)
    many = [mixing.splitting_tree(quotas, 2, s).where("rank = 3").first()["offsets"][1] for s in range(12)]
    assert 28 < sum(many) / len(many) < 42 and len(set(many)) > 3
