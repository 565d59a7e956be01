"""The pipeline's stages, one after the other, each against a brute-force version on its own input."""

import hashlib
from collections import defaultdict

import pytest

import corpus_pipeline
from sievework.llm import encoding
from tests.llm import test_mix_lines, test_near_copies, test_quality
from tests.llm.test_tokens import direct

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], "unused").write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    raw, good, lines, unique, mixed, packed = (f.collect() for f in frames)
    assert all(f.columns == COLUMNS for f in frames[:5])

    passes = set()
    for r in raw:
        n, _, _, _, repeat = test_quality.brute(r.text)
        if n >= 50 and 100 * repeat <= 50 * n:
            passes.add(r.doc_id)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert kept <= passes and all(i in kept for i in passes if labels.get(i) == 1)

    want = {w[0]: w[3] for w in test_mix_lines.brute([(r.doc_id, r.text, None) for r in good], 10, True)}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in lines} == want
    assert all(r.n_chars == len(r.text) for r in lines)

    assert sorted(r.doc_id for r in unique) == [d for _, d in test_near_copies.brute_heads([(r.doc_id, r.text) for r in lines])]

    size, taken = defaultdict(int), defaultdict(int)
    for r in unique:
        size[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    names = sorted(size)
    for s, target in zip(names, test_mix_lines.fill([size[s] for s in names], names)):
        assert taken[s] == pytest.approx(target, abs=1)

    whole = direct(encoding.vocabulary("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(whole(r.text)) + 1 for r in mixed)
    fill = defaultdict(list)
    for r in packed:
        fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    text = " ".join(f"word{i} the of and" for i in range(40))
    rows = [(None, text, "en", "a", 1, "x", 5), (None, text + " more and other words here", None, None, 2, "y", 6), (4, text, "en", "a", 1, "z", 7), (4, None, "en", "a", None, "z", 8), (5, "", "", "", 0, None, None), (4, text, "en", "a", 1, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), "unused").count() == 0
    assert len(corpus_pipeline.line_dedup_stage(spark, docs, "unused").collect()) == 6
    left = corpus_pipeline.simhash_stage(spark, docs, "unused").collect()
    assert {(r.doc_id, bool(r.text)) for r in left} == {(4, True), (4, False)} and {r.n_lines for r in left} <= {6, 7, 8, 5, None}
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), "unused").count() == 0
