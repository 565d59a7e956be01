"""What the pipeline's stages do with groups of copies."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def test_one_whole_document_of_ten_copies_stays(spark, tmp_path):
    rng = random.Random(4)
    copied = "\n".join(prose(rng, 12) for _ in range(6))
    texts = [copied] * 14 + [prose(rng, 60) for _ in range(5)]
    docs = spark.createDataFrame([(i + 1, t, "en", "web", len(t)) for i, t in enumerate(texts)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        stage(spark, docs, "unused").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = [r.text for r in docs.collect() if r.text]
    assert sorted(left) == sorted({*texts})
