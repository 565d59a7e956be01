"""Copies and texts with equal shingle sets have their class and all their links."""

from sievework.plans import registry


def grams(t):
    k = "".join(c for c in t.lower() if c.isalnum())
    return frozenset(k[i : i + 4] for i in range(len(k) - 3)) if len(k) >= 20 else frozenset()


def test_members_against_brute_force(spark, tmp_path):
    base, other = "the quick brown fox jumps over the lazy dog by the river", "pack my box with five dozen liquor jugs at noon today"
    texts = [base] * 12 + [base.replace("lazy", "idle")] * 3 + [other, "abcd" * 10, "abcd" * 12, "short", ""]
    folder = str(tmp_path)
    spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(folder + "/documents.parquet")
    sets = {i + 1: grams(t) for i, t in enumerate(texts) if grams(t)}
    want = {}
    for i, x in sets.items():
        links = sum(i != j and 2 * len(x & y) >= len(x | y) for j, y in sets.items())
        want[i] = (min(j for j, y in sets.items() if y == x), links)
    got = registry.QUERIES["near_dup_members"](spark, folder).collect()
    assert len(got) == len(want) and {r.id: (r.rep, r.links) for r in got} == want
    assert want[17] == (17, 1) and want[18] == (17, 1)
