import numpy as np
import pytest

from sievework.llm import embedding_dedup


def brute(rows, threshold=0.9):
    ok = [i for i, (_, x, _) in enumerate(rows) if x and None not in x and np.isfinite(x).all() and np.any(x)]
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in ok}
    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                label[root(a)] = root(b)
    least = {}
    for i in range(len(rows)):
        ids = [x for x in (least.get(root(i)), rows[i][0]) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return [(d, links[i], least[root(i)], d is not None and d == least[root(i)]) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize("cell,block", [(4096, 1024), (7, 3)])
def test_links_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(320, 16))
    rows = [(1000 - i, (base[i % 320] + rng.normal(size=16) * 0.15 * (i >= 320)).astype(np.float32).tolist(), "x") for i in range(430)]
    rows += [(2000 + i, (base[3] + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), "x") for i in range(60)]
    rows += [(3000 + i, rows[5][1], "x") for i in range(9)] + [(4000, None, "x"), (4001, [], "x"), (4002, [0.0] * 16, "x"), (4003, [float("nan")] * 16, "x"), (4004, [1.0, None], "x"), (4005, [1.0, 2.0], "x"), (4006, [1.0, 2.1], "x")]
    rows += [(5000, base[7].tolist(), "x"), (5000, base[8].tolist(), "x"), (None, (base[7] * 0.6 + base[8] * 0.5).tolist(), "x"), (None, None, "x"), (None, base[9].tolist(), "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string")
    got = [tuple(r) for r in embedding_dedup.near_duplicates(frame, target_recall=1.0).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_recall_where_links_are_rare(spark):
    """Production settings, vectors without clusters, partners planted just above the threshold."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.normal(size=(12_000, 64)))
    u = rng.normal(size=(400, 64))
    u = unit(u - (u * x[:400]).sum(1)[:, None] * x[:400])
    c = rng.uniform(0.9, 0.92, 400)[:, None]
    x = unit(np.vstack([x, c * x[:400] + (1 - c * c) ** 0.5 * u]).astype(np.float32).astype(float))
    near = x @ x.T >= 0.9
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    want = near.sum(1) - 1
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.98 * want.sum() > 0


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(frame).count() == 0


def test_cells_come_in_order_of_distance():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random((5, 6)), rng.random((5, 6))
    got = embedding_dedup.nearest_cells(d1, d2, 9)
    for r in range(5):
        want = np.argsort((d1[r][:, None] + d2[r]).ravel(), kind="stable")[:9]
        assert got[r].tolist() == want.tolist()
