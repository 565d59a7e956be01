"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one in double precision where they are compared, and moved as they came; equal vectors
are one class with a key of its own. Two
codebooks, one per half of the vector, are fitted on a bounded sample of each length; a vector's home is the cell
of its nearest centroid in each. A vector then visits further cells of the product grid in order of the sum of its
two half distances (multi-sequence order). How many is calibrated per query vector, not per pair: as many as
target_recall needs both for partners planted at the threshold in random directions (the hardest that may link, so
it holds where links are rare too) and for the true neighbours of up to QUERIES vectors among all rows. Codebooks
are made coarser until MAX_VISITS cells are enough; if none is, the length is one cell, compared in full.
What meets in a cell is compared exactly, so no pair under the threshold links; a pair that both sides'
visits find counts where the lesser of its home cells is. Cells with more than CELL vectors, or visitors, are dealt in
chunks, chunk against chunk. Tasks return link counts and spanning forests, not pairs.

Rows: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths never link; rows with one vec_id are vectors of their own, and so are those without any: they link
and bridge like others, and a group's component is its least id (null if it has none); other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.components import connected_components
from sievework.runtime import cut

SAMPLE = 20_000  # vectors of one length that its codebooks are fitted on,
SAMPLE_BYTES = 64 << 20  # and their bytes, of all lengths together
QUERIES = 512  # vectors whose neighbours are sought among all rows, to set the cells to visit
PER_BATCH = 8  # neighbours of a query that count in a batch of rows
MAX_LENGTHS = 32  # lengths with codebooks, the most frequent ones; others are one cell each
MAX_CODES = 1_024
MIN_CELLS, MAX_VISITS = 8, 128
CELL = 4_096
BLOCK = 1_024
MAX_SIZES = 1_000_000  # cells; more are joined instead of broadcast


def _unit(raw: list[bytes], dim: int):
    """Unit vectors in double precision (rows, dim) from stored ones, which are little-endian floats where those are exact, else doubles."""
    import numpy as np

    size = np.array([len(r) for r in raw])
    v = np.empty((len(raw), dim))
    for kind, width in (("<f4", 4 * dim), ("<f8", 8 * dim)):
        rows = np.flatnonzero(size == width)
        if len(rows):
            v[rows] = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(-1, dim)
    v /= np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): v holds the vector as little-endian floats, or doubles if floats lose of it; null where it links with nothing."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            n = len(lists)
            if pa.types.is_fixed_size_list(lists.type):
                lists = lists.cast(pa.list_(lists.type.value_type))
            at, values = lists.offsets.to_numpy(), lists.values
            x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            size = np.where(np.asarray(lists.is_valid()), np.diff(at), 0)
            out = np.full(n, None, object)
            dims = np.zeros(n, np.int32)
            for dim in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == dim)
                v = x[at[rows][:, None] + np.arange(dim)]
                big = np.abs(v).max(1)
                sound = np.isfinite(big) & (big > 0)
                rows, v = rows[sound], v[sound].astype("<f8")
                with np.errstate(over="ignore"):
                    short = v.astype("<f4")
                exact = (short == v).all(1)
                dims[rows] = dim
                out[rows] = [(short if e else v)[i].tobytes() for i, e in enumerate(exact.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(dims), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


def half_distances(v, codes):
    """Squared distances to every centroid, for each half: two arrays (rows, codes)."""
    cut_at = codes[0].shape[1]
    return [(h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1) for h, c in zip((v[:, :cut_at], v[:, cut_at:]), codes)]


def nearest_cells(d1, d2, cells: int):
    """The first cells of each row in multi-sequence order: cell numbers (rows, cells), the home cell first.

    A cell at ranks (i, j) has (i + 1) * (j + 1) - 1 cells that are no farther, so only ranks with a product of at
    most cells can be among them.
    """
    import numpy as np

    o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    k = d1.shape[1]
    ranks = [(i, j) for i in range(k) for j in range(k) if (i + 1) * (j + 1) <= cells]
    i, j = (np.array(x) for x in zip(*ranks))
    first = np.argsort(s1[:, i] + s2[:, j], 1, kind="stable")[:, :cells]
    return np.take_along_axis(o1, i[first], 1) * k + np.take_along_axis(o2, j[first], 1)


def fit_codes(sample, codes: int, rounds: int = 8, seed: int = 11):
    """k-means codebooks for the two halves of a sample of unit vectors."""
    import numpy as np

    rng, dim = np.random.default_rng(seed), sample.shape[1]
    out = []
    for half in (sample[:, : dim // 2], sample[:, dim // 2 :]):
        c = half[rng.choice(len(half), codes, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(1) - 2 * half @ c.T, 1)
            for k in range(codes):
                rows = half[near == k]
                if len(rows):
                    c[k] = rows.mean(0)
        out.append(c)
    return out


def visit_ranks(x, y, codes, most: int):
    """For pairs of rows of x and y: at which visit one of the two first comes to the other's home; most if at none."""
    import numpy as np

    ranks = np.full(len(x), most)
    cells = [nearest_cells(*half_distances(v, codes), most) for v in (x, y)]
    for a, b in (cells, cells[::-1]):
        hit = a == b[:, :1]
        ranks = np.minimum(ranks, np.where(hit.any(1), hit.argmax(1), most))
    return ranks


def planted_cells(sample, codes, threshold: float, target_recall: float, seed: int = 5) -> int:
    """Cells to visit so that target_recall of partners at the threshold, in random directions, meet from either side."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:2_000]]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    y = threshold * x + (1 - threshold**2) ** 0.5 * u / np.sqrt((u * u).sum(1))[:, None]
    return int(np.ceil(np.quantile(visit_ranks(x, y, codes, MAX_VISITS), target_recall))) + 1


def neighbour_ranks(classes: DataFrame, index: dict, queries: dict, threshold: float) -> dict[int, dict]:
    """dim -> query -> list of (rank, pairs): at which visit true neighbours of the queries among all rows are met."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            found = []
            for dim in np.unique(dims).tolist():
                if dim not in queries:
                    continue
                v = _unit(batch.column("v").filter(pa.array(dims == dim)).to_pylist(), dim)
                q = queries[dim]
                near = (q @ v.T >= threshold) & ~(q @ v.T >= 1 - 1e-12)
                a, b = np.nonzero(near & (np.cumsum(near, 1) <= PER_BATCH))
                if len(a):
                    found += zip([dim] * len(a), a.tolist(), visit_ranks(q[a], v[b], index[dim][0], MAX_VISITS).tolist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*found)], names=["dim", "query", "rank"])

    rows = classes.select("dim", "v").mapInArrow(run, "dim int, query int, rank int").groupBy("dim", "query", "rank").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[int, dict] = {}
    for r in rows:
        out.setdefault(r["dim"], {}).setdefault(r["query"], []).append((r["rank"], r["n"]))
    return out


def recall_at(ranks: dict, cells: int) -> float:
    """Mean over queries of the share of their neighbours that so many visits meet; 1 without any."""
    shares = [sum(n for r, n in q if r < cells) / sum(n for _, n in q) for q in ranks.values()]
    return sum(shares) / len(shares) if shares else 1.0


def build_index(classes: DataFrame, threshold: float, target_recall: float) -> dict[int, tuple]:
    """dim -> (codebooks, cells to visit, recall of the queries' true neighbours), from bounded samples by a hash of the vector."""
    import numpy as np

    counts = [(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(MAX_LENGTHS).collect()]
    index, queries = {}, {}
    for dim, n in counts:
        most = min(SAMPLE, SAMPLE_BYTES // (8 * dim * len(counts)))
        every = max(1, n // max(1, most))
        rows = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("v"), F.lit(every)) == 0)).select("v").limit(2 * most).collect() if n >= 256 and dim >= 4 else []
        sample = _unit(sorted(r[0] for r in rows), dim) if len(rows) >= 256 else []
        codes = int(np.clip(round((n / 256) ** 0.5), 4, min(MAX_CODES, max(4, len(sample) // 16))))
        while len(sample) and codes >= 4:
            books = fit_codes(sample[::2], codes)
            cells = planted_cells(sample[1::2], books, threshold, target_recall)
            if cells <= MAX_VISITS:
                index[dim], queries[dim] = (books, max(MIN_CELLS, cells)), sample[:: max(1, len(sample) // QUERIES)][:QUERIES]
                break
            codes //= 2
    ranks = neighbour_ranks(classes, index, queries, threshold) if index else {}
    for dim, (books, cells) in list(index.items()):
        seen = ranks.get(dim, {})
        while cells < MAX_VISITS and recall_at(seen, cells) < target_recall:
            cells += 1
        recall = recall_at(seen, cells)
        if recall < target_recall:
            del index[dim]  # one cell, compared in full
        else:
            index[dim] = (books, cells, recall)
    return index


def embedding_links(classes: DataFrame, *, threshold: float, target_recall: float) -> tuple[DataFrame, DataFrame]:
    """From (rep, n, dim, v), rep being a class's key: (rep, links) to other vectors, and (src, dst) edges between reps."""
    index = build_index(classes, threshold, target_recall)

    def visit(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                m = rows.num_rows
                if dim in index:
                    codes, cells, _ = index[dim]
                    v = _unit(rows.column("v").to_pylist(), dim)
                    found = np.concatenate([nearest_cells(*half_distances(v[a : a + BLOCK], codes), cells) for a in range(0, m, BLOCK)]).astype(np.int32)
                else:
                    found = np.full((m, 1), -1, np.int32)
                width = found.shape[1]
                flat = pa.array(found.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * width + 1, width, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([rows.column("rep"), rows.column("n"), rows.column("dim"), rows.column("v"), lists], names=["rep", "n", "dim", "v", "cells"])

    homes = cut(classes.select("rep", "n", "dim", "v").mapInArrow(visit, "rep long, n long, dim int, v binary, cells array<int>"))
    visits = homes.select("rep", "n", "dim", "v", "cells", F.posexplode("cells").alias("nth", "cell"))
    visits = visits.withColumn("home", F.col("nth") == 0)
    count = lambda is_home: F.sum(F.when(F.col("home") == is_home, 1).otherwise(0))
    sizes = cut(visits.groupBy("dim", "cell").agg(F.ceil(count(True) / CELL).cast("int").alias("hc"), F.greatest(F.lit(1), F.ceil(count(False) / (4 * CELL))).cast("int").alias("vc")).where("hc > 0"))
    sized = visits.join(F.broadcast(sizes) if sizes.count() <= MAX_SIZES else sizes, ["dim", "cell"])
    mine = F.pmod(F.xxhash64("rep"), F.col("hc")).cast("int")
    group = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("vc")).cast("int")
    place = F.when(
        F.col("home"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("hc") - 1), lambda j: F.struct(F.least(mine, j).alias("ci"), F.greatest(mine, j).alias("cj"), F.lit(0).alias("g"))),
            F.when(F.col("vc") > 1, F.transform(F.sequence(F.lit(1), F.col("vc") - 1), lambda g: F.struct(mine.alias("ci"), mine.alias("cj"), g.alias("g")))).otherwise(F.array()),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("hc") - 1), lambda i: F.struct(i.alias("ci"), i.alias("cj"), group.alias("g"))))
    units = sized.withColumn("u", F.explode(place)).select("dim", "cell", "u.*", F.when(F.col("home"), mine).otherwise(-1).alias("chunk"), "rep", "n", "v", "cells")

    def compare(table):
        import numpy as np
        import pyarrow as pa

        from sievework.llm.forest import Forest

        dim, cell, ci, cj, g = (table.column(c)[0].as_py() for c in ("dim", "cell", "ci", "cj", "g"))
        chunk = table.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        table, chunk = table.take(pa.array(order)), chunk[order]
        v = _unit(table.column("v").to_pylist(), dim)
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
        n_visit = int(np.searchsorted(chunk, 0))
        hosts = np.arange(n_visit, len(rep))
        cells = np.stack(table.column("cells").to_pylist()) if n_visit and len(hosts) else None
        home = cells[:, 0] if cells is not None else None

        def meet(p, q, visiting):
            """Compare rows p with rows q; each pair comes once."""
            for a in range(0, len(p), BLOCK):
                for b in range(0, len(q), BLOCK):
                    x, y = np.nonzero(v[p[a : a + BLOCK]] @ v[q[b : b + BLOCK]].T >= threshold)
                    x, y = p[a : a + BLOCK][x], q[b : b + BLOCK][y]
                    if visiting:  # the other side visits too: the lesser home cell counts
                        again = np.zeros(len(x), bool)
                        for k in range(0, len(x), 100_000):
                            s = slice(k, k + 100_000)
                            again[s] = (home[x[s]] < cell) & (cells[y[s]] == home[x[s]][:, None]).any(1)
                        x, y = x[~again], y[~again]
                    elif p is q:
                        x, y = x[x < y], y[x < y]
                    np.add.at(links, x, n[y])
                    np.add.at(links, y, n[x])
                    forest.link(x, y)

        if g == 0:
            if ci == cj:
                meet(hosts, hosts, False)
            else:
                split = int(np.searchsorted(chunk, max(ci, cj)))
                meet(np.arange(n_visit, split), np.arange(split, len(rep)), False)
        if ci == cj and n_visit:
            meet(np.arange(n_visit), hosts, True)
        at, up = forest.edges()
        some = np.flatnonzero(links)
        return pa.table({"rep": np.concatenate([rep[some], rep[at]]), "links": np.concatenate([links[some], np.zeros(len(at), np.int64)]), "other": pa.array(np.concatenate([np.zeros(len(some), np.int64), rep[up]]), mask=np.arange(len(some) + len(at)) < len(some))})

    found = cut(units.groupBy("dim", "cell", "ci", "cj", "g").applyInArrow(compare, "rep long, links long, other long"))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    return counts, found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst"))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, target_recall: float = 0.995) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = cut(clean_vectors(vectors))
    classes = rows.where("v is not null").groupBy("dim", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    counts, edges = embedding_links(classes, threshold=threshold, target_recall=target_recall)
    parts = connected_components(edges)
    named = cut(classes.select("v", "rep", "n", "least").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left").select("v", "n", "links", F.coalesce("component", "rep").alias("part"), "least"))
    ids = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "part").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("v is not null").join(named, "v").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
