"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.runtime import cut

HUB = 1_000_000  # edges of one node beyond which its least neighbour is broadcast


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges with a null end and self loops are ignored; repeated edges count once; an empty table gives an
    empty result. Each half round is a minimum per node (combined before the shuffle) joined back to the
    edges; nodes with over HUB edges, of which there are at most edges / HUB, are joined by broadcast, so that no task gets
    all edges of one. The state is a table of at most as many edges as came in, checkpointed each round; nothing but a
    row count and a checksum reaches the driver.
    """
    a, b = F.col(src), F.col(dst)
    state = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(state)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        state = cut(_small_star(_large_star(state, mark[0]), mark[0]))
        before, mark = mark, _mark(state)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(state: DataFrame) -> tuple[int, int]:
    row = state.agg(F.count(F.lit(1)), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
    return row[0], row[1]


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges with the m of their u, from (k, m, c); a node has n edges at most, so up to HUB there is no hub."""
    if n <= HUB:
        return edges.join(least, F.col("u") == F.col("k"))
    hubs, rest = F.broadcast(least.where(F.col("c") > HUB)), least.where(F.col("c") <= HUB)
    return edges.join(hubs, F.col("u") == F.col("k")).unionByName(edges.join(hubs, F.col("u") == F.col("k"), "left_anti").join(rest, F.col("u") == F.col("k")))


def _large_star(state: DataFrame, n: int) -> DataFrame:
    both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "c")
    return _with_least(both, least, 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(state: DataFrame, n: int) -> DataFrame:
    least = state.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).withColumnRenamed("u", "k")
    moved = _with_least(state, least, 2 * n).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()
