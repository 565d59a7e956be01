"""Building a labelled corpus: reposts, caps, groups, splits, weights, windows, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.components import connected_components


def latest_of_reposts(cases: DataFrame, key: Column, newest: list[Column], chars: int = 120) -> DataFrame:
    """The newest row of each leading-text key; rows with an empty key never collapse, each of them is a group of its own."""
    keyed = cases.withColumn("_k", F.substring(key, 1, chars)).withColumn("_own", F.when(F.coalesce(F.col("_k"), F.lit("")) == "", F.monotonically_increasing_id()))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_own").orderBy(*newest))).where("_n = 1").drop("_k", "_own", "_n")


def first_n_per(cases: DataFrame, by: list[str], n: int, order: list[Column]) -> DataFrame:
    """A cap per group; Spark keeps only n rows per task and group before the shuffle."""
    return cases.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def hash_capped(cases: DataFrame, by: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """A cap per group by a seeded hash order, the same in every run and every engine that has MD5."""
    return first_n_per(cases, by, n, [F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), F.col(key)])


def key_groups(keys: DataFrame, more_edges: DataFrame | None = None) -> DataFrame:
    """(case, group) from (case, key): cases that share keys, directly or through others, are one group."""
    first = keys.groupBy("key").agg(F.min("case").alias("dst"))
    edges = keys.join(first, "key").select(F.col("case").alias("src"), "dst")
    if more_edges is not None:
        edges = edges.unionByName(more_edges.select("src", "dst"))
    parts = connected_components(edges)
    cases = keys.select("case").distinct()
    return cases.join(parts, F.col("case") == F.col("node"), "left").select("case", F.coalesce("component", "case").alias("group"))


def stratified_split(groups: DataFrame, shares: tuple[float, float] = (0.6, 0.8), seed: int = 0) -> DataFrame:
    """(group, split) from (group, stratum): cut points per stratum in hash order; a group keeps its first stratum's split."""
    pairs = groups.select("group", "stratum").distinct()
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "group")), "group")
    placed = pairs.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("stratum")))
    a, b = (F.bround(F.col("n") * F.lit(s)) for s in shares)
    split = F.when(F.col("i") <= a, "train").when(F.col("i") <= b, "calibration").otherwise("test")
    return placed.withColumn("split", split).groupBy("group").agg(F.min_by("split", "stratum").alias("split"))


def balanced_weights(cases: DataFrame, group: str, label: str) -> DataFrame:
    """weight = 1 / group size, scaled so that the classes weigh the same and the mean stays.

    Sizes and class totals are partial sums joined back, so no group is gathered in one task.
    """
    cells = cases.groupBy(F.col(group).alias("_g"), F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = cells.groupBy("_g").agg(F.sum("_c").alias("_size"))
    per_cell = cells.join(sizes.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h")))
    totals = per_cell.groupBy("_y").agg(F.sum(F.col("_c") / F.col("_size")).alias("_class"))
    totals = totals.withColumn("_all", F.sum("_class").over(Window.partitionBy())).withColumn("_classes", F.count(F.lit(1)).over(Window.partitionBy()))  # a row per class
    sized = cases.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).join(totals, F.col(label) == F.col("_y"))
    return sized.withColumn("weight", F.col("_all") / (F.col("_size") * F.col("_classes") * F.col("_class"))).select(*cases.columns, "weight")


def chat_windows(turns: DataFrame, key: str, order: str, text: str, size: int = 3, least: int = 4, limit: int = 12) -> DataFrame:
    """Full windows of consecutive lines, without short lines and lines with a link."""
    kept = turns.where((F.length(text) >= least) & ~F.contains(F.col(text), F.lit("http")))
    kept = kept.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).where(F.col("_i") < limit)
    grouped = kept.groupBy(key, F.floor(F.col("_i") / size).alias("window")).agg(F.sort_array(F.collect_list(F.struct("_i", F.col(text).alias("t")))).alias("_r"))
    return grouped.where(F.size("_r") == size).select(key, "window", F.array_join(F.transform("_r", lambda r: r["t"]), "\n").alias("text"))


def timeline_label(entries: Column) -> Column:
    """A verdict from a case's log: a denial is looked for before a confirmation."""
    t = F.array_join(entries, " ")
    return F.when(F.contains(t, F.lit("非詐騙")) | F.rlike(t, F.lit("(並?不是|並非)詐騙")), "Normal").when(F.rlike(t, F.lit("確認，?這是詐騙|確認為詐騙|已確認.{0,6}詐騙")), "Fraud")


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Values of key that stand in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def split_text_conflicts(rows: DataFrame, digest: Column, label: str) -> DataFrame:
    return rows.groupBy(digest.alias("digest")).agg(F.count_distinct(label).alias("labels"), F.count(F.lit(1)).alias("rows")).where("labels > 1")


def half_weight_copies(rows: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """The rows and a copy of each with the given columns blank, both at half weight."""
    half = rows.withColumn(weight, F.col(weight) / 2)
    blank = half
    for c in columns:
        blank = blank.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    return half.unionByName(blank)


def resume(todo: DataFrame, done: DataFrame, key: str, need: DataFrame | None = None) -> DataFrame:
    """Rows not done yet, of those that need lists if given."""
    out = todo.join(done.select(key), key, "left_anti")
    return out if need is None else out.join(need.select(key), key, "left_semi")
