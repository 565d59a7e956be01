"""Evaluation: confusion, ranking, calibration, conformal sets, bootstrap. All are partial sums or one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.runtime import cut


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None, null_f1: bool = False) -> DataFrame:
    """Counts and rates for Fraud / Normal / Unknown predictions.

    An Unknown on Fraud is a miss; on Normal it is neither. F1 without any positive is 0, or null if asked for.
    """
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    y, p = F.col(label), F.col(prediction)
    out = rows.groupBy(*(by or [])).agg(n((y == "Fraud") & (p == "Fraud")).alias("tp"), n((y == "Normal") & (p == "Fraud")).alias("fp"), n((y == "Normal") & (p == "Normal")).alias("tn"), n((y == "Fraud") & (p != "Fraud")).alias("fn"), n(p == "Unknown").alias("unknown"), F.count(F.lit(1)).alias("n"))
    rate = lambda a, b: F.round(F.when(b > 0, a / F.when(b > 0, b)), 6)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    f1 = rate(2 * tp, 2 * tp + fp + fn)
    return out.withColumn("precision", rate(tp, tp + fp)).withColumn("recall", rate(tp, tp + fn)).withColumn("f1", f1 if null_f1 else F.coalesce(f1, F.lit(0.0))).withColumn("fpr", rate(fp, fp + tn)).withColumn("accuracy", rate(tp + tn, F.col("n"))).withColumn("unknown_rate", rate(F.col("unknown"), F.col("n")))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney area with half credit for ties, from counts per distinct score.

    Scores go to ranges in order; what lies below a score is a running sum within its range and the totals of the ranges before.
    """
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    ranged = cut(per.repartitionByRange("s").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = ranged.groupBy("range").agg(F.sum("n").alias("t")).select("range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("past"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(F.broadcast(totals), "range")
    below = F.col("past") + F.col("inside") + F.col("n") / 2
    return placed.agg(F.round(F.sum(F.col("p") * below) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)), 6).alias("auc"))


def calibration_scores(rows: DataFrame, label: str, p: str, weight: str | None = None) -> DataFrame:
    """Brier score, log loss and expected calibration error over ten equal bins."""
    w = F.col(weight) if weight else F.lit(1.0)
    y, q = F.col(label).cast("double"), F.col(p)
    c = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), q))
    loss = -(y * F.log(c) + (1 - y) * F.log(1 - c))
    bins = rows.groupBy(F.least(F.floor(q * 10), F.lit(9)).alias("bin")).agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * q).alias("wp"), F.sum(w * (q - y) * (q - y)).alias("b"), F.sum(w * loss).alias("l"))
    total = F.sum("w")
    return bins.agg(F.round(F.sum("b") / total, 6).alias("brier"), F.round(F.sum("l") / total, 6).alias("log_loss"), F.round(F.sum(F.abs(F.col("wp") - F.col("wy"))) / total, 6).alias("ece"))


def reliability(rows: DataFrame, label: str, p: str) -> DataFrame:
    b = F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("long").alias("bin")
    return rows.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(label).cast("double")), 6).alias("share"))


def conformal_quantiles(rows: DataFrame, label: str, p: str, alpha: float = 0.1, bins: int = 4096) -> DataFrame:
    """Per class the ceil((n + 1)(1 - alpha))-th smallest nonconformity, 1 if there are not as many.

    Counts per bin of the scores tell in which bin it lies; only the distinct scores of that bin are put in order.
    """
    score = F.when(F.col(label) == 1, 1 - F.col(p)).otherwise(F.col(p))
    per = rows.select(F.col(label).alias("label"), score.alias("s")).groupBy("label", "s").agg(F.count(F.lit(1)).alias("c"))
    per = cut(per.withColumn("bin", F.floor(F.col("s") * bins)))
    by_bin = per.groupBy("label", "bin").agg(F.sum("c").alias("b"))
    upto = Window.partitionBy("label").orderBy("bin")  # a row per bin
    placed = by_bin.withColumn("upto", F.sum("b").over(upto)).withColumn("n", F.sum("b").over(Window.partitionBy("label")))
    placed = placed.withColumn("at", F.ceil(F.round((F.col("n") + 1) * F.lit(1 - alpha), 9)))
    sizes = placed.groupBy("label").agg(F.max("n").alias("n"))
    hit = placed.where((F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("b") < F.col("at"))).select("label", "bin", (F.col("at") - F.col("upto") + F.col("b")).alias("at"))
    run = F.sum("c").over(Window.partitionBy("label").orderBy("s"))
    found = per.join(F.broadcast(hit), ["label", "bin"]).withColumn("run", run).where(F.col("run") >= F.col("at")).groupBy("label").agg(F.min("s").alias("q"))
    return sizes.join(found, "label", "left").select("label", "n", F.round(F.coalesce("q", F.lit(1.0)), 6).alias("q"))


def conformal_set(p: Column, q_fraud: Column, q_normal: Column) -> Column:
    """Members of the set; a singleton on the wrong side of one half takes the other class in too."""
    f, n = 1 - p <= q_fraud, p <= q_normal
    both = F.array(F.lit("Fraud"), F.lit("Normal"))
    return F.when((f & n) | (f & ~n & (p <= 0.5)) | (n & ~f & (p > 0.5)), both).when(f, F.array(F.lit("Fraud"))).when(n, F.array(F.lit("Normal"))).otherwise(F.array().cast("array<string>"))


def best_temperature(rows: DataFrame, label: str, p: str, steps: int = 156, low: float = 0.25, step: float = 0.05) -> DataFrame:
    """The first grid temperature with the least negative log likelihood; the grid is exploded on each row and summed map-side."""
    from sievework.functions.stats import logit, sigmoid

    grid = rows.select(F.col(label).cast("double").alias("y"), logit(F.col(p)).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    t = F.lit(low) + F.col("i") * F.lit(step)
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), sigmoid(F.col("z") / t)))
    loss = grid.groupBy("i").agg(F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("nll"))
    return loss.agg(F.min_by("i", F.struct(F.round("nll", 9), "i")).alias("i"), F.round(F.min("nll"), 6).alias("nll")).select(F.round(F.lit(low) + F.col("i") * F.lit(step), 6).alias("temperature"), "nll")


def cluster_bootstrap(partials: DataFrame, group: str, reps: int = 1000, seed: int = 7) -> DataFrame:
    """95 % interval of F1 from per-group (tp, fp, fn).

    Each group enters a replicate as often as a Poisson(1) draw of its hash says, so replicates are partial sums.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", group)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    draw, cdf, mass = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        cdf += mass
        draw = draw + F.when(u > cdf, 1).otherwise(0)
        mass /= k
    rows = partials.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("k", draw)
    sums = rows.groupBy("rep").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in ("tp", "fp", "fn")])
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    sorted_f1 = sums.agg(F.sort_array(F.collect_list(f1)).alias("a"))
    at = lambda q: F.get("a", F.floor(F.lit(q) * (F.size("a") - 1)).cast("int"))
    return sorted_f1.select(F.round(at(0.025), 6).alias("low"), F.round(at(0.975), 6).alias("high"))
