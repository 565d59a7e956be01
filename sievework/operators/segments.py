"""Which segments of a text carry its score: texts with segments left out, single effects, pair effects.

The scorer stands between: any transform from text to score; a null score means that the text had no usable one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tested_indices(n: Column, limit: int) -> Column:
    """At most limit positions spread evenly over 0..n-1, halves rounded to even; none if n is 0."""
    k = F.least(F.lit(limit), n)
    even = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), k - 1)), lambda i: F.bround(i * (n - 1) / F.greatest(F.lit(1), k - 1)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(even)


def clean_segments(c: Column) -> Column:
    return F.filter(F.transform(c, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def deletions(cases: DataFrame, limit: int = 64) -> DataFrame:
    """(id, index, text) from (id, segments): the whole text at index -1 and the text without each tested segment."""
    rows = cases.select("id", clean_segments(F.col("segments")).alias("s")).where(F.size("s") > 0)
    each = rows.select("id", "s", F.explode(F.concat(F.array(F.lit(-1)), tested_indices(F.size("s"), limit))).alias("index"))
    return each.select("id", "index", F.array_join(F.filter("s", lambda x, i: i != F.col("index")), "\n").alias("text"))


def effects(scored: DataFrame) -> DataFrame:
    """(id, index, score, delta, rank) from (id, index, score); the largest effect ranks first, ties by place."""
    base = scored.where("index = -1 and score is not null").select("id", F.col("score").alias("base"))
    rows = scored.where("index >= 0").join(base, "id").withColumn("delta", F.col("base") - F.col("score"))
    order = Window.partitionBy("id").orderBy(F.desc(F.abs(F.coalesce("delta", F.lit(0.0)))), "index")
    return rows.select("id", "index", "score", "delta", F.row_number().over(order).alias("rank"))


def pair_deletions(cases: DataFrame, ranked: DataFrame, budget: int) -> DataFrame:
    """(id, first, second, singles, text): texts without two segments, for budget pairs from the largest effects on.

    A case has as many effects as deletions were limited to, so its list is short.
    """
    lists = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "index", "delta"))).alias("e"))
    n = F.size("e")
    pair = lambda a, b: F.struct(F.least(a["index"], b["index"]).alias("first"), F.greatest(a["index"], b["index"]).alias("second"), (a["delta"] + b["delta"]).alias("singles"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: pair(F.get("e", i), F.get("e", j)))))
    pairs = lists.where(n >= 2).select("id", F.explode(F.slice(every, 1, budget)).alias("p")).select("id", "p.*")
    rows = cases.select("id", clean_segments(F.col("segments")).alias("s"))
    return pairs.join(rows, "id").select("id", "first", "second", "singles", F.array_join(F.filter("s", lambda x, i: (i != F.col("first")) & (i != F.col("second"))), "\n").alias("text"))


def pair_effects(scored_pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, first, second, joint_delta, nonadditivity): what two deletions do beyond the sum of each."""
    base = scored.where("index = -1").select("id", F.col("score").alias("base"))
    joint = F.col("base") - F.col("score")
    return scored_pairs.join(base, "id").select("id", "first", "second", joint.alias("joint_delta"), (joint - F.col("singles")).alias("nonadditivity"))
