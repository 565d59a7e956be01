"""Chat formatting after the collapse of cumulative snapshots.

A log that stores a conversation again after each turn holds it many times. A turn's hash covers its place, role
and text; the xor of the first k is the hash of that prefix, for every k from running xors (128 bits).
Conversations that are equal are one, under the least conv_id; one that is a proper prefix of another is
dropped by an anti-join against the distinct prefixes. Only what remains is gathered and rendered.

Running values are two-level, within BUCKET turn numbers and over the buckets before, so a very long conversation
is many groups until it is rendered into its one row; equal conversations and prefixes are merged by partial sums
before anything is joined, so a common opening is one row.

Rows: turns are ordered by turn, nulls first, those of one number by a hash of role and text, the same in every run; a null role or text counts as empty; repeated rows are
turns of their own; rows with a null conv_id are one conversation; turns of one number are one bucket, however many; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.runtime import cut, stored

BUCKET = 1024
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, x1, x2): the hash of the first k of a conversation's n turns, for each k.

    Turns are dealt once, by conversation and bucket; what the buckets before hold is summed from one row a bucket.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = ["c", "b"]  # a struct, so that a null conv_id is a key like others
    dealt = turns.select(F.struct("conv_id").alias("c"), F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(1 << 62))).alias("b"), "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), text, role).alias("h2"), F.md5(F.concat_ws("\x1f", role, text)).alias("tie")).repartition(*key)
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    starts = sizes.select(*key, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("at"), F.sum("m").over(Window.partitionBy("c")).alias("n"))
    inside = Window.partitionBy(*key).orderBy("turn", "tie")
    placed = dealt.join(starts, key).withColumn("k", F.col("at") + F.row_number().over(inside))
    placed = placed.select(*key, "k", "n", F.xxhash64("k", "h1").alias("y1"), F.xxhash64("k", "h2").alias("y2"))
    totals = placed.groupBy(*key).agg(F.bit_xor("y1").alias("t1"), F.bit_xor("y2").alias("t2"))
    past = totals.select(*key, F.coalesce(F.bit_xor("t1").over(before), F.lit(0)).alias("p1"), F.coalesce(F.bit_xor("t2").over(before), F.lit(0)).alias("p2"))
    run = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(past, key)
    return joined.select(F.col("c.conv_id").alias("conv_id"), "k", "n", F.col("p1").bitwiseXOR(F.bit_xor("y1").over(run)).alias("x1"), F.col("p2").bitwiseXOR(F.bit_xor("y2").over(run)).alias("x2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that no other one extends; n_copies counts equal ones."""
    hashes = stored(prefix_hashes(turns), "prefixes")
    distinct = hashes.where("k = n").groupBy("k", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashes.where("k < n").select("k", "x1", "x2").distinct()
    return distinct.join(inner, ["k", "x1", "x2"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def render_conversations(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """Maximal conversations as one text each: (conv_id, n_turns, n_copies, text)."""
    kept = cut(maximal_conversations(turns))
    before, between, after = (F.lit(x) for x in template)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").alias("c"), F.struct("turn", F.md5(F.concat_ws("\x1f", role, text)).alias("tie"), role.alias("role"), text.alias("text")).alias("t"))
    rows = rows.join(kept, F.col("c").eqNullSafe(F.col("conv_id")), "left_semi")
    texts = rows.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("c", F.array_join(F.transform("ts", lambda t: F.concat(before, t["role"], between, t["text"], after)), "").alias("text"))
    return kept.join(texts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n_turns", "n_copies", "text")


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(coalesce(role, '') || chr(31) || coalesce(text, ''))) AS k FROM conversations),
p AS (SELECT conv_id, k, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT min(conv_id) AS conv_id, k AS n_turns, count(*) AS n_copies, prefix AS text FROM p WHERE k = n GROUP BY k, prefix)
SELECT conv_id, n_turns, n_copies, text FROM w WHERE text NOT IN (SELECT prefix FROM p WHERE k < n)
"""
