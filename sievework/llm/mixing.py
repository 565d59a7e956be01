"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Each source's documents are laid end to end in a permuted order (a keyed hash), which gives
a word axis; a source's quota is whole passes over its axis and a rest, and only the document in which the
rest ends is taken in part. The axis is cut into blocks of block_words; a document belongs to the block in
which it starts. A tree then halves the output shards again and again: at each node the left half draws its
share of every source's blocks from the multivariate hypergeometric law (exact inversion over eight standard
deviations, driven by a hash of seed, node and source), so quotas are whole numbers that add up at every
node. At a leaf, a shard owns a run of slots of each source; slots are a keyed permutation of blocks (an affine map
whose factor, drawn by the seed for each source, has no divisor in common with the number of blocks; which documents
share a block is random already). A document is taken as often as its block is drawn, and by the shards that own
the draws. Shards are shuffled locally by a keyed hash.

Positions on the axis are two-level sums: hash buckets within a source, then documents within a bucket, each
about the square root of the table, so a source with a third of all rows is many small groups. What is
broadcast has one row per source and one number per source and shard, and MAX_PLAN bounds it.

Rows: a null or empty text has size 0 and is taken 0 times; a null source is a source, last in order; rows
are separate documents even if equal; other columns pass through (columns named like the added ones are
replaced); a table without words takes nothing; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1 << 15
SHARD_WORDS = 1 << 22
MAX_SHARDS = 1 << 19
MAX_PLAN = 2_000_000
MAX_BLOCKS = 1 << 30  # blocks of all sources; beyond it blocks are larger
ADDED = ["size", "source_size", "target", "taken", "draws"]


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """Water filling over (source, words): target = least(limit * words, level * weight), adding up to share * all words.

    Sources stand by the level that caps them; the level as if a source and all after it were free rises up to
    the true one and falls after it, so the true one is the largest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sources.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight.cast("double")).withColumn("cap", F.col("words") * F.lit(limit)).withColumn("all_words", F.sum("words").over(every))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = base.withColumn("level", (F.col("all_words") * F.lit(share) - before) / after)
    return level.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(every))).select("source", "rank", "words", "target")


def _hypergeometric(u: str, total: str, marked: str, drawn: str) -> str:
    """SQL for the number of marked among drawn of total, by inversion from the ratios of neighbouring probabilities."""
    mean = f"(cast({drawn} as double) * {marked} / {total})"
    spread = f"sqrt({mean} * (1 - cast({marked} as double) / {total}) * (cast({total} - {drawn} as double) / greatest({total} - 1, 1)))"
    low, high = f"greatest(0L, {drawn} - ({total} - {marked}))", f"least({drawn}, {marked})"
    span = f"sequence(greatest({low}, cast(floor({mean} - 8 * {spread} - 3) as bigint)), least({high}, cast(ceil({mean} + 8 * {spread} + 3) as bigint)))"
    ratio = f"((cast({marked} - x as double)) * ({drawn} - x) / ((x + 1.0D) * ({total} - {marked} - {drawn} + x + 1)))"
    mass = f"aggregate({span}, named_struct('w', 1.0D, 's', 0.0D), (a, x) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w), a -> a.s)"
    walk = f"aggregate({span}, named_struct('w', 1.0D, 's', 0.0D, 'n', -1L), (b, x) -> named_struct('w', b.w * {ratio}, 's', b.s + b.w, 'n', if(b.n < 0 and b.s + b.w >= {u} * m, x, b.n)), b -> if(b.n < 0, {high}, b.n))"
    return f"if({marked} = 0 or {drawn} = 0, 0L, if({drawn} = {total}, {marked}, element_at(transform(array({mass}), m -> {walk}), 1)))"


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, offsets): for each source of (rank, blocks), the slot at which each shard's run begins.

    shards is a power of two. A node is one row with its blocks per source; a level turns it into two.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "blocks"))).alias("s")).select(F.lit(0).alias("node"), F.expr("transform(s, x -> cast(x.blocks as bigint))").alias("q"), F.expr("transform(s, x -> x.rank)").alias("ranks"))
    for level in range(int(math.log2(shards))):
        draw = _hypergeometric(f"(pmod(xxhash64({seed}, {level}, node, size(acc.o)), 9007199254740992L) / 9007199254740992.0D)", "acc.n", "y", "acc.l")
        fold = f"aggregate(q, named_struct('n', t, 'l', t div 2, 'o', cast(array() as array<bigint>)), (acc, y) -> element_at(transform(array({draw}), d -> named_struct('n', acc.n - y, 'l', acc.l - d, 'o', array_append(acc.o, d))), 1), acc -> acc.o)"
        half = nodes.withColumn("t", F.expr("aggregate(q, 0L, (a, v) -> a + v)")).withColumn("l", F.expr(fold))
        nodes = cut(half.select("ranks", F.explode(F.expr("array(named_struct('node', node * 2, 'q', l), named_struct('node', node * 2 + 1, 'q', zip_with(q, l, (v, w) -> v - w)))")).alias("c")).select(F.col("c.node").alias("node"), F.col("c.q").alias("q"), "ranks"))
    flat = nodes.select("node", F.explode(F.arrays_zip("ranks", "q")).alias("z")).select("node", F.col("z.ranks").alias("rank"), F.col("z.q").alias("n"))
    run = Window.partitionBy("rank").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    starts = flat.withColumn("at", F.coalesce(F.sum("n").over(run), F.lit(0)))
    return starts.groupBy("rank").agg(F.expr("transform(sort_array(collect_list(struct(node, at))), x -> x.at)").alias("offsets"))


def plan_mix(docs: DataFrame, *, columns: list[str] | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with size, source_size, target, taken and draws: array of (copy, shard, words), one for each time it is taken.

    columns are those of docs to carry along, all by default.
    """
    keep = [c for c in columns or docs.columns if c not in ADDED]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"), F.col("doc_id").alias("_id"))
    buckets = min(65_536, max(16, math.isqrt(docs.count())))
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    totals = cut(rows.groupBy("source", "_b").agg(F.sum("size").alias("words")))
    aims = targets(totals.groupBy("source").agg(F.sum("words").alias("words")), weights, share, limit)
    total = totals.agg(F.sum("words")).first()[0] or 0
    block_words = max(block_words, -(-int(total * max(1, limit)) // MAX_BLOCKS))
    blocks = F.ceil(F.col("words") / F.lit(block_words))
    quota = F.floor(F.col("target") + 0.5)
    aims = aims.withColumn("quota", F.when(F.col("words") > 0, F.least(quota, F.col("words") * limit)).otherwise(0)).withColumn("passes", F.when(F.col("words") > 0, F.expr("quota div words")).otherwise(0)).withColumn("rest", F.col("quota") - F.col("passes") * F.col("words"))
    aims = cut(aims.withColumn("per_pass", blocks).withColumn("blocks", F.col("passes") * F.col("per_pass") + F.ceil(F.col("rest") / F.lit(block_words))))
    n_sources, all_words = aims.agg(F.count(F.lit(1)), F.sum("quota")).first()
    wanted = max(1, min(MAX_SHARDS, max(64, MAX_PLAN // max(1, n_sources)), -(-(all_words or 0) // shard_words)))
    shards = 1 << (wanted.bit_length() - 1)
    plan = aims.join(splitting_tree(aims.select("rank", "blocks"), shards, seed), "rank", "left").withColumnRenamed("source", "_s")
    divisor = "aggregate(sequence(1, 64), named_struct('a', f, 'b', blocks), (g, i) -> if(g.b = 0, g, named_struct('a', g.b, 'b', g.a % g.b)), g -> g.a)"
    tries = f"transform(sequence(0, 63), i -> 1 + pmod(xxhash64({seed}, rank, i), greatest(blocks - 1, 1L)))"
    plan = plan.withColumn("factor", F.expr(f"coalesce(get(filter({tries}, f -> {divisor} = 1), 0), 1L)"))
    small = F.broadcast if n_sources * shards <= MAX_PLAN else (lambda t: t)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = totals.select(F.col("source").alias("_bs"), F.col("_b").alias("_bb"), before.alias("_at"))
    placed = rows.join(begins, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_b") == F.col("_bb")))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_start", F.col("_at") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    aimed = placed.join(small(plan), F.col("source").eqNullSafe(F.col("_s")))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_start")))
    copies = F.expr("filter(transform(sequence(0L, passes), c -> named_struct('copy', c, 'words', if(c < passes, size, _last))), x -> x.words > 0)")
    steps = [1 << i for i in range(int(math.log2(shards)) - 1, -1, -1)]
    slot = f"pmod(factor * (x.copy * per_pass + _start div {block_words}L) + pmod(xxhash64({seed}, rank), greatest(blocks, 1L)), greatest(blocks, 1L))"
    find = f"aggregate(array({', '.join(map(str, steps))}), 0, (p, s) -> if(element_at(offsets, p + s + 1) <= z, p + s, p))" if steps else "0"
    draws = F.expr(f"transform(_copies, x -> named_struct('copy', cast(x.copy as int), 'shard', element_at(transform(array({slot}), z -> {find}), 1), 'words', x.words))")
    out = aimed.withColumn("_last", last).withColumn("_copies", copies).withColumn("draws", draws)
    return out.select(*[F.col(f"row.`{c}`") for c in keep], "size", F.col("words").alias("source_size"), F.col("target").cast("double").alias("target"), F.expr("aggregate(draws, 0L, (a, x) -> a + x.words)").alias("taken"), "draws")


def mix(docs: DataFrame, *, seed: int = 17, **options) -> DataFrame:
    """The mix itself: (row, size, copy, shard, mixed_words), one for each document taken, row being the document.

    Dealt by shard and shuffled within it.
    """
    packed = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    drawn = plan_mix(packed, seed=seed, **options).select("row", "size", F.explode("draws").alias("d"))
    rows = drawn.select("row", "size", "d.copy", "d.shard", F.col("d.words").alias("mixed_words"))
    order = F.xxhash64(F.lit(seed), "shard", "copy", "row.doc_id", "size")
    return rows.withColumn("o", order).repartition("shard").sortWithinPartitions("shard", "o").drop("o")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a document taken in part keeps its first words, joined by spaces."""
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("mixed_words") < F.col("size"), F.array_join(F.slice(words, 1, F.col("mixed_words").cast("int")), " ")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return mix(docs, **options).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
