"""SimHash near-duplicates: a distributed self-join of the binary trie of fingerprints.

Fingerprints that are equal are one leaf, so copies cost nothing further. Two within 3 bits differ in at most one
bit of one half; the trie is therefore built twice, with either half's bits first, and the error budget is 1
for the first 32 levels and 3 below. The trie's nodes at depth D are dealt out as node pairs whose prefixes
differ within the budget, and each task walks its two subtrees together, level by level: differing bits add
up, pairs beyond the budget or with an empty side are pruned, and small pairs are verified by counting bits.
D follows the number of fingerprints; a node with more than NODE of them is dealt in chunks, chunk against
chunk, so a dense group is many tasks and still compared in full. Tasks return spanning forests, not pairs.
A class is known by its fingerprint, not by a document's id.

Rows: null and empty texts have the fingerprint zero and link like any other; texts under three words are one
shingle; repeated rows share a class; documents without a doc_id link and bridge like others, and a group's
component is its least doc_id (null if it has none); other columns are ignored by the digest and kept by keep_one;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.components import connected_components
from sievework.runtime import cut

NODE = 16_384
MAX_DEPTH = 24  # 2 ** 25 nodes of NODE fingerprints each; beyond 5 * 10 ** 11 of them nodes are dealt in more chunks
MAX_BROADCAST = 1 << 20  # node counts; more are joined instead of broadcast
HALF_BUDGET, BUDGET = 1, 3
LEAF = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, bit set where over half the shingle hashes have it."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, "<u8"))


def majority(hashes) -> int:
    """64 bits, each set where over half of the hashes (an array of unsigned 64-bit numbers) have it."""
    import numpy as np

    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 100_000):
        ones += np.unpackbits(hashes[at : at + 100_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def texts(column, rows: int = 256):
    """The texts of an Arrow column, so many rows at a time as Python strings."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; doc_id may be any value that tells documents apart."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def walk(a, b, depth: int, errors: int, same: bool):
    """Pairs of places (i, j) with a[i], b[j] within BUDGET bits, below two trie nodes at depth; a, b sorted uint64.

    Yields arrays of pairs as they are found. same: a is b, and each pair comes once.
    """
    import numpy as np

    todo = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(b), errors)))]
    one = np.uint64(1)
    while todo:
        d, a0, a1, b0, b1, e = todo.pop()
        if len(a0) > 1_000_000:
            cut_at = len(a0) // 2
            todo += [(d, a0[:cut_at], a1[:cut_at], b0[:cut_at], b1[:cut_at], e[:cut_at]), (d, a0[cut_at:], a1[cut_at:], b0[cut_at:], b1[cut_at:], e[cut_at:])]
            continue
        small = (a1 - a0) * (b1 - b0) <= LEAF
        if d == 64:
            small[:] = True
        if small.any():
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            n = na * nb
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(a0[small], n) + k // np.repeat(nb, n)
            j = np.repeat(b0[small], n) + k % np.repeat(nb, n)
            near = np.bitwise_count(a[i] ^ b[j]) <= BUDGET
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, e = (x[~small] for x in (a0, a1, b0, b1, e))
        if not len(a0):
            continue
        low = np.uint64(63 - d)
        bit = one << low
        head = ~((bit << one) - one) if d else np.uint64(0)
        am = np.clip(np.searchsorted(a, (a[a0] & head) | bit), a0, a1)
        bm = np.clip(np.searchsorted(b, (b[b0] & head) | bit), b0, b1)
        budget = HALF_BUDGET if d < 32 else BUDGET
        parts = []
        for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            ok = (x0 < x1) & (y0 < y1) & (e + more <= budget)
            if same:
                ok &= x0 <= y0
            if ok.any():
                parts.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok] + more))
        if parts:
            todo.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))


def trie_links(classes: DataFrame) -> DataFrame:
    """(src, dst) edges between fingerprints of (fp), all different, that are within BUDGET bits, as forests by task."""
    n = classes.count()
    depth = min(MAX_DEPTH, max(8, math.ceil(math.log2(max(1, n) / 4096))))
    turned = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("key")), F.struct(F.lit(1).alias("turn"), F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)").alias("key"))))
    keys = classes.select(turned.alias("t")).select("t.turn", "t.key", F.shiftrightunsigned(F.col("t.key"), 64 - depth).cast("int").alias("node"))
    nodes = cut(keys.groupBy("turn", "node").agg(F.ceil(F.count(F.lit(1)) / F.lit(NODE)).cast("int").alias("chunks")))
    small = F.broadcast if 2 ** (depth + 1) <= MAX_BROADCAST else (lambda t: t)
    own = small(nodes.withColumnRenamed("chunks", "own"))
    other = small(nodes.select("turn", F.col("node").alias("partner"), F.col("chunks").alias("other")))
    masks = F.array(F.lit(0), *[F.lit(1 << i) for i in range(depth)])
    pairs = keys.join(own, ["turn", "node"]).withColumn("partner", F.explode(F.transform(masks, lambda m: F.col("node").bitwiseXOR(m)))).join(other, ["turn", "partner"])
    mine = F.pmod(F.xxhash64("key"), F.col("own")).cast("int")
    dealt = pairs.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    first = F.when(F.col("node") == F.col("partner"), F.col("i") <= F.col("j")).otherwise(F.col("node") < F.col("partner"))
    units = dealt.select(
        "turn", F.least("node", "partner").alias("low"), F.greatest("node", "partner").alias("high"),
        F.when(first, F.col("i")).otherwise(F.col("j")).alias("ci"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("cj"),
        F.when(first, 0).otherwise(1).alias("side"), "key",
    )

    def join(table):
        import numpy as np
        import pyarrow as pa

        from sievework.llm.forest import Forest

        at = {c: table.column(c)[0].as_py() for c in ("turn", "low", "high", "ci", "cj")}
        side, key = (table.column(c).to_numpy() for c in ("side", "key"))
        key = key.view(np.uint64)
        order = np.lexsort((key, side))
        side, key = side[order], key[order]
        fp = (key << np.uint64(32) | key >> np.uint64(32) if at["turn"] else key).view(np.int64)
        cut_at = int(np.searchsorted(side, 1))
        same = at["low"] == at["high"] and at["ci"] == at["cj"]
        a, b, shift = (key, key, 0) if same else (key[:cut_at], key[cut_at:], cut_at)
        forest = Forest(len(key))
        if len(a) and len(b):
            for x, y in walk(a, b, depth, int(at["low"] != at["high"]), same):
                forest.link(x, y + shift)
        x, y = forest.edges()
        return pa.table({"src": fp[x], "dst": fp[y]})

    return units.groupBy("turn", "low", "high", "ci", "cj").applyInArrow(join, "src long, dst long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links lead to."""
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(trie_links(classes))
    grouped = cut(classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("part")))
    ids = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "part").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_digest(docs: DataFrame, **options) -> DataFrame:
    return near_duplicates(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """One document of each group: that with the least doc_id, then the least hash of its text; ids that are null come last."""
    marked = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text", F.struct("*").alias("d"))
    prints = cut(fingerprints(marked.select(F.struct("_id", "_h").alias("doc_id"), "text"), shingle))
    classes = cut(prints.groupBy("fp").agg(F.min(_place("doc_id")).alias("first")))
    parts = connected_components(trie_links(classes))
    grouped = classes.join(parts, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("part"), "first")
    heads = grouped.groupBy("part").agg(F.min("first").alias("f")).select(F.col("f.id").alias("head"), F.col("f.h").alias("mark"))
    kept = marked.join(heads.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("head")) & (F.col("_h") == F.col("mark")), "left_semi")
    return kept.dropDuplicates(["_id", "_h"]).select("d.*")


def _place(c: str):
    """Order of documents: by doc_id, nulls last, then by the text's hash."""
    return F.struct(F.col(f"{c}._id").isNull().alias("last"), F.col(f"{c}._id").alias("id"), F.col(f"{c}._h").alias("h"))
