"""Near copies on word shingles: SimHash links and an exact Jaccard self-join over prefixes of rare shingles.

A document's set holds the hashes of its five-word shingles; equal sets are one class. Candidates come in three
ways; most are ruled out by parity bits (hashed bits of a set, as many as it has items, each flipped by every item there:
sets differ in at least as many items as in bits), and the rest is verified on the whole sets (Jaccard 0.8 or more):

* fingerprints of the shingles that the trie self-join of simhash links (3 bits of 64);
* prefixes: two sets of sizes m and n with that Jaccard share an item among the first n - ceil(0.8 n) + 1 of each, in
  whatever order all sets stand. The order is by document count, rare first, read from a table of hashed counts of
  fixed size (what it leaves out changes the order, not the result), then by hash. Of up to SMALL sets that
  share an item all pairs are candidates; of more, each with the least only (a star), so that a group of
  thousands of copies gives as many pairs as it has members;
* where the sets of such an item then stand in several components, those outside the item's largest one
  with the rest.

Two sets with the Jaccard are thus compared, or joined through others already: no link between components is
missed. Sizes and places in the order rule out candidates that cannot reach the similarity. Items that many
documents have are dealt in chunks, each with a star of its own.

Rows: null and blank texts have the empty set and are one class; texts under five words are one shingle; documents
without a doc_id and different texts of one doc_id are documents like others; other columns are kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm import simhash
from sievework.operators.components import connected_components
from sievework.runtime import cut, stored

SHINGLE = 5
NUM, DEN = 4, 5  # the least Jaccard, as a fraction: all comparisons are of whole numbers
SLOTS = 1 << 20
CHUNK = 1_000
SMALL = 6
BITS = 512  # at least
MAX_NODES = 500_000  # more candidates, or documents to drop, than this are not broadcast


def shingle_hashes(text: str | None, shingle: int = SHINGLE):
    """64-bit hashes of the lower-cased word shingles, in order, with repeats."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    h = np.array([digest(w, 42) for w in words], np.uint64)
    out = np.zeros(len(h) - shingle + 1, np.uint64)
    for i in range(shingle):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[i : i + len(out)] ^ (h[i : i + len(out)] >> np.uint64(29)))
        out ^= out >> np.uint64(32)
    return out


def shingle_set(text: str | None, shingle: int = SHINGLE):
    """Sorted distinct hashes of the shingles."""
    import numpy as np

    return np.unique(shingle_hashes(text, shingle))


def slot_counts(docs: DataFrame):
    """About how many sets have an item of each slot, zero for slots that no task finds frequent."""
    import numpy as np

    slots = SLOTS

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(slots, np.int64)
        for batch in batches:
            for t in simhash.texts(batch.column(0)):
                at, n = np.unique((shingle_set(t) % np.uint64(slots)).astype(np.int64), return_counts=True)
                counts[at] += n
        at = np.flatnonzero(counts > max(2, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts = np.zeros(slots, np.int64)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return counts


def prefixes(docs: DataFrame) -> DataFrame:
    """(id, h, h1, h2, n, fp, bits, items, chunks) from (id, h, text): the set's 128-bit hash and size, its fingerprint and parity bits, its prefix, and into how many chunks each item is dealt (null: one)."""
    import numpy as np

    shared, slots, chunk = docs.sparkSession.sparkContext.broadcast(slot_counts(docs)), SLOTS, CHUNK

    def run(batches):
        import pyarrow as pa
        import xxhash

        table = shared.value
        for batch in batches:
            hs, ns, fps, bits, items, chunks = [], [], [], [], [], []
            for t in simhash.texts(batch.column(2)):
                each = shingle_hashes(t)
                s = np.unique(each)
                n = len(s)
                df = table[(s % np.uint64(slots)).astype(np.int64)]
                first = np.lexsort((s, df))[: n - -(-NUM * n // DEN) + 1]
                d = df[first]
                hs.append(xxhash.xxh3_128_digest(s.tobytes()))
                ns.append(n)
                fps.append(simhash.majority(each) if n else 0)
                wide = max(BITS, 1 << max(0, n - 1).bit_length())
                odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % wide, minlength=wide) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
                items.append(s[first].view(np.int64))
                chunks.append((1 + d // chunk).astype(np.int32) if d.max(initial=0) >= chunk else None)
            h = np.frombuffer(b"".join(hs), "<i8").reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ns, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "h1", "h2", "n", "fp", "bits", "items", "chunks"])

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, h1 long, h2 long, n int, fp long, bits array<long>, items array<long>, chunks array<int>")


def sets_of(docs: DataFrame) -> DataFrame:
    """(rep, items) from (rep, text): the whole sets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in simhash.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "items"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, items array<long>")


def shared_items(reps: DataFrame) -> DataFrame:
    """(item, own, of, c, rep, place, head): prefix items that a chunk of sets shares; place packs the set's size and the item's place in it."""
    each = reps.select("rep", "n", "chunks", F.posexplode("items").alias("i", "item"))
    rows = each.select("item", F.coalesce(F.get("chunks", F.col("i")), F.lit(1)).alias("of"), "rep", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("place"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    chunk = Window.partitionBy("item", "own")
    return rows.withColumn("c", F.count(F.lit(1)).over(chunk)).withColumn("head", F.min(F.struct("rep", "place")).over(chunk)).where("c > 1 or of > 1")


def _able(x, y):
    """Whether sets of these sizes, with a common item first at these places, can have the similarity."""
    n = lambda p: F.shiftright(p, 32)
    i = lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)) + 1
    most = F.least(i(x), i(y)) + F.least(n(x) - i(x), n(y) - i(y))
    return (DEN * n(x) >= NUM * n(y)) & (DEN * n(y) >= NUM * n(x)) & ((NUM + DEN) * most >= NUM * (n(x) + n(y)))


def _near(a: str, b: str, total):
    """Whether parity bits allow the similarity of two sets of so many items together; the longer bits are folded onto the shorter."""
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2 + 1).cast("int"), (F.size(c) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    fold = lambda c, other: F.when(F.size(c) == 2 * F.size(other), half(F.col(c))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (NUM + DEN) * apart <= (DEN - NUM) * total


def _pair(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def first_candidates(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of a few sets that share an item, stars of more. All are pairs within a chunk, or of two chunks' heads."""
    few = shared.where((F.col("c") <= SMALL) & (F.col("c") > 1)).select("item", "own", "rep", "place")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.own") == F.col("y.own")) & (F.col("x.rep") < F.col("y.rep")) & _able(F.col("x.place"), F.col("y.place")))
    out = pairs.select(*_pair(F.col("x.rep"), F.col("y.rep")))
    star = shared.where((F.col("c") > SMALL) & (F.col("rep") != F.col("head.rep")) & _able(F.col("place"), F.col("head.place")))
    out = out.unionByName(star.select(*_pair(F.col("head.rep"), F.col("rep"))))
    heads = shared.where("of > 1").groupBy("item", "own").agg(F.min("head").alias("head"))
    least = heads.groupBy("item").agg(F.min("head").alias("least"))
    across = heads.join(least, "item").where((F.col("head.rep") != F.col("least.rep")) & _able(F.col("head.place"), F.col("least.place")))
    return out.unionByName(across.select(*_pair(F.col("head.rep"), F.col("least.rep")))).distinct()


def cross_candidates(shared: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a < b: of items that only stars have covered, the pairs of sets in different components that parity bits do not rule out."""
    many = shared.where((F.col("c") > SMALL) | (F.col("of") > 1)).select("item", "rep", "place")
    many = many.join(parts, F.col("rep") == F.col("node"), "left").select("item", "rep", "place", F.coalesce("component", "rep").alias("part"))
    sizes = many.groupBy("item", "part").agg(F.count(F.lit(1)).alias("n"))
    major = sizes.groupBy("item").agg(F.max_by("part", F.struct("n", "part")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("item", "major")
    mixed = cut(many.join(major, "item").join(classes.select("rep", "bits"), "rep"))
    x, y = mixed.where("part <> major").alias("x"), mixed.alias("y")
    once = (F.col("y.part") == F.col("y.major")) | (F.col("x.rep") < F.col("y.rep"))
    pairs = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.part") != F.col("y.part")) & once & _able(F.col("x.place"), F.col("y.place")) & _near("x.bits", "y.bits", F.shiftright("x.place", 32) + F.shiftright("y.place", 32)))
    return pairs.select(*_pair(F.col("x.rep"), F.col("y.rep"))).distinct()


def print_candidates(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: classes of one fingerprint, each with the least, and of fingerprints that the trie links."""
    least = classes.groupBy("fp").agg(F.min("rep").alias("rep"))
    same = classes.select("fp", F.col("rep").alias("r")).join(least, "fp").where(F.col("r") != F.col("rep")).select(*_pair(F.col("rep"), F.col("r")))
    links = simhash.trie_links(least.select("fp"))
    near = links.join(least.select(F.col("fp").alias("src"), F.col("rep").alias("x")), "src").join(least.select(F.col("fp").alias("dst"), F.col("rep").alias("y")), "dst")
    return same.unionByName(near.select(*_pair(F.col("x"), F.col("y"))))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): pairs of classes whose sets have the similarity. docs has (id, h, text), classes (rep, id, h, n, bits) of a document each."""
    side = lambda c, k: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    sketched = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    pairs = cut(sketched.where((DEN * F.col("n1") >= NUM * F.col("n2")) & (DEN * F.col("n2") >= NUM * F.col("n1"))).where(_near("bits1", "bits2", F.col("n1") + F.col("n2"))).select("a", "b"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    nodes = few(nodes.join(classes.select("rep", F.col("id").alias("of_id"), F.col("h").alias("of_h")), "rep"))
    texts = docs.join(nodes, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h"))).select("rep", "text")
    sets = cut(sets_of(texts)).dropDuplicates(["rep"])
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b")
    c = F.size(F.array_intersect("x", "y"))
    return both.where(DEN * c >= NUM * (F.size("x") + F.size("y") - c)).select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """(row, id, h, head): each document of (id, h, text) and the row of the first of its group, by id (nulls last) and hash of the text."""
    sketches = stored(prefixes(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "h", "row")
    firsts = sketches.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    members = stored(sketches.select("row", "id", "h", "h1", "h2").join(firsts, ["h1", "h2"]).select("row", "id", "h", F.col("first.row").alias("rep")), "members")
    classes = sketches.withColumnRenamed("row", "rep").join(few(members.where("row <> rep").select(F.col("row").alias("rep"))), "rep", "left_anti")
    shared = stored(shared_items(classes), "shared")
    edges = cut(verified(docs, classes, first_candidates(shared).unionByName(print_candidates(classes.select("rep", "fp"))).distinct()))
    parts = connected_components(edges, "a", "b")
    more = verified(docs, classes, cross_candidates(shared, parts, classes))
    parts = connected_components(edges.unionByName(more), "a", "b")
    named = members.join(parts, F.col("rep") == F.col("node"), "left").select("row", "id", "h", F.coalesce("component", "rep").alias("part"))
    heads = named.groupBy("part").agg(F.min(place).alias("first"))
    return named.join(heads, "part").select("row", "id", "h", F.col("first.row").alias("head"))


def few(rows: DataFrame) -> DataFrame:
    """To be broadcast if there are at most MAX_NODES rows."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= MAX_NODES else rows


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: that with the least doc_id, then the least hash of its text; ids that are null come last.

    What goes is looked up, not what stays, so that texts are moved only where there is much of it, or where rows are equal.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text", F.struct("*").alias("d"))
    known = stored(groups(marked.select("id", "h", "text")), "groups")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])
    heads, rest = known.where("row = head").select("id", "h"), known.where("row <> head").select("id", "h").distinct()
    gone = few(rest.join(heads, same(rest, heads), "left_anti"))
    again = cut(heads.join(rest, same(heads, rest), "left_semi"))
    kept = marked.join(gone, same(marked, gone), "left_anti")
    if not again.isEmpty():
        again = few(again)
        equal = kept.join(again, same(kept, again), "left_semi").dropDuplicates(["id", "h"])
        kept = kept.join(again, same(kept, again), "left_anti").unionByName(equal)
    return kept.select("d.*")
