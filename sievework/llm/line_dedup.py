"""Lines that many documents share: found in sorted hash ranges, returned as run-length keep bitmaps.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Its 128-bit hash goes, with the
document and the position, to a range of (hash, document, text); there rows stand sorted by hash, document and position,
and one pass sees where each document first shows a key. A common key spans as many ranges as its rows
fill, since documents split it; every range adds up its first occurrences, and the partial counts are added per hash, so documents are
counted, not lines, and no task gets a whole key. The sums go back to the lines: keys with at least one in HOT_KEYS of
all first occurrences (HOT_KEYS keys at most, which bounds the broadcast) without a shuffle, all others by a join on the hash. What comes back per document is its kept runs of
lines (start, length): a run-length bitmap, not text.

Rows: a null or empty text is one empty line; keys under min_chars code points are never dropped; rows with
one doc_id count as one document, each of them returned; without a doc_id every different text is a document; other
columns pass through untouched (drop_lines replaces those named like its own, without_shared_lines none); an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.runtime import cut, stored

HOT_KEYS = 10_000
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c):
    """A-Z lower-cased, nothing else; the quick path is for texts without other letters."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, k, pos, h1, h2): one row per line whose key is long enough; k tells apart texts of one doc_id."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("k"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "k", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "k", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, k, pos) of lines whose key is in min_docs documents; keep_first spares a key's first occurrence."""
    by_key = ["h1", "h2"]
    rows = stored(line_hashes(docs, min_chars), "lines").withColumn("nameless", F.when(F.col("doc_id").isNull(), F.col("k")).otherwise(0))
    document = [*by_key, "doc_id", "nameless"]
    nth = F.row_number().over(Window.partitionBy(*document).orderBy("k", "pos"))
    firsts = rows.repartitionByRange(*document).withColumn("nth", nth).where("nth = 1")
    counts = firsts.groupBy(*by_key).agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "k", "pos")).alias("first"))
    shared = cut(counts.where(F.col("docs") >= min_docs))
    often = (shared.agg(F.sum("docs")).first()[0] or 0) // HOT_KEYS + 1
    hot, cold = (shared.where(c).select(*by_key, "first") for c in (F.col("docs") >= often, F.col("docs") < often))
    flagged = rows.join(F.broadcast(hot), by_key, "left")
    rest = flagged.where("first is null").drop("first").join(cold, by_key)
    common = flagged.where("first is not null").unionByName(rest)
    if keep_first:
        common = common.where(~F.struct("doc_id", "k", "pos").eqNullSafe(F.col("first")))
    return common.select("doc_id", "k", "pos")


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, k, drops, first_runs, tail): first_runs are kept runs (start, length) up to the last dropped line, tail where the rest begins."""
    drops = dropped_lines(docs, **options).groupBy("doc_id", "k").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    gaps = F.zip_with("p", F.concat(F.array(F.lit(-1)), F.slice("p", 1, F.size("p") - 1)), lambda p, q: F.struct((q + 1).alias("start"), (p - q - 1).alias("length")))
    return drops.select("doc_id", "k", F.size("p").cast("long").alias("drops"), F.filter(gaps, lambda g: g["length"] > 0).alias("first_runs"), (F.element_at("p", -1) + 1).alias("tail"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the shared lines: kept_text, n_lines, n_dropped and the bitmap keep_runs are added.

    Only this step moves texts, once, by document; the bitmaps are the built side of the join.
    """
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), **options)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text.alias("whole"), F.xxhash64(text).alias("own_k"))
    found = rows.join(bitmaps.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_k") == F.col("k")), "left")
    n = (F.length("whole") - F.length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1).cast("int")
    span = lambda start, length: F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))
    rest = F.when(F.col("tail") < F.col("n"), F.array(span(F.col("tail"), F.col("n") - F.col("tail")))).otherwise(F.array())
    runs = F.when(F.col("tail").isNull(), F.array(span(F.lit(0), F.col("n")))).otherwise(F.concat("first_runs", rest))
    counted = found.withColumn("n", n).withColumn("runs", runs).withColumn("lines", F.when(F.col("tail").isNotNull(), F.split("whole", "\n", -1)))
    kept = F.when(F.col("tail").isNull(), F.col("whole")).otherwise(F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(F.col("lines"), r["start"] + 1, r["length"]))), "\n"))
    added = [kept.alias("kept_text"), F.col("n").cast("long").alias("n_lines"), F.coalesce("drops", F.lit(0)).cast("long").alias("n_dropped"), F.col("runs").alias("keep_runs")]
    replaced = {"kept_text", "n_lines", "n_dropped", "keep_runs"}
    return counted.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in replaced], *added)


def without_shared_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text and n_chars (where there is one) of the lines that stay; all other columns as they are."""
    out = drop_lines(docs.select("doc_id", "text", F.struct("*").alias("row")), **options)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, **options) -> DataFrame:
    out = drop_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS drop FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
