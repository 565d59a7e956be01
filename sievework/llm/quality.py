"""Quality rules: count rules, then divergence of a document from its language.

A document has two histograms: characters by class, and its language's common words against all other words.
Each is compared with the language's reference, the mean histogram of the table's documents of that language
that pass the count rules, by Jensen-Shannon distance (base 2, 0 to 1), so that junk doesn't shift what it is judged
by. A document is rejected if a distance exceeds its limit; documents under min_words are not compared, those under
min_common not by words, and a language without a word list is compared by character classes alone.

Everything is column functions over whole texts. One pass counts, and writes its rows to the shared folder; partial
sums per language make the references, and each row looks its language up in that small table, so no text is
read twice or shuffled. Repeated windows are found by sorting one number per window, its hash above its position;
windows that share a hash with a neighbour are compared by their words, all of an equal run together.

Rows: null and empty texts have no words and fail the count rules; a null language is a language of its own
without a word list; equal rows get equal verdicts; other columns pass through, those named like added ones are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.runtime import cut

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
MAX_LANGUAGES = 10_000
# Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "as", "be", "by", "this", "are"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
CLASSES = ["lower", "upper", "digit", "blank", "symbol", "letter", "rest"]
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def _histograms(docs: DataFrame) -> DataFrame:
    """(row, lang, t, w, n, c_*, class_hist, word_hist) from (row, lang, text)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("row", "lang", t.alias("t"))
    bare = F.btrim("t", F.lit(BLANKS))
    out = out.withColumn("w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK)))
    out = out.withColumn("n", F.size("w").cast("long")).withColumn("s0", F.col("t"))
    for i, pattern in enumerate(["[a-z]+", "[A-Z]+", "[0-9]+", BLANK, "[#*$%&|<>]+", r"\p{L}+"]):
        out = out.withColumn(f"s{i + 1}", F.regexp_replace(f"s{i}", pattern, ""))
    sizes = [F.length(f"s{i}") - F.length(f"s{i + 1}") for i in range(6)] + [F.length("s6")]
    out = out.select("row", "lang", "t", "w", "n", *[s.cast("long").alias(f"c_{c}") for s, c in zip(sizes, CLASSES)])
    listed = None
    for lang, words in COMMON_WORDS.items():
        lits = F.array(*[F.lit(w) for w in words])
        listed = F.when(F.col("lang") == lang, lits) if listed is None else listed.when(F.col("lang") == lang, lits)
    out = out.withColumn("listed", listed).withColumn("common", F.filter("w", lambda x: F.array_contains(F.col("listed"), x)))
    hits = F.transform("listed", lambda x: (F.size("common") - F.size(F.array_remove(F.col("common"), x))).cast("long"))
    out = out.withColumn("hits", hits)
    rest = F.col("n") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    counts = {"class_hist": F.array(*[F.col(f"c_{c}") for c in CLASSES]), "word_hist": F.array_append("hits", rest)}
    share = lambda c, total: F.transform(c, lambda x: x / F.greatest(F.lit(1), total))
    out = out.withColumn("class_hist", share(counts["class_hist"], F.length("t"))).withColumn("word_hist", share(counts["word_hist"], F.col("n")))
    return out.drop("listed", "common", "hits")


def _references(counts: DataFrame) -> DataFrame:
    n_words = len(next(iter(COMMON_WORDS.values()))) + 1
    mean = lambda c, n: F.array(*[F.avg(F.get(F.col(c), F.lit(i))) for i in range(n)])
    return counts.where(~F.col("failed")).groupBy(F.col("lang").alias("of")).agg(mean("class_hist", len(CLASSES)).alias("class_ref"), mean("word_hist", n_words).alias("word_ref"))


def jensen_shannon(p, q):
    """Distance of two histogram columns of equal length; null if either is null or holds a null."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _counts(docs: DataFrame) -> DataFrame:
    """Histograms and all counts from (row, lang, text)."""
    hists = _histograms(docs)
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = hists.withColumn("lines", lines).withColumn("b", F.length(F.bin("n")))
    window = "shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b) | cast(i as bigint)"
    out = out.withColumn("windows", F.expr(f"if(n < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, cast(n - 3 as int)), i -> {window})))"))
    alike = lambda x, y: f"coalesce(shiftright({x}, b) = shiftright({y}, b), false)"
    place = "cast(x & (shiftleft(1L, b) - 1) as int)"
    out = out.withColumn("maybe", F.expr(f"transform(filter(windows, (x, k) -> {alike('x', 'get(windows, k + 1)')} or {alike('x', 'get(windows, k - 1)')}), x -> {place})"))
    out = out.withColumn("spelt", F.expr("sort_array(transform(maybe, p -> named_struct('t', concat_ws(' ', get(w, p), get(w, p + 1), get(w, p + 2)), 'p', p)))"))
    out = out.withColumn("again", F.expr("sort_array(transform(filter(spelt, (x, k) -> coalesce(x.t = get(spelt, k + 1).t, false) or coalesce(x.t = get(spelt, k - 1).t, false)), x -> x.p))"))
    repeat = F.expr("aggregate(again, named_struct('last', -3, 's', 0L), (a, x) -> named_struct('last', x, 's', a.s + least(3, x - a.last)), a -> a.s)")
    chars = (F.length("t") - F.col("c_blank")).cast("long")
    dups = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    return out.select("row", "lang", "class_hist", "word_hist", F.col("n").alias("n_words"), chars.alias("word_chars"), F.col("c_symbol").alias("n_symbols"), dups.alias("n_dup_lines"), repeat.alias("n_repeat_words"), "n")


def quality(docs: DataFrame, *, slim: bool = False, min_words: int = 50, min_common: int = 100, max_repeat_pct: int = 50, class_limit: float = 0.3, word_limit: float = 0.27) -> DataFrame:
    """docs with the counts, base_failed, both distances and kept; slim leaves the texts out of the result."""
    columns = [c for c in docs.columns if c not in ADDED and not (slim and c == "text")]
    failed = (F.col("n") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n"))
    counts = cut(_counts(docs.select("lang", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))).withColumn("failed", failed))
    refs = cut(_references(counts))
    refs = F.broadcast(refs) if refs.count() <= MAX_LANGUAGES else refs
    out = counts.join(refs, F.col("lang").eqNullSafe(F.col("of")), "left")
    out = out.withColumn("class_distance", F.when(F.col("n") >= min_words, jensen_shannon(F.col("class_hist"), F.col("class_ref")))).withColumn("word_distance", F.when(F.col("n") >= min_common, jensen_shannon(F.col("word_hist"), F.col("word_ref"))))
    far = F.coalesce(F.col("class_distance") > class_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    out = out.withColumn("base_failed", F.col("failed")).withColumn("kept", ~F.col("failed") & ~far)
    return out.select(*[F.col(f"row.`{c}`") for c in columns], *ADDED)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents kept, with their own columns."""
    return quality(docs.select("lang", "text", F.struct("*").alias("d")), slim=True, **options).where("kept").select("d.*")
