"""Text scorers behind one interface, a default one of hashed character n-grams, and what is asked of a scorer.

Any object with `identity` and `score(rows, key, text)` will do; a large model is one that maps batches of texts. Results are
(key, result) with result struct(status, prediction, fraud_confidence, normal_confidence, num_chunks, logit_difference).
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievework.functions.stats import sigmoid
from sievework.functions.text import clean_text, windows_of
from sievework.operators.screen import rule_hints
from sievework.operators.segments import deletions, effects, pair_deletions, pair_effects


class TextScorer(Protocol):
    identity: dict

    def score(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...


def result_of(z: Column, chunks: Column) -> Column:
    """A model's result from the mean log odds of a text's chunks; none of them: nothing to score."""
    p = sigmoid(z)
    some = chunks > 0
    return F.struct(
        F.when(some, "SUCCESS").otherwise("SKIPPED_TEXT_EMPTY").alias("status"),
        F.when(some, F.when(z > 0, "Fraud").otherwise("Normal")).otherwise("Unknown").alias("prediction"),
        F.when(some, p).alias("fraud_confidence"),
        F.when(some, 1 - p).alias("normal_confidence"),
        chunks.cast("int").alias("num_chunks"),
        F.when(some, z).alias("logit_difference"),
    )


class HashedNgramScorer:
    """Logistic regression over hashed character n-grams; a text of over `size` characters is scored in overlapping windows."""

    def __init__(self, buckets: int = 1 << 14, grams: tuple[int, ...] = (2, 3), size: int = 512, overlap: int = 64):
        self.buckets, self.grams, self.size, self.overlap = buckets, grams, size, overlap
        self.model, self.identity = None, {}

    def _chunks(self, rows: DataFrame, key: str, text: str, *more: str) -> DataFrame:
        """(key, at, grams): the n-grams of each window of the cleaned text."""
        clean = rows.select(F.col(key).alias("key"), *more, clean_text(F.col(text)).alias("t")).where("t <> ''")
        chars = clean.select("key", *more, F.filter(F.split(F.lower("t"), ""), lambda x: x != "").alias("c"))
        chunk = chars.select("key", *more, F.posexplode(windows_of(F.col("c"), self.size, self.overlap)).alias("at", "c"))
        every = [F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("c") - n)), lambda i, n=n: F.array_join(F.slice("c", i + 1, F.lit(n)), "")) for n in self.grams]
        return chunk.select("key", *more, "at", F.concat(*every).alias("grams"))

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        from pyspark.ml.feature import HashingTF

        return HashingTF(numFeatures=self.buckets, binary=True, inputCol="grams", outputCol="x").transform(chunks)

    def fit(self, rows: DataFrame, key: str, text: str, label: str, weight: str | None = None, l2: float = 1.0) -> "HashedNgramScorer":
        """Rows weigh what weight says, and their windows share that equally."""
        from pyspark.ml.classification import LogisticRegression

        w = F.col(weight) if weight else F.lit(1.0)
        chunks = self._chunks(rows.withColumn("_y", F.col(label).cast("double")).withColumn("_w", w.cast("double")), key, text, "_y", "_w")
        counts = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        data = self._vectors(chunks).join(counts, "key").withColumn("_w", F.col("_w") / F.col("_n"))
        total = data.agg(F.sum("_w")).first()[0] or 1.0
        self.model = LogisticRegression(featuresCol="x", labelCol="_y", weightCol="_w", regParam=l2 / total, standardization=False, maxIter=60).fit(data)
        self.identity = {"kind": "hashed_ngrams", "buckets": self.buckets, "grams": list(self.grams), "bias": float(self.model.intercept)}
        return self

    def score(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(self._vectors(self._chunks(rows, key, text))).select("key", vector_to_array("rawPrediction")[1].alias("z"))
        mean = scored.groupBy("key").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))
        all_rows = rows.select(F.col(key).alias("key")).join(mean, "key", "left")
        return all_rows.select("key", result_of(F.col("z"), F.coalesce("n", F.lit(0))).alias("result"))

    def attributions(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, gram, value): what each distinct n-gram of a one-window text adds to its log odds; with the bias they add up to it."""
        spark = rows.sparkSession
        weights = spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.model.coefficients.toArray()) if v], "bucket int, value double")
        grams = self._chunks(rows, key, text).where("at = 0").select("key", F.explode(F.array_distinct("grams")).alias("gram"))
        from pyspark.ml.feature import HashingTF

        tf = HashingTF(numFeatures=self.buckets, binary=True)
        bucket = F.udf(lambda v: int(v.indices[0]), "int")  # of distinct n-grams only
        distinct = grams.select("gram").distinct().select("gram", F.array("gram").alias("one"))
        placed = grams.join(tf.setInputCol("one").setOutputCol("v").transform(distinct).select("gram", bucket("v").alias("bucket")), "gram")
        # grams of one text that share a bucket count once, under the least of them
        once = placed.groupBy("key", "bucket").agg(F.min("gram").alias("gram"))
        return once.join(F.broadcast(weights), "bucket").select("key", "gram", "value")


def process_text(scorer: TextScorer, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, result, rule_signals): the score of a page's own text, and plain hints that never change it."""
    hints = rows.select(F.col(key).alias("key"), rule_hints(F.coalesce(F.col(text), F.lit(""))).alias("rule_signals"))
    return scorer.score(rows, key, text).join(hints, "key")


def rescore(scorer: TextScorer, base: DataFrame, texts: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """The base table with its text results replaced by another scorer's; cases without a text keep what they have."""
    new = scorer.score(texts.join(base.select(key), key, "left_semi"), key, text)
    kept = new.where("result.status = 'SUCCESS'").select(F.col("key").alias(key), F.struct("result.status", "result.prediction", "result.fraud_confidence", "result.logit_difference").alias("_r"))
    return base.join(kept, key, "left").withColumn("text_model", F.coalesce("_r", "text_model")).drop("_r")


def explain_report(scorer: TextScorer, sources: DataFrame, limit: int = 64, pair_budget: int = 6) -> tuple[DataFrame, DataFrame]:
    """For (case_id, source, segments): (effects of single segments, effects of pairs), each source by itself.

    The texts with segments left out are scored together, not one case after the other.
    """
    cases = sources.select(F.to_json(F.struct("case_id", "source")).alias("id"), "segments")

    def scored(texts: DataFrame, parts: list[str]) -> DataFrame:
        keyed = texts.withColumn("_k", F.to_json(F.struct("id", *parts)))
        results = scorer.score(keyed, "_k", "text").select(F.col("key").alias("_k"), F.col("result.fraud_confidence").alias("score"))
        return keyed.join(results, "_k", "left").drop("_k", "text")

    singles = scored(deletions(cases, limit), ["index"])
    ranked = effects(singles)
    pairs = pair_effects(scored(pair_deletions(cases, ranked, pair_budget), ["first", "second"]), singles)
    schema = "case_id string, source string"
    named = lambda d: d.select(F.from_json("id", schema).alias("c"), *[c for c in d.columns if c != "id"]).select("c.*", *[c for c in d.columns if c != "id"])
    return named(ranked), named(pairs)


def compare_regions(scorer: TextScorer, cases: DataFrame, identity: dict) -> DataFrame:
    """(case_id, region, text, result) of the readings that lie on the page's own text and of those that do not.

    cases has (case_id, coverage), coverage as spatial_coverage gives it. The scorer must be the one that the report was made with.
    """
    if identity != scorer.identity:
        raise ValueError("compare with the scorer of the report")
    items = cases.where("coverage is not null").select("case_id", F.explode(F.array(F.lit("matched"), F.lit("unmatched"))).alias("region"), "coverage")
    text = F.array_join(F.transform(F.filter("coverage", lambda x: x["kind"] == F.col("region")), lambda x: x["text"]), "\n")
    rows = items.select("case_id", "region", text.alias("text")).withColumn("_k", F.concat_ws("|", F.col("case_id").cast(StringType()), "region"))
    return rows.join(scorer.score(rows, "_k", "text").withColumnRenamed("key", "_k"), "_k").drop("_k")


def model_card(model: dict | None, results: list[dict] | None = None) -> dict:
    """What to tell of a fitted model: its features, limits and, where there are results, its figures."""
    if model is None:
        return {"status": "unavailable"}
    figures = next((r for r in results or [] if r.get("name") == model.get("version")), None)
    return {"status": "available", "features": len(model["feature_names"]), "alpha": (model.get("conformal") or {}).get("alpha"), "sign_constrained": model.get("sign_constrained"), "trained_on": model.get("trained_on"), "figures": figures}
