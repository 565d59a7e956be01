"""The review of cases by people: answers onto a queue, rules for a corpus, and its one-time writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import nfkc
from sievework.sources.files import write_once

# Fields that a reviewed row needs, splits, evidence sources.
REQUIRED = ["case_id", "group_id", "split", "label", "label_source", "reviewer", "permission", "notes"]
ANSWERS = ["label", "group_id", "split", "reviewer", "label_source", "permission", "notes", "pair_id"]
SPLITS = ["train", "validation", "calibration", "test"]
SOURCES = ["dom", "screenshot_ocr"]


def with_reviews(queue: DataFrame, reviews: DataFrame, at: str = "reviewed_at") -> DataFrame:
    """The queue with each case's last answers, trimmed; a case without any stays as it is."""
    last = reviews.groupBy("case_id").agg(F.max_by(F.struct(*ANSWERS), at).alias("_a"))
    merged = queue.join(last, "case_id", "left")
    answer = {c: F.when(F.col("_a").isNotNull(), F.trim(F.coalesce(F.col(f"_a.{c}"), F.lit("")))).otherwise(F.col(c)) for c in ANSWERS}
    answer["status"] = F.when(F.col("_a").isNotNull(), "reviewed").otherwise(F.col("status"))
    return merged.select(*[answer.get(c, F.col(c)).alias(c) for c in queue.columns])


def violations(rows: DataFrame, splits: list[str] = SPLITS) -> DataFrame:
    """(case_id, problem): all that keeps rows from being a corpus; an empty result means they are one."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    own = [F.when(blank(c), F.lit(f"missing_{c}")) for c in REQUIRED]
    own += [
        F.when(no(F.col("label").isin("Fraud", "Normal") & F.col("split").isin(splits)), F.lit("invalid_label_or_split")),
        F.when(no((F.col("status") == "reviewed") & ~F.col("synthetic") & (F.col("scope") == "content")), F.lit("not_a_real_content_review")),
        F.when(no((F.size("texts") > 0) & F.forall(F.map_keys("texts"), lambda k: k.isin(SOURCES))), F.lit("invalid_texts")),
        F.when(F.coalesce(F.exists(F.map_values("texts"), lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""), F.lit(False)), F.lit("empty_text")),
    ]
    parts = [rows.select("case_id", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("problem"))]
    parts.append(rows.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate_case_id").alias("problem")))
    for key in ("group_id", "pair_id"):
        leaking = rows.where(~blank(key)).groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(key)
        parts.append(rows.join(leaking, key, "left_semi").select("case_id", F.lit(f"{key}_leakage").alias("problem")))
    texts = rows.select("case_id", "split", "label", F.explode(F.map_values("texts")).alias("t")).withColumn("digest", F.sha2(F.regexp_replace(F.lower(nfkc("t")), r"(?U)\s+", ""), 256))
    torn = texts.groupBy("digest").agg(F.count_distinct(F.struct("split", "label")).alias("n")).where("n > 1").select("digest")
    parts.append(texts.join(torn, "digest", "left_semi").select("case_id", F.lit("text_in_two_splits_or_labels").alias("problem")))
    return reduce(DataFrame.unionByName, parts).distinct()


def corpus_rows(queue: DataFrame) -> DataFrame:
    """Reviewed rows with a binary label; pending and unresolved ones are left out on purpose."""
    return queue.where((F.col("status") == "reviewed") & F.col("label").isin("Fraud", "Normal"))


def build_corpus(queue: DataFrame, output: str) -> int:
    """Write the corpus once; raises if it is empty, breaks a rule, or is there already. Returns its rows."""
    rows = corpus_rows(queue)
    n = rows.count()
    if not n:
        raise ValueError("no reviewed binary labels")
    found = violations(rows).limit(20).collect()
    if found:
        raise ValueError("not a corpus: " + ", ".join(f"{r.case_id}: {r.problem}" for r in found))
    write_once(rows, output)
    return n
