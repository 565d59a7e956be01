"""Training of the default scorer from a labelled corpus, and the scoring of a reviewed one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.models.scorer import HashedNgramScorer, TextScorer
from sievework.operators.dataset import balanced_weights
from sievework.operators.metrics import calibration_scores


def check_groups(rows: DataFrame, splits: list[str], group: str = "group_id", label: str = "label", least: int = 2) -> None:
    """Raises unless each split has so many groups of both classes."""
    seen = {(r["split"], r[label]): r["n"] for r in rows.groupBy("split", label).agg(F.count_distinct(group).alias("n")).collect()}
    short = [f"{s}/{y}" for s in splits for y in ("Fraud", "Normal") if seen.get((s, y), 0) < least]
    if short:
        raise ValueError(f"fewer than {least} groups in {', '.join(short)}")


def train_scorer(rows: DataFrame, text: str = "text", group: str = "group_id", penalties: tuple[float, ...] = (0.1, 1.0, 10.0), **options) -> tuple[HashedNgramScorer, dict]:
    """The scorer whose penalty loses least on the calibration split, with the losses.

    rows have case_id, split, label, a group and a text. In each split every group weighs one and the classes weigh the
    same; the test split is not looked at.
    """
    check_groups(rows, ["train", "calibration"], group)
    weighted = {s: balanced_weights(rows.where(F.col("split") == s), group, "label").withColumn("y", (F.col("label") == "Fraud").cast("int")) for s in ("train", "calibration")}
    fitted, losses = {}, {}
    for penalty in penalties:
        fitted[penalty] = HashedNgramScorer(**options).fit(weighted["train"], "case_id", text, "y", "weight", penalty)
        scored = fitted[penalty].score(weighted["calibration"], "case_id", text).select(F.col("key").alias("case_id"), F.col("result.fraud_confidence").alias("p"))
        judged = weighted["calibration"].select("case_id", "y", "weight").join(scored.where("p is not null"), "case_id")
        losses[penalty] = calibration_scores(judged, "y", "p", "weight").first()["log_loss"]
    best = min(penalties, key=lambda x: (losses[x], x))
    return fitted[best], {"penalty": best, "losses": losses, "identity": fitted[best].identity}


def score_corpus(rows: DataFrame, scorer: TextScorer) -> tuple[DataFrame, dict]:
    """(manifest, provenance) of a reviewed corpus: a row per case and source of its texts (a map) with the result; labels are as reviewed.

    Rows have case_id, group_id, split, label, label_source, reviewer, source_url and texts.
    """
    each = rows.select(*[c for c in rows.columns if c != "texts"], F.explode("texts").alias("source", "text"))
    each = each.withColumn("_k", F.to_json(F.struct("case_id", "source")))
    manifest = each.join(scorer.score(each, "_k", "text").withColumnRenamed("key", "_k"), "_k").drop("_k")
    n, digest = rows.agg(F.count(F.lit(1)), F.expr("hex(bit_xor(xxhash64(case_id, label, split)))")).first()
    return manifest, {"cases": n, "corpus": digest, "model": scorer.identity, "labels": "as reviewed"}
