"""Calibration of a text model's scores per evidence source, from reviewed reports, and its use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.stats import sigmoid
from sievework.operators.evidence import check_identity
from sievework.operators.fusion import fit_isotonic, fit_platt
from sievework.operators.metrics import calibration_scores

NOTES = ["Only the calibration split is fitted; the test split is held out.", "Minimum group counts are a safeguard, not a proof.", "Labels and the separation from the model's training set need a manual audit."]


def mapped_score(z: Column, mapping: dict) -> Column:
    """A calibrated probability: a logistic curve, or a line through the fitted knots, flat outside of them."""
    if mapping["method"] == "platt":
        return sigmoid(z * mapping["slope"] + mapping["intercept"])
    xs, ys = mapping["x"], mapping["y"]
    out = F.lit(ys[-1])
    for (x0, y0), (x1, y1) in reversed(list(zip(zip(xs, ys), zip(xs[1:], ys[1:])))):
        out = F.when(z < x1, F.lit(y0) + (z - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
    return F.when(z <= xs[0], F.lit(ys[0])).otherwise(out)


def weighted_groups(rows: DataFrame) -> DataFrame:
    """Each group weighs one in its split."""
    sizes = rows.groupBy("source", "split", "group_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, ["source", "split", "group_id"]).withColumn("w", 1 / F.col("_n")).drop("_n")


def fit_candidates(rows: DataFrame, identity: dict, method: str = "platt", minimum: int = 10) -> dict:
    """The artifact from (source, split, group_id, label, z, model), z being the log odds of usable results.

    A source needs so many groups of each class in both splits. Rows of another model, or with a score that is not finite, are errors.
    """
    if minimum < 2:
        raise ValueError("at least two independent groups per class")
    usable = rows.where(F.col("split").isin("calibration", "test"))
    bad = usable.agg(F.count_if(~F.col("model").eqNullSafe(F.lit(_name(identity)))), F.count_if(F.col("z").isNull() | F.isnan("z") | (F.abs("z") == float("inf")))).first()
    if bad[0] or bad[1]:
        raise ValueError("make the reports again with this model" if bad[0] else "a score is not finite")
    y = (F.col("label") == "Fraud").cast("int")
    data = weighted_groups(usable.withColumn("y", y)).persist()
    counts: dict = {}
    for r in data.groupBy("source", "split", "y").agg(F.count_distinct("group_id").alias("n")).collect():
        counts.setdefault(r["source"], {}).setdefault(r["split"], {})[r["y"]] = r["n"]
    out = {"version": 1, "status": "candidate_not_validated_for_deployment", "model_files_sha256": identity, "input_kind": "document_logit_difference", "method": method, "sources": {}, "skipped_sources": {}, "limitations": NOTES}
    for source, seen in sorted(counts.items()):
        if not all(seen.get(split, {}).get(label, 0) >= minimum for split in ("calibration", "test") for label in (0, 1)):
            out["skipped_sources"][source] = {"reason": "insufficient_independent_labeled_groups", "counts": seen}
            continue
        own = data.where(F.col("source") == source)
        fitted = own.where("split = 'calibration'")
        if method == "platt":
            slope, intercept = fit_platt(fitted, "z", "y")
            mapping = {"method": "platt", "slope": slope, "intercept": intercept}
        else:
            xs, ys = fit_isotonic(fitted, "z", "y", "w")
            mapping = {"method": "isotonic", "x": xs, "y": ys}
        test = own.where("split = 'test'").withColumn("raw", sigmoid(F.col("z"))).withColumn("calibrated", mapped_score(F.col("z"), mapping))
        figures = {k: calibration_scores(test, "y", k, "w").first().asDict() for k in ("raw", "calibrated")}
        out["sources"][source] = {"mapping": mapping, "group_counts": seen, "test_raw": figures["raw"], "test_calibrated": figures["calibrated"], "automatic_deployment": False}
    data.unpersist()
    return out


def _name(identity: dict) -> str:
    import json

    return json.dumps(identity, sort_keys=True)


def apply_candidate(result: Column, source: str, artifact: dict, identity: dict) -> Column:
    """struct(calibrated_fraud_score, calibration_status) of a model's result; null scores where the result or the source has none."""
    check_identity(artifact, identity)
    entry = artifact["sources"].get(source)
    ok = result["status"] == "SUCCESS"
    p = mapped_score(result["logit_difference"], entry["mapping"]) if entry else F.lit(None).cast("double")
    return F.struct(F.when(ok, p).alias("calibrated_fraud_score"), F.when(ok, F.lit("candidate_applied" if entry else "unavailable_for_source")).alias("calibration_status"))
