"""Evidence of a case as columns: extracted statements, the 27 features, the fused decision and what it rests on.

A model's result is struct(status, prediction, fraud_confidence, logit_difference).
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.stats import logit
from sievework.functions.text import quote_key
from sievework.operators.fusion import contributions, linear_score
from sievework.operators.metrics import conformal_set
from sievework.operators.signals import PATTERNS

# The features in their order, by group; the sign a weight may have (others are free); tactics and speech acts.
ACCOUNT = [*PATTERNS, "throwaway_profile", "large_audience", "random_digit_handle", "simplified_chinese"]
STATEMENTS = ["llm_tactic_count", "llm_solicitation", "llm_addresses_reader", "llm_risk", "llm_benign_act"]
IMAGE = ["image_known_scam_match", "image_brand_mismatch", "image_editor_tag"]
GROUPS = {"text": ["text_logit", "text_missing"], "ocr": ["ocr_logit", "ocr_missing"], "account": ACCOUNT, "llm": [*STATEMENTS, "llm_missing"], "image": IMAGE}
NEGATIVE = ["verified_badge", "large_audience", "llm_benign_act"]
FREE = ["text_missing", "ocr_missing", "llm_missing"]
TACTICS = ["guaranteed_return", "off_platform_contact", "investment_group", "impersonation", "urgency", "upfront_payment", "crypto_transfer", "job_lure", "romance_lure", "prize_or_giveaway", "account_phishing", "threat_or_extortion", "charity_request"]
SPEECH_ACTS = ["solicitation", "advertisement", "discussion", "news_or_info", "personal_share", "ui_or_navigation", "other"]
BENIGN_ACTS = ["discussion", "news_or_info", "personal_share", "ui_or_navigation"]
EDITORS = ["photoshop", "gimp", "snapseed", "picsart", "meitu", "美圖", "canva", "lightroom", "pixlr", "faceapp"]
STATEMENT_SCHEMA = "speech_act string, addresses_reader boolean, tactics array<struct<tactic:string,quote:string>>, risk string, rationale string"
MODEL_RESULT = "struct<status:string,prediction:string,fraud_confidence:double,logit_difference:double>"


def feature_names(groups: list[str] | None = None) -> list[str]:
    """Features of the groups, all by default."""
    return [f for g in groups or GROUPS for f in GROUPS[g]]


def sign_bounds(names: list[str]) -> tuple[list[str], list[str]]:
    """(positive, negative): risk evidence may only raise the score, benign evidence only lower it."""
    return [n for n in names if n not in FREE and n not in NEGATIVE], [n for n in names if n in NEGATIVE]


def statement_key(model: str, version: str, text: Column) -> Column:
    """Key of a cached answer: what was asked, of which model, by which prompt."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), F.substring(F.trim(text), 1, 3000)), 256)


def with_statements(cases: DataFrame, answers: DataFrame, model: str, version: str, text: str = "text") -> DataFrame:
    """Cases with the raw answer of a table of (key, answer), and what is left to ask: pending is true without one; texts under eight characters are not asked."""
    asked = cases.withColumn("_key", statement_key(model, version, F.col(text))).withColumn("_short", F.length(quote_key(F.coalesce(F.col(text), F.lit("")))) < 8)
    out = asked.join(answers.select(F.col("key").alias("_key"), "answer"), "_key", "left")
    return out.withColumn("pending", F.col("answer").isNull() & ~F.col("_short")).withColumn("answer", F.when(~F.col("_short"), F.col("answer"))).drop("_key", "_short")


def parse_statements(answer: Column, text: Column) -> Column:
    """A raw JSON answer checked against its schema and its text: quotes must stand in the text, names outside the lists fall back.

    struct(status, speech_act, addresses_reader, tactics, rejected, risk, rationale); SKIPPED_TEXT_EMPTY without an answer, unavailable if it does not parse.
    """
    raw, said = F.from_json(answer, STATEMENT_SCHEMA), quote_key(F.coalesce(text, F.lit("")))
    trimmed = F.transform(F.coalesce(raw["tactics"], F.array().cast("array<struct<tactic:string,quote:string>>")), lambda t: F.struct(t["tactic"].alias("tactic"), F.trim(F.coalesce(t["quote"], F.lit(""))).alias("quote")))
    holds = lambda t: F.coalesce(t["tactic"].isin(TACTICS), F.lit(False)) & (F.length(quote_key(t["quote"])) >= 2) & F.contains(said, quote_key(t["quote"]))
    sound = F.size(F.map_keys(F.from_json(answer, "map<string,string>"))) > 0
    return F.struct(
        F.when(answer.isNull(), "SKIPPED_TEXT_EMPTY").when(F.coalesce(sound, F.lit(False)), "SUCCESS").otherwise("unavailable").alias("status"),
        F.when(raw["speech_act"].isin(SPEECH_ACTS), raw["speech_act"]).otherwise("other").alias("speech_act"),
        F.coalesce(raw["addresses_reader"], F.lit(False)).alias("addresses_reader"),
        F.filter(trimmed, holds).alias("tactics"),
        F.filter(trimmed, lambda t: ~holds(t)).alias("rejected"),
        F.when(raw["risk"].isin("low", "medium", "high"), raw["risk"]).otherwise("low").alias("risk"),
        F.substring(F.coalesce(raw["rationale"], F.lit("")), 1, 120).alias("rationale"),
    )


def statement_features(s: Column) -> Column:
    """The five features of a parse_statements result; null unless it succeeded."""
    level = F.when(s["risk"] == "high", 2).when(s["risk"] == "medium", 1).otherwise(0)
    values = [F.size(F.array_distinct(F.transform(s["tactics"], lambda t: t["tactic"]))), (s["speech_act"] == "solicitation").cast("int"), s["addresses_reader"].cast("int"), level, s["speech_act"].isin(BENIGN_ACTS).cast("int")]
    return F.when(s["status"] == "SUCCESS", F.array(*[v.cast("double") for v in values]))


def model_logit(result: Column) -> Column:
    """The log odds of a model's result: its own if it gives them, else from its confidence; null unless it succeeded."""
    return F.when(result["status"] == "SUCCESS", F.coalesce(result["logit_difference"], logit(result["fraud_confidence"])))


def feature_vector(text_model: Column, ocr_model: Column, signals: Column, statements: Column, image: Column) -> Column:
    """array<double> in the order of feature_names(), from two model results, the names of fired signals, statement_features and three image flags."""
    zero = F.lit(0.0)
    scores = []
    for result in (text_model, ocr_model):
        z = model_logit(result)
        scores += [F.when(z.isNull(), 0.0).otherwise(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)) / 4), z.isNull().cast("double")]
    fired = [F.coalesce(F.array_contains(signals, n), F.lit(False)).cast("double") for n in ACCOUNT]
    said = [F.coalesce(F.get(statements, F.lit(i)), zero) for i in range(len(STATEMENTS))]
    said = [F.least(v, F.lit(4.0)) / 2 if n in ("llm_tactic_count", "llm_risk") else v for n, v in zip(STATEMENTS, said)]
    return F.array(*scores, *fired, *said, statements.isNull().cast("double"), *[F.coalesce(F.get(image, F.lit(i)).cast("double"), zero) for i in range(len(IMAGE))])


def read_model(path: str) -> dict | None:
    """A fitted model from a JSON file, or None if there is none to read."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def choose_model(requested: str, default: str, adapted: str, adapted_weights: str, weights: str, force_default: bool = False) -> tuple[str, str]:
    """(scorer, weights): the adapted pair where the default was asked for and both parts are there."""
    both = (Path(adapted) / "config.json").is_file() and Path(adapted_weights).is_file()
    return (adapted, adapted_weights) if not force_default and Path(requested).resolve() == Path(default).resolve() and both else (requested, weights)


def check_identity(artifact: dict, identity: dict) -> None:
    """A calibration belongs to one model; another one may not use it."""
    if artifact.get("version") != 1 or artifact.get("input_kind") != "document_logit_difference":
        raise ValueError("not a calibration of document scores")
    if artifact.get("model_files_sha256") != identity:
        raise ValueError("the calibration was fitted for another model")


def decide(features: Column, model: dict) -> Column:
    """struct(status, fraud_score, prediction, prediction_set, basis, contributions) of a model with feature_names, weights, bias and conformal."""
    places = {n: i for i, n in enumerate(feature_names())}
    own = F.array(*[F.get(features, F.lit(places[n])) for n in model["feature_names"]])
    p = linear_score(own, model["weights"], model["bias"])
    limits = model.get("conformal")
    members = conformal_set(p, F.lit(limits["q_fraud"]), F.lit(limits["q_normal"])) if limits else F.array().cast("array<string>")
    one = F.size(members) == 1
    prediction = F.when(one, F.get(members, F.lit(0))).otherwise("Unknown") if limits else F.when(p > 0.5, "Fraud").otherwise("Normal")
    basis = F.when(one, "conformal_singleton").when(F.size(members) > 1, "conformal_ambiguous").otherwise("conformal_empty") if limits else F.lit("argmax_no_conformal")
    return F.struct(F.lit("SUCCESS").alias("status"), p.alias("fraud_score"), prediction.alias("prediction"), members.alias("prediction_set"), basis.alias("basis"), contributions(own, model["feature_names"], model["weights"]).alias("contributions"))


def promoted(text_model: Column, ocr_model: Column) -> tuple[Column, Column]:
    """(text, ocr): a picture's text counts as the case's own where the case has none."""
    usable = lambda r: F.when(r["status"] == "SUCCESS", r)
    text, ocr = usable(text_model), usable(ocr_model)
    return F.coalesce(text, ocr), F.when(text.isNotNull(), ocr)


def decide_content(text_model: Column, ocr_model: Column, signals: Column, statements: Column, image: Column, agreement: Column, model: dict | None) -> Column:
    """struct(prediction, basis): the fitted decision where there is a model and a score, else the agreement of the sources."""
    rule = F.struct(agreement["prediction"].alias("prediction"), agreement["basis"].alias("basis"))
    if model is None:
        return rule
    text, ocr = promoted(text_model, ocr_model)
    fitted = decide(feature_vector(text, ocr, signals, statements, image), model)
    return F.when(text.isNotNull() | ocr.isNotNull(), F.struct(fitted["prediction"].alias("prediction"), fitted["basis"].alias("basis"))).otherwise(rule)


def editor_tag(exif: Column) -> Column:
    """The editing program that a picture's own data (a map) names, or null."""
    software = F.lower(F.coalesce(F.try_element_at(exif, F.lit("Software")), F.lit("")))
    return F.get(F.filter(F.array(*[F.lit(e) for e in EDITORS]), lambda e: F.contains(software, e)), F.lit(0))


def text_argmax(result: Column) -> Column:
    """The text model alone."""
    return F.when(result["prediction"].isin("Fraud", "Normal"), result["prediction"]).otherwise("Unknown")


def compact(result: Column) -> Column:
    """A model's result without what evaluation does not need."""
    return F.when(result.isNotNull(), F.struct(*[result[f].alias(f) for f in ("status", "prediction", "fraud_confidence", "logit_difference")]))
