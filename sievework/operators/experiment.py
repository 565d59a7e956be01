"""Comparing methods: the manifest with its scores, predictions from reports, slices, gates, conformal and behavioural rates.

Every figure is a conditional sum per group, added up before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.metrics import conformal_set, confusion
from sievework.operators.screen import filter_text

# Platforms that are reported together; several slices may hold one case.
SLICES = {"Threads": ["Threads"], "Facebook": ["FB"], "一般網頁": ["Web"], "LINE／TikTok／IG／YT": ["LINE", "Tiktok", "IG", "YT"]}
OTHER = ("other", "Threads")


def _rate(condition: Column, of: Column | None = None) -> Column:
    """Share of the rows (of those for which of holds) that meet a condition; null without any."""
    inside = F.lit(True) if of is None else of
    return F.round(F.avg(F.when(inside, F.coalesce(condition, F.lit(False)).cast("int"))), 6)


def assemble(manifest: DataFrame, base: DataFrame, statements: DataFrame) -> DataFrame:
    """The manifest's cases that were scored, with their results and statements.

    base has (case_id, text_model, ocr_model, account), statements (case_id, llm). A case without a text result takes its
    picture's in its place; one without either goes; one without statements has none.
    """
    rows = manifest.join(base.select("case_id", "text_model", "ocr_model", "account"), "case_id").where("text_model is not null or ocr_model is not null")
    rows = rows.withColumn("_image_only", F.col("text_model").isNull())
    rows = rows.withColumn("text_model", F.coalesce("text_model", "ocr_model")).withColumn("ocr_model", F.when(~F.col("_image_only"), F.col("ocr_model"))).drop("_image_only")
    return rows.join(statements.select("case_id", "llm"), "case_id", "left")


def reports_of(cases: DataFrame, documents: DataFrame, path: str = "report_path") -> DataFrame:
    """Cases joined with their report documents of (file, doc) by the file's name; a case without its report raises downstream as a null doc."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return cases.withColumn("_f", name).join(documents.select(F.col("file").alias("_f"), "doc"), "_f", "left").drop("_f")


def report_predictions(*, domain: Column, hops: Column, final: Column, dom: Column, ocr: Column, browser_status: Column, risk_level: Column) -> Column:
    """struct(domain_only, text_only, fusion, probability) that a saved report stands for.

    domain and final are struct(risk_score, capture_allowed), hops an array of them; dom and ocr are model results. A page that
    was not captured has neither a text prediction nor, unless a domain rule fired, a fused one.
    """
    alarming = lambda d: F.coalesce(d["risk_score"] >= 60, F.lit(False)) | F.coalesce(~d["capture_allowed"], F.lit(False))
    fired = alarming(domain) | alarming(final) | F.coalesce(F.exists(hops, alarming), F.lit(False))
    usable = lambda r: F.when((r["status"] == "SUCCESS") & r["prediction"].isin("Fraud", "Normal"), r)
    single = F.coalesce(usable(dom), usable(ocr))
    lost = browser_status.isNotNull() & ~browser_status.isin("success", "skipped")
    fused = F.when(fired | risk_level.isin("High", "Medium"), "Fraud").when(risk_level == "Low", "Normal").otherwise("Unknown")
    return F.struct(
        F.when(fired, "Fraud").otherwise("Unknown").alias("domain_only"),
        F.when(~lost, F.coalesce(single["prediction"], F.lit("Unknown"))).otherwise("Unknown").alias("text_only"),
        F.when(~fired & browser_status.isNotNull() & (browser_status != "success"), "Unknown").otherwise(fused).alias("fusion"),
        F.when(~lost, single["fraud_confidence"]).alias("probability"),
    )


def method_metrics(rows: DataFrame, methods: list[str], label: str = "label", keep: list[str] = ("case_id",), errors: int = 20) -> DataFrame:
    """Per method (a column of predictions): confusion, rates, coverage and the first wrong cases in the order of keep.

    F1 is null where there is nothing to find and nothing was found.
    """
    each = rows.select(label, *keep, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("prediction")) for m in methods])).alias("m")).select(label, *keep, "m.*")
    out = confusion(each, label, "prediction", ["method"], null_f1=True).withColumn("coverage", F.round(1 - F.col("unknown") / F.col("n"), 6))
    wrong = each.where(F.col("prediction") != F.col(label)).select("method", F.struct(*keep, label, "prediction").alias("e"))
    first = _first_n(wrong, "method", "e", errors).groupBy("method").agg(F.sort_array(F.collect_list("e")).alias("error_cases"))
    return out.join(F.broadcast(first), "method", "left")


def _first_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    from pyspark.sql.window import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def platform_slices(platform: Column) -> Column:
    """The slices that a case's first platform belongs to; other holds all but one platform and overlaps the rest."""
    own = [F.when(platform.isin(ps), F.lit(name)) for name, ps in SLICES.items()] + [F.when(platform != OTHER[1], F.lit(OTHER[0]))]
    return F.filter(F.array(*own), lambda x: x.isNotNull())


def metrics_by_slice(rows: DataFrame, platform: Column, label: str = "label", prediction: str = "prediction") -> DataFrame:
    sliced = rows.select(label, prediction, F.explode(platform_slices(platform)).alias("slice"))
    return confusion(sliced, label, prediction, ["slice"])


def hard_negative_rates(rows: DataFrame, prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """How many cases that are presumed normal a method calls fraud, and how many it leaves open."""
    p = F.col(prediction)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _rate(p == "Fraud").alias("fpr"), _rate(p == "Unknown").alias("unknown_rate"))


def conformal_report(rows: DataFrame, p: str, label: str, q_fraud: float, q_normal: float) -> DataFrame:
    """Coverage per class, how many sets decide nothing, and how often those that do are right."""
    y, members = F.col(label) == 1, conformal_set(F.col(p), F.lit(q_fraud), F.lit(q_normal))
    s = rows.select(y.alias("y"), members.alias("s")).withColumn("decided", F.size("s") == 1)
    right = F.array_contains("s", "Fraud") == F.col("y")
    return s.agg(_rate(F.array_contains("s", "Fraud"), F.col("y")).alias("coverage_fraud"), _rate(F.array_contains("s", "Normal"), ~F.col("y")).alias("coverage_normal"), _rate(~F.col("decided")).alias("unknown_rate"), _rate(right, F.col("decided")).alias("accuracy_when_decided"))


def behavioural_cases(tests: DataFrame) -> DataFrame:
    """(type, expect, raw, text) of behavioural tests (type, expect, texts, padding): with padding the text stands after its first four lines; text is what the line filter leaves."""
    each = tests.select("type", "expect", "padding", F.explode("texts").alias("t"))
    padded = F.array_join(F.concat(F.slice("padding", 1, 4), F.array("t"), F.slice("padding", 5, F.greatest(F.lit(0), F.size("padding") - 4))), "\n")
    rows = each.select("type", "expect", F.when(F.coalesce(F.size("padding"), F.lit(0)) > 0, padded).otherwise(F.col("t")).alias("raw"))
    return rows.withColumn("text", filter_text(F.col("raw"))["text"])


def behaviour_rates(rows: DataFrame, raw: str, system: str) -> DataFrame:
    """Per type and expectation: how often the text model alone and the system meet it, and how often the system says the opposite."""
    e, s = F.col("expect"), F.col(system)
    out = rows.groupBy(F.concat_ws(":", "type", "expect").alias("kind")).agg(F.count(F.lit(1)).alias("n"), _rate(F.col(raw) == e).alias("raw_pass"), _rate(s == e).alias("system_pass"), _rate((s != e) & (s != "Unknown")).alias("system_wrong"))
    return out


def ood_error_rates(rows: DataFrame, label: str = "label", prediction: str = "prediction", flagged: str = "flagged") -> DataFrame:
    """How many texts are unlike the known ones, and how often a decision about those and about others is wrong."""
    wrong, out = F.col(prediction) != F.col(label), F.col(flagged)
    return rows.agg(F.count(F.lit(1)).alias("n"), _rate(out).alias("flagged_rate"), _rate(wrong, out).alias("error_flagged"), _rate(wrong, ~out).alias("error_unflagged"))


def disagreement(rows: DataFrame, fraud_confidence: str, label: str = "label") -> DataFrame:
    """Where the text model and the statements (struct llm) disagree: how many cases, and how many of them are fraud."""
    said = F.col("llm.status") == "SUCCESS"
    tactics = F.coalesce(F.size("llm.tactics"), F.lit(0)) > 0
    calm, risky = said & (F.col("llm.risk") == "low") & ~tactics, said & (F.col("llm.risk").isin("medium", "high") | tactics)
    kind = F.when((F.col(fraud_confidence) > 0.5) & calm, "text_fraud_llm_low").when((F.col(fraud_confidence) <= 0.5) & risky, "text_normal_llm_risky")
    return rows.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), _rate(F.col(label) == "Fraud").alias("fraud_rate"))


def sample_gates(rows: DataFrame, split: str = "split", label: str = "label", group: str = "group_id", probability: str = "probability") -> DataFrame:
    """Per split and label: cases, scored cases and groups, and whether there are enough to report, calibrate and train."""
    out = rows.groupBy(split, label).agg(F.count(F.lit(1)).alias("cases"), F.count(probability).alias("scored"), F.count_distinct(group).alias("groups"))
    return out.withColumn("enough_to_report", F.col("cases") >= 30).withColumn("enough_to_calibrate", F.col("scored") >= 10).withColumn("enough_to_train", F.col("groups") >= 2)


def known_image_features(cases: DataFrame, images: DataFrame, pmax: int = 10, dmax: int = 14, normal_within: int = 12) -> DataFrame:
    """(case_id, known): whether a case's image is that of a training fraud case of another group which no normal training case shows.

    cases has (case_id, group_id, split, label), images (case_id, phash, dhash). Pairs come from bands of the phash.
    """
    from sievework.operators.images import bands, bits, shown_in

    rows = cases.join(images, "case_id").where("phash is not null and dhash is not null")
    train = rows.where("split = 'train'")
    fraud = train.where("label = 'Fraud'").groupBy("phash", "dhash", "group_id").agg(F.min("case_id").alias("ref"))
    clean = fraud.join(shown_in(fraud.select("ref", "phash"), train.where("label = 'Normal'"), normal_within), "ref", "left_anti")
    a = rows.select("case_id", F.col("group_id").alias("g"), F.col("phash").alias("p1"), F.col("dhash").alias("d1"), F.explode(bands(F.col("phash"), pmax + 1)).alias("band"))
    b = clean.select("group_id", F.col("phash").alias("p2"), F.col("dhash").alias("d2"), F.explode(bands(F.col("phash"), pmax + 1)).alias("band"))
    near = (F.col("g") != F.col("group_id")) & (bits("p1", "p2") <= pmax) & (bits("d1", "d2") <= dmax)
    hits = a.join(b, "band").where(near).select("case_id").distinct().withColumn("_hit", F.lit(1))
    return cases.select("case_id").join(hits, "case_id", "left").select("case_id", F.coalesce("_hit", F.lit(0)).alias("known"))


def without_statements(rows: DataFrame) -> DataFrame:
    """The cases as if the statements had not been asked for."""
    return rows.withColumn("llm", F.lit(None).cast(rows.schema["llm"].dataType))
