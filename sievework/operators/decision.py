"""Ordered decisions over columns: sources, fusion of sources, base risk and its escalation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_decision(status: Column, prediction: Column, probability: Column) -> Column:
    usable = (status == "SUCCESS") & prediction.isin("Fraud", "Normal")
    sound = probability.isNotNull() & ~F.isnan(probability) & probability.between(0, 1)
    return F.when(~F.coalesce(usable, F.lit(False)), "Unavailable").when(~sound | (probability == 0.5), "Uncertain").when(probability < 0.5, "Normal").otherwise("Fraud")


def fuse_sources(a: Column, b: Column) -> Column:
    """struct(prediction, basis) of two source decisions; they must agree, or one alone must decide."""
    away = lambda x: x == "Unavailable"
    decides = lambda x: x.isin("Fraud", "Normal")
    out = lambda p, basis: F.struct((F.lit(p) if isinstance(p, str) else p).alias("prediction"), F.lit(basis).alias("basis"))
    return (
        F.when(away(a) & away(b), out("Unknown", "no_usable_model_evidence"))
        .when(~decides(a) & ~decides(b), out("Unknown", "tied_or_invalid_scores"))
        .when(decides(a) & decides(b) & (a != b), out("Unknown", "modality_conflict"))
        .when((decides(a) != decides(b)) & ~away(a) & ~away(b), out("Unknown", "tied_or_invalid_source"))
        .when(away(a), out(b, "single_modality"))
        .when(away(b), out(a, "single_modality"))
        .otherwise(out(a, "modalities_agree"))
    )


def base_risk(domain_score: Column, capture_allowed: Column, browser_status: Column, model_status: Column, prediction: Column, model_basis: Column, has_rules: Column) -> Column:
    """struct(level, basis): domain rules first, then an unusable page, then the model."""
    out = lambda level, basis: F.struct(F.lit(level).alias("level"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(~capture_allowed) | yes(domain_score >= 60), out("High", "domain_rule"))
        .when(yes(browser_status != "success"), out("Unknown", "page_unusable"))
        .when(~yes(model_status == "SUCCESS"), out("Unknown", "insufficient_evidence"))
        .when(yes(prediction == "Fraud"), out("Medium", "content_model_signal"))
        .when(yes(prediction == "Normal") & yes(has_rules), out("Unknown", "normal_with_rule_signal"))
        .when(yes(prediction == "Normal") & ~yes(model_basis == "single_modality"), out("Low", "limited_content_evidence"))
        .when(yes(prediction == "Normal"), out("Unknown", "single_modality_normal_insufficient"))
        .when(yes(model_basis.isin("modality_conflict", "conformal_ambiguous", "conformal_empty")), out("Unknown", model_basis))
        .otherwise(out("Unknown", "insufficient_evidence"))
    )


def escalate(risk: Column, *, worst_link: Column, risky_links: Column, blocked_shots: Column, brand_mismatch: Column, image_only: Column, shown_chars: Column, concrete: Column, exact_image: Column) -> Column:
    """The later evidence, in its order: links, screenshot domains, brands, too little text, a known image.

    Only too little text lowers a level, and a known image can raise it again.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    to = lambda level, basis: F.struct(F.lit(level).alias("level"), F.lit(basis).alias("basis"))
    r = F.when(yes(worst_link == "high") & (risk["level"] != "High"), to("High", "redirect_rule")).when(yes(risky_links > 0) & risk["level"].isin("Low", "Unknown"), to("Medium", "redirect_heuristic")).otherwise(risk)
    r = F.when(yes(blocked_shots) & (r["level"] != "High"), to("High", "screenshot_domain")).otherwise(r)
    r = F.when(yes(brand_mismatch) & (r["level"] != "High"), to("High", "brand_impersonation")).otherwise(r)
    r = F.when(yes(image_only) & (r["level"] == "Medium") & yes(shown_chars < 30) & ~yes(concrete), to("Unknown", "too_little_text")).otherwise(r)
    return F.when(yes(exact_image) & (r["level"] != "High"), to("High", "known_scam_image")).otherwise(r)


def link_risk(levels: Column) -> Column:
    """One risk from the levels of a link's flags."""
    n = lambda x: F.size(F.filter(levels, lambda v: v == x))
    return F.when(n("high") > 0, "high").when((n("medium") >= 2) | ((n("medium") > 0) & (n("low") > 0)), "medium").when(F.size(levels) > 0, "low").otherwise("none")


def page_problem(title: Column, body: Column, url: Column, status: Column, has_password: Column, error_phrases: list[str], obstructed: Column | None = None) -> Column:
    """Why a page has no content to judge, or null."""
    text = F.lower(F.concat_ws("\n", title, body))
    error = F.lit(False)
    for phrase in error_phrases:
        error = error | F.contains(text, F.lit(phrase))
    login = F.coalesce(has_password, F.lit(False)) | F.contains(F.lower(url), F.lit("/login")) | F.contains(text, F.lit("登入後繼續")) | F.contains(text, F.lit("log in to continue"))
    out = F.when(status.isNull() | (status >= 400), "http_error").when(error, "load_error").when(login, "login_wall")
    if obstructed is not None:
        out = out.when(F.coalesce(obstructed, F.lit(False)), "obstructing_overlay")
    return out.when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty_page")


def squash_chain(urls: Column, final: Column) -> Column:
    """A redirect chain without consecutive repeats, ending in the final address."""
    ended = F.when(final.isNull(), urls).otherwise(F.array_append(urls, final))
    return F.filter(ended, lambda x, i: (i == 0) | (x != F.get(ended, i - 1)))
