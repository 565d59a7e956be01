"""States and wording of a report, and small results as text: Markdown tables, README blocks, CSV with a byte order mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles by risk level, and what is said when no conclusion is reached.
TITLES = {
    "High": "網址觸發高風險規則",
    "Medium": "文字模型出現風險訊號，尚待查證",
    "Low": "目前取得的文字未呈現一致的詐騙訊號",
    "Unknown": "分析完成，帳號風險仍待查證",
}
OTHER_TITLE, STOPPED_TITLE, BLOCKED_TITLE = "仍待查證", "未取得有效分析結果", "網址已攔截"
INCOMPLETE = {
    "SKIPPED_OCR_LOW_QUALITY": "截圖 OCR 辨識品質不足，未進行內容判斷，風險維持 Unknown。請提供更清晰的圖片。",
    "SKIPPED_OCR_EMPTY": "截圖未取得足夠可辨識文字，風險維持 Unknown。",
    "OCR_ERROR": "OCR 執行失敗，風險維持 Unknown；請查看報告中的 image_analysis.message。",
}
NO_EVIDENCE = "目前沒有足夠有效證據形成結論，風險維持 Unknown。"
# What a feature is called.
FEATURE_LABELS = {
    "text_logit": "MacBERT（帳號文字）",
    "ocr_logit": "MacBERT（圖片內文字）",
    "text_missing": "沒有可用帳號文字",
    "ocr_missing": "沒有圖片內文字",
    "off_platform_contact": "引導站外聯絡",
    "short_link": "短網址",
    "guaranteed_return": "保證獲利／高報酬",
    "investment_lure": "投資招攬用語",
    "crypto_or_payment": "匯款／虛擬貨幣",
    "urgency": "急迫用語",
    "free_giveaway": "免費贈送／中獎",
    "job_lure": "輕鬆高薪兼職",
    "impersonation_claim": "提及官方或機構",
    "verified_badge": "已驗證標章",
    "throwaway_profile": "低粉絲新帳號",
    "large_audience": "大量粉絲",
    "random_digit_handle": "隨機數字帳號名",
    "simplified_chinese": "簡體字比例高",
    "llm_tactic_count": "LLM 抽出的詐騙手法數",
    "llm_solicitation": "LLM：招攬讀者",
    "llm_addresses_reader": "LLM：直接對讀者喊話",
    "llm_risk": "LLM 證據風險等級",
    "llm_benign_act": "LLM：討論／新聞／分享",
    "llm_missing": "LLM 未執行",
    "image_known_scam_match": "與已確認詐騙圖片相似",
    "image_brand_mismatch": "品牌名稱與網域不符",
    "image_editor_tag": "圖片含編修軟體標記",
}
MAX_SHOWN = 1000


def execution(status: Column) -> Column:
    """Whether the analysis ran; that it reached no decision is another matter."""
    return F.when(status.isin("error", "blocked", "unusable"), "stopped").otherwise("completed")


def decision_state(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit("Unknown")) == "Unknown", "needs_review").otherwise("risk_signal_only")


def settled_status(status: Column, content_status: Column, error: Column) -> Column:
    """An incomplete report whose content was analysed without an error is a success."""
    return F.when((status == "incomplete") & (content_status == "SUCCESS") & (F.coalesce(error, F.lit("")) == ""), "success").otherwise(status)


def title(status: Column, level: Column) -> Column:
    named = F.lit(OTHER_TITLE)
    for name, words in TITLES.items():
        named = F.when(F.coalesce(level, F.lit("Unknown")) == name, words).otherwise(named)
    return F.when(status == "blocked", BLOCKED_TITLE).when(status.isin("error", "unusable"), STOPPED_TITLE).otherwise(named)


def incomplete_message(basis: Column, image_status: Column, dom: Column, ocr: Column) -> Column:
    said = lambda c: F.coalesce(c, F.lit("Unknown"))
    out = F.lit(NO_EVIDENCE)
    for status, words in INCOMPLETE.items():
        out = F.when(image_status == status, words).otherwise(out)
    conflict = F.concat(F.lit("分析已執行，但結果衝突：DOM 文字為 "), said(dom), F.lit("，截圖 OCR 為 "), said(ocr), F.lit("。風險維持 Unknown，請人工核對。"))
    return F.when(basis == "modality_conflict", conflict).otherwise(out)


def strength(contribution: Column) -> Column:
    size = F.abs(contribution)
    return F.when(size >= 1.5, "strong").when(size >= 0.5, "medium").otherwise("weak")


def top_reasons(contributions: Column, n: int = 3) -> Column:
    """array<struct(label, value, strength)> of the first contributions, as a report names them."""
    labels = F.create_map(*[F.lit(x) for pair in FEATURE_LABELS.items() for x in pair])
    return F.transform(F.slice(contributions, 1, n), lambda c: F.struct(F.coalesce(F.try_element_at(labels, c["name"]), c["name"]).alias("label"), c["value"].alias("value"), strength(c["value"]).alias("strength")))


def percent_region(boxes: Column, width: Column, height: Column) -> Column:
    """struct(left, top, width, height) in percent of the hull of [left, top, right, bottom] boxes; null if it has no area."""
    edge = lambda i, pick: pick(F.transform(boxes, lambda b: b[i]))
    left, top, right, bottom = (edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))
    region = F.struct((100 * left / width).alias("left"), (100 * top / height).alias("top"), (100 * (right - left) / width).alias("width"), (100 * (bottom - top) / height).alias("height"))
    return F.when((width > 0) & (height > 0) & (right > left) & (bottom > top), region)


def _small(df: DataFrame) -> list:
    """The rows of a report; a result of over MAX_SHOWN rows is no report."""
    rows = df.limit(MAX_SHOWN + 1).collect()
    if len(rows) > MAX_SHOWN:
        raise ValueError(f"over {MAX_SHOWN} rows; aggregate or rank them first")
    return rows


def markdown_table(df: DataFrame, digits: int = 3) -> str:
    """A small result as a table: numbers to so many digits, nulls as a dash, bars escaped."""
    show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in _small(df)]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def splice(document: str, block: str, begin: str, end: str) -> str:
    """The document with the text between two marks replaced; both marks must be there, in order."""
    head, found, rest = document.partition(begin)
    _, closed, tail = rest.partition(end)
    if not found or not closed:
        raise ValueError("the marks are missing")
    return f"{head}{begin}\n{block.strip()}\n{end}{tail}"


def csv_with_mark(df: DataFrame) -> str:
    """A small result as CSV text that spreadsheets take for UTF-8: a byte order mark and CR LF line ends."""
    import csv
    import io

    out = io.StringIO(newline="")
    out.write("\ufeff")
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(tuple("" if v is None else v for v in r) for r in _small(df))
    return out.getvalue()
