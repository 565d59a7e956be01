"""Account, tactic and screen-line signals by rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import changed_share, line_key, profile_counts

# Signal, pattern, weight.
PATTERNS = {
    "off_platform_contact": (r"(line\s*(?:id|🆔)?\s*[:：]?\s*@?[a-z0-9_.\-]{4,}|🆔\s*[:：]?\s*@?[a-z0-9_.\-]{4,}|加\s*(?:我|一下|我的)?\s*(?:賴|line|LINE)|line\.me/\S+|lin\.ee/\S+|t\.me/\S+|telegram|wa\.me/\S+|whatsapp|微信|vx\s*[:：]|wechat)", 2.0),
    "short_link": (r"(tinyurl\.com|bit\.ly|reurl\.cc|pse\.is|lihi\d?\.\w+|0rz\.tw|is\.gd|cutt\.ly|shorturl\.at|t\.cn|goo\.su|ppt\.cc)", 1.5),
    "guaranteed_return": (r"(保證(?:獲利|賺|回本|收益)|穩賺|零風險|保本|包賺|月入\s*\d|日賺|日入|翻倍|報酬率\s*\d+\s*%|賺到\s*\d+\s*倍)", 2.0),
    "investment_lure": (r"(飆股|老師帶|帶單|報牌|選股|投顧|熱搜名單|股票群|投資群|內線|主力|抄底|漲停)", 1.0),
    "crypto_or_payment": (r"(usdt|泰達幣|虛擬貨幣|加密貨幣|幣安|入金|出金|匯款|轉帳|儲值|點數卡)", 1.0),
    "urgency": (r"(限時|名額有限|最後\s*\d+\s*(?:名|位|天)|倒數|立即|馬上|錯過|今天就)", 0.5),
    "free_giveaway": (r"(免費(?:索取|領取|送|加入)|限量贈送|抽獎|中獎|領取獎|0\s*元)", 1.0),
    "job_lure": (r"(在家(?:工作|兼職)|輕鬆賺|日領|打字員|按讚賺|代購兼職|高薪輕鬆|無經驗可|時薪\s*\d{4})", 1.5),
    "impersonation_claim": (r"(官方客服|金管會|證交所|中華郵政|165|警察局|檢察官|法院|台積電|國稅局|銀行客服|蝦皮客服)", 1.0),
    "verified_badge": (r"(已驗證|verified)", -1.0),
}
# A rule set for Latin-script texts, used by the queries over the driver's documents.
LATIN_PATTERNS = {
    "mail_contact": (r"((?<![a-z0-9._-])[a-z0-9._-]++@[a-z0-9-]+\.[a-z]+)", 2.0),
    "address_literal": (r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", 1.5),
    "phone_like": (r"([0-9]{3}[- ][0-9]{3}[- ][0-9]{4})", 1.0),
    "token_assignment": (r"((?:token|password|api_key) ?[=:])", 2.0),
    "rights_notice": (r"(all rights reserved|copyright)", -1.0),
}


def pattern_signals(text: Column, patterns: dict[str, tuple[str, float]] = PATTERNS, chars: int = 80) -> Column:
    """array<struct(signal, weight, evidence)> of the rules that match, with what they matched."""
    hits = [F.struct(F.lit(name).alias("signal"), F.lit(weight).alias("weight"), F.regexp_extract(text, f"(?iU){pattern}", 1).alias("hit")) for name, (pattern, weight) in patterns.items()]
    found = F.filter(F.array(*hits), lambda x: x["hit"] != "")
    return F.transform(found, lambda x: F.struct(x["signal"].alias("signal"), x["weight"].alias("weight"), F.substring(F.trim(x["hit"]), 1, chars).alias("evidence")))


def rule_score(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda a, s: a + s["weight"])


def profile_signals(followers: Column, posts: Column, handle: Column) -> Column:
    one = lambda cond, name, w: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("signal"), F.lit(w).alias("weight")))
    items = [one((followers <= 20) & (F.coalesce(posts, F.lit(0.0)) <= 10), "throwaway_profile", 1.5), one(followers >= 100_000, "large_audience", -1.0), one(F.rlike(handle, F.lit(r"\d{5,}")), "random_digit_handle", 1.0)]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def screen_line_reason(line: Column, lexicon: list[str], risk: str | None = None) -> Column:
    """Why a line is interface and not content, or null; a line that matches risk always stays."""
    key = line_key(line)
    han = F.length(F.regexp_replace(key, "[^㐀-鿿]", ""))
    out = F.when(key == "", "empty").when(key.isin(lexicon), "ui_lexicon").when(F.rlike(key, F.lit(r"^[\d,.]+[kmw萬千]?$")), "bare_number").when((han <= 1) & (F.length(key) <= 3), "too_short")
    return out if risk is None else F.when(~F.rlike(line, F.lit(f"(?iu){risk}")), out)


def accepted_marks(confidence: str, image: str) -> Column:
    """OCR acceptance: at least 0.30 and, with over two marks, the image's mean less a deviation (0.1 at least)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(image)
    floor = F.when(F.count(F.lit(1)).over(w) > 2, F.greatest(F.lit(0.1), F.avg(confidence).over(w) - F.stddev_samp(confidence).over(w))).otherwise(F.lit(0.0))
    return F.col(confidence) >= F.greatest(F.lit(0.3), floor)


def account_signals(text: Column, handle: Column, simplified: str = "") -> Column:
    """struct(signals, counts, rule_score) of a profile's text: rules, what the profile counts, its handle, its script.

    Without a handle those that the text mentions are looked at; simplified lists the simplified characters.
    """
    said = F.coalesce(text, F.lit(""))
    counts = profile_counts(said)
    named = F.when(handle.isNotNull(), F.array(handle)).otherwise(F.regexp_extract_all(said, F.lit(r"(?i)@([a-z0-9_.]{3,30})"), 1))
    odd = F.get(F.filter(named, lambda h: F.rlike(h, F.lit(r"\d{5,}"))), F.lit(0))
    own = F.transform(profile_signals(counts["followers"], counts["posts"], odd), lambda s: F.struct(s["signal"].alias("signal"), s["weight"].alias("weight"), F.when(s["signal"] == "random_digit_handle", F.concat(F.lit("@"), odd)).otherwise(F.concat(F.lit("followers="), F.format_string("%.0f", counts["followers"]), F.when(s["signal"] == "throwaway_profile", F.concat(F.lit(", posts="), F.format_string("%.0f", F.coalesce(counts["posts"], F.lit(0.0))))).otherwise(""))).alias("evidence")))
    script = F.filter(F.array(F.when(changed_share(said, simplified) >= 0.08, F.struct(F.lit("simplified_chinese").alias("signal"), F.lit(0.5).alias("weight"), F.lit("").alias("evidence")))), lambda s: s.isNotNull())
    signals = F.concat(pattern_signals(said), own, script)
    return F.struct(signals.alias("signals"), counts.alias("counts"), rule_score(signals).alias("rule_score"))
