"""Links of a page: extraction from text, ranking, and the flags of a followed link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import urls

# Shorteners, messaging hosts, top-level domains, words.
SHORTENERS = ["bit.ly", "tinyurl.com", "reurl.cc", "pse.is", "lihi.cc", "lihi1.com", "lihi2.com", "lihi3.com", "0rz.tw", "is.gd", "cutt.ly", "shorturl.at", "t.cn", "goo.su", "ppt.cc", "rb.gy", "tiny.cc", "linktr.ee", "lin.ee", "bio.link"]
MESSAGING = {"line.me": "LINE", "lin.ee": "LINE", "t.me": "Telegram", "telegram.me": "Telegram", "wa.me": "WhatsApp", "api.whatsapp.com": "WhatsApp", "chat.whatsapp.com": "WhatsApp", "u.wechat.com": "WeChat"}
RISKY_TLDS = ["shop", "top", "cc", "site", "xyz", "asia", "store", "online", "icu", "vip", "buzz", "cyou", "sbs"]
SHOP_WORDS = ["貨到付款", "限時", "倒數", "特價", "原價", "折扣", "下單", "立即購買", "搶購", "僅剩", "庫存", "免運", "七天鑑賞", "買一送一"]
COMPANY_WORDS = ["統一編號", "統編", "公司地址", "營業登記", "客服電話", "退貨政策", "隱私權政策"]
INVEST_WORDS = ["飆股", "老師", "帶單", "選股", "加入群組", "股票群", "投資群", "領取名單", "免費領取", "穩賺", "保證獲利", "內線"]
INTERNAL = ["instagram.com", "facebook.com", "fb.com", "meta.com", "threads.net", "threads.com", "messenger.com", "fbcdn.net", "cdninstagram.com", "whatsapp.com", "oculus.com", "x.com", "twitter.com", "dcard.tw", "youtube.com", "google.com", "apple.com", "tiktok.com", "ptt.cc"]
# Fixed value: an address printed in a text.
URL_PATTERN = r"(?iU)(?<![@\w.])((?:https?://)?(?:[a-z0-9-]+\.)+(?:com|net|org|tw|cc|top|shop|xyz|site|vip|me|ee|ly|io|co|gd|at|info|online|store|asia|icu|app|link|cn|hk|buzz|cyou|sbs)(?:/[^\s，。、）)」」\"'<>]*)?)"


def host_in(host: Column, domains: list[str]) -> Column:
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host == d) | F.endswith(host, F.lit("." + d))
    return hit


def urls_in_text(text: Column) -> Column:
    """Addresses printed in a text, without mail domains, scheme added, in order and once."""
    plain = F.regexp_replace(text, r"@\s+", "@")
    found = F.regexp_extract_all(plain, F.lit(URL_PATTERN), 1)
    full = F.transform(found, lambda u: F.regexp_replace(F.when(F.startswith(F.lower(u), F.lit("http")), u).otherwise(F.concat(F.lit("https://"), u)), "[.,]+$", ""))
    return F.array_distinct(full)


def rank_links(links: DataFrame, limit: int = 4, internal: list[str] = INTERNAL) -> DataFrame:
    """From (page, page_host, url, source): each page's links, most suspicious first, once per host and path."""
    u = links.withColumn("url", urls.unwrap_click(F.col("url"))).withColumn("p", urls.parts(F.col("url")))
    host = F.regexp_replace("p.host", r"^www\.", "")
    u = u.withColumn("host", host).where((F.col("host") != "") & (F.col("host") != F.col("page_host")) & (~host_in(F.col("host"), list(internal)) | host_in(F.col("host"), list(MESSAGING))))
    priority = F.when(host_in(F.col("host"), SHORTENERS), 0).when(host_in(F.col("host"), list(MESSAGING)), 1).when(urls.top_label(F.col("host")).isin(RISKY_TLDS), 2).otherwise(3)
    u = u.withColumn("priority", priority)
    once = u.withColumn("n", F.row_number().over(Window.partitionBy("page", "host", "p.path").orderBy("priority", "url", "source"))).where("n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("priority", "url", "source")))
    return ranked.where(F.col("rank") <= limit).select("page", "rank", "url", "source", "priority", "host")


def links_with_context(texts: DataFrame, chars: int = 200) -> DataFrame:
    """(page, url, source, context) from (page, source, text): addresses with the line on which each stands first in the order of sources and lines."""
    lines = texts.select("page", "source", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    found = lines.select("page", "source", "at", "line", F.explode(urls_in_text(F.col("line"))).alias("url"))
    first = found.groupBy("page", "url").agg(F.min(F.struct("source", "at", "line")).alias("f"))
    return first.select("page", "url", "f.source", F.substring(F.trim("f.line"), 1, chars).alias("context"))


def link_flags(hosts: Column, final_host: Column, start_host: Column, *, status: Column, path: Column, text: Column, listed: Column, lookalike: Column, reason: Column) -> Column:
    """array<struct(signal, level)> for one followed link; brand rules are joined in separately."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    flag = lambda cond, name, level: F.when(yes(cond), F.struct(F.lit(name).alias("signal"), (F.lit(level) if isinstance(level, str) else level).alias("level")))
    sites = F.array_distinct(F.transform(hosts, lambda h: F.coalesce(urls.platform_of(h), urls.registrable(h))))
    risky = urls.top_label(final_host).isin(RISKY_TLDS) | urls.top_label(start_host).isin(RISKY_TLDS)
    labels = F.concat(*[F.slice(F.split(h, r"\."), 1, F.greatest(F.lit(0), F.size(F.split(h, r"\.")) - 1)) for h in (start_host, final_host)])
    odd = F.exists(labels, lambda x: F.rlike(x, F.lit(r"^(?=[a-z0-9]*\d)[a-z0-9]{1,5}$")))
    group = F.rlike(F.lower(path), F.lit(r"/ti/g|/r/ti/g|joinchat|/\+")) | (final_host == "chat.whatsapp.com")
    words = lambda ws: sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0))
    items = [
        flag(listed, "listed", "high"),
        flag(lookalike, "lookalike", "high"),
        flag((status == "blocked") & ~yes(listed) & ~yes(lookalike), "blocked_hop", "high"),
        flag(F.exists(hosts, lambda h: host_in(h, SHORTENERS)), "shortener", "low"),
        flag(F.size(sites) >= 3, "multi_hop", "medium"),
        flag(F.exists(hosts, lambda h: host_in(h, list(MESSAGING))) | host_in(final_host, list(MESSAGING)), "private_chat", F.when(group, "medium").otherwise("low")),
        flag(risky, "risky_tld", "low"),
        flag(odd, "random_host", F.when(risky, "medium").otherwise("low")),
        flag((status == "error") | ((status == "unusable") & reason.isin("http_error", "load_error", "unreachable")), "unreachable", "low"),
        flag((words(SHOP_WORDS) >= 3) & (words(COMPANY_WORDS) == 0), "one_page_shop", "medium"),
        flag(words(INVEST_WORDS) >= 2, "investment_landing", "medium"),
    ]
    return F.filter(F.array(*items), lambda x: x.isNotNull())
