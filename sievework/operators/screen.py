"""What a screen shows: interface lines and content, text read from pictures, and where it stands on the page.

One capture is one row; its items, characters, boxes and images are arrays in it, so nothing here joins or shuffles.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import alnum_count, line_key, nfkc, place_ratios, ratio_table, word_key
from sievework.operators.similarity import center_in

# Landmarks and lines of an interface, platform names, what makes a line content whatever it looks like.
LANDMARKS = ["nav", "header", "footer", "aside", "navigation", "banner", "contentinfo", "complementary", "menu", "menubar", "tablist", "dialog", "button"]
UI_LINES = [
    "登入", "登錄", "註冊", "立即註冊", "建立新帳號", "忘記密碼", "忘記密碼?", "登出", "首頁", "搜尋", "探索", "通知", "訊息",
    "更多", "查看更多", "顯示更多", "展開", "收合", "分享", "追蹤", "追蹤中", "讚", "留言", "回覆", "收藏", "檢舉", "設定",
    "隱私權政策", "隱私政策", "使用條款", "服務條款", "cookie政策", "關於", "說明", "幫助中心", "語言", "中文台灣",
    "下載app", "開啟app", "在app中開啟", "使用app開啟", "熱門", "最新", "推薦", "看板", "全部", "貼文", "連續短片", "標註",
    "log in", "login", "sign up", "signup", "log out", "home", "search", "explore", "more", "see more", "see translation",
    "share", "follow", "following", "like", "reply", "comment", "privacy", "terms", "cookies", "about", "help",
    "open app", "get the app", "meta", "api", "jobs", "blog", "locations", "threads", "reels", "posts", "tagged",
]
LOGOS = ["instagram", "facebook", "threads", "dcard", "youtube", "tiktok", "line", "twitter"]
RISK = r"(?iU)(line\s*id|line\.me|lin\.ee|t\.me|wa\.me|telegram|whatsapp|https?://|www\.|@[a-z0-9_.]{3,}|09\d{2}[-\s]?\d{3}[-\s]?\d{3}|匯款|轉帳|入金|出金|usdt|泰達幣|保證|獲利|穩賺|投資|老師|助理|私訊|加賴|加line|領取|中獎|免費|限時|點擊|連結|驗證|帳戶|解凍|退款)"
LATIN_RISK = r"line[\t\n\f\r ]*id|line\.me|lin\.ee|t\.me|wa\.me|telegram|whatsapp|https?://|www\.|@[a-z0-9_.]{3,}|09[0-9]{2}[-\t\n\f\r ]?[0-9]{3}[-\t\n\f\r ]?[0-9]{3}|usdt"
GUARANTEES = ["保證獲利", "穩賺不賠", "零風險", "保證回本"]
PAYMENTS, CONTACTS = ["USDT", "泰達幣", "匯款", "入金"], ["私訊", "加LINE", "加賴", "老師", "助理"]


def line_reasons(lines: Column, lexicon: list[str] = UI_LINES, logos: list[str] = LOGOS) -> Column:
    """array<struct(line, reason)>: why each line that is not empty is interface and not content (null: it is content).

    Keys are made in one call for all lines of a row, and compared with the logos in another.
    """
    clean = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    keys = F.transform(F.split(nfkc(F.array_join(F.transform(clean, lambda x: F.regexp_replace(x, "\n", " ")), "\n")), "\n"), line_key)
    place = F.flatten(F.transform(clean, lambda x, i: F.array_repeat(i, len(logos))))
    ratios = ratio_table(keys, F.array(*[F.lit(x) for x in logos]), gap=max(map(len, logos)) // 2)  # 0.8 needs lengths as close
    like = F.filter(F.zip_with(place, ratios, lambda i, r: F.when(r >= 0.8, i)), lambda x: x.isNotNull())
    logo = F.aggregate(like, F.transform(clean, lambda x: F.lit(False)), lambda flags, i: F.transform(flags, lambda v, j: v | (j == i)))
    han = lambda k: F.length(F.regexp_replace(k, "[^㐀-鿿]", ""))
    rows = F.zip_with(F.zip_with(clean, keys, lambda x, k: F.struct(x.alias("line"), k.alias("key"))), logo, lambda x, v: F.struct(x["line"].alias("line"), x["key"].alias("key"), v.alias("logo")))
    short = lambda k: (han(k) <= 1) & (F.length(k) <= 3)
    out = _judged(rows, sorted({_plain_key(x) for x in lexicon}), r"^[\d,.]+[kmw萬千]?$", short, lambda x: F.rlike(x, F.lit(RISK)))
    return F.when(F.size(clean) > 0, out).otherwise(F.array().cast("array<struct<line:string,reason:string>>"))


def latin_line_reasons(lines: Column, lexicon: list[str]) -> Column:
    """As line_reasons by what SQL can say: ASCII white space, keys as written, no logos, nothing that is special to Chinese."""
    space = r"\t\n\f\r "
    clean = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), rf"^[{space}]+|[{space}]+\z", "")), lambda x: x != "")
    key = lambda x: F.regexp_replace(F.lower(F.translate(x, "İ", "i")), rf"[{space}·•|:：!！?？.。,，、\-_/]+", "")
    rows = F.transform(clean, lambda x: F.struct(x.alias("line"), key(x).alias("key"), F.lit(False).alias("logo")))
    risky = lambda x: F.rlike(F.translate(x, f"{ascii_uppercase}\u212a\u017f", f"{ascii_lowercase}ks"), F.lit(LATIN_RISK))  # noqa: E731  all that folds to a letter of ASCII
    return _judged(rows, lexicon, r"\A[0-9,.]+[kmw]?\z", lambda k: F.length(k) <= 3, risky)


def _judged(rows: Column, known: list[str], number: str, short, risky) -> Column:
    """array<struct(line, reason)> of array<struct(line, key, logo)>."""
    ui = F.array(*[F.lit(x) for x in known])

    def reason(x):
        k = x["key"]
        why = F.when(k == "", "empty").when(F.array_contains(ui, k), "ui_lexicon").when(x["logo"], "platform_logo").when(F.rlike(k, F.lit(number)), "bare_number").when(short(k), "too_short")
        return F.struct(x["line"].alias("line"), F.when(why.isNotNull() & ~risky(x["line"]), why).alias("reason"))

    return F.transform(rows, reason)


def _plain_key(line: str) -> str:
    import re
    import unicodedata

    return re.sub(r"[\s·•|:：!！?？.。,，、\-_/]+", "", unicodedata.normalize("NFKC", line).lower())


def landmark_reasons(items: Column) -> Column:
    """As line_reasons for array<struct(text, region)> of a viewport: an item within a landmark goes as a whole, unless it carries risk."""
    gone = lambda x: F.coalesce(x["region"].isin(LANDMARKS), F.lit(False)) & ~F.rlike(F.coalesce(x["text"], F.lit("")), F.lit(RISK))
    removed = F.transform(F.filter(items, gone), lambda x: F.struct(F.trim(F.coalesce(x["text"], F.lit(""))).alias("line"), F.concat(F.lit("landmark:"), x["region"]).alias("reason")))
    rest = F.flatten(F.transform(F.filter(items, lambda x: ~gone(x)), lambda x: F.split(F.coalesce(x["text"], F.lit("")), r"\r?\n")))
    return F.concat(line_reasons(rest), removed)


def filtered(reasons: Column) -> Column:
    """struct(text, kept_lines, removed, boilerplate_ratio) of judged lines."""
    kept = F.transform(F.filter(reasons, lambda x: x["reason"].isNull()), lambda x: x["line"])
    removed = F.filter(reasons, lambda x: x["reason"].isNotNull())
    return F.struct(F.array_join(kept, "\n").alias("text"), F.size(kept).alias("kept_lines"), removed.alias("removed"), F.when(F.size(reasons) > 0, F.size(removed) / F.size(reasons)).otherwise(0.0).alias("boilerplate_ratio"))


def filter_text(text: Column) -> Column:
    return filtered(line_reasons(F.split(F.coalesce(text, F.lit("")), r"\r?\n")))


def rule_hints(text: Column) -> Column:
    """Names of two plain content rules that fire; they never change a score."""
    says = lambda words: F.exists(F.array(*[F.contains(text, F.lit(w)) for w in words]), lambda x: x)
    return F.filter(F.array(F.when(says(GUARANTEES), "guaranteed_return_claim"), F.when(says(PAYMENTS) & says(CONTACTS), "payment_and_off_platform_contact")), lambda x: x.isNotNull())


def reading_status(texts: Column, failed: Column | None = None) -> Column:
    """Whether the accepted texts of a picture are enough to judge: null if so, else why not."""
    joined = F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\n")
    out = F.when(F.trim(joined) == "", "SKIPPED_OCR_EMPTY").when((F.size(texts) < 2) | (alnum_count(joined) < 20), "SKIPPED_OCR_LOW_QUALITY")
    return out if failed is None else F.when(failed, "OCR_ERROR").otherwise(out)


def page_marks(items: Column) -> Column:
    """array<struct(ch, box)> of a viewport's visible characters; an item whose characters and boxes differ in number keeps its boxes alone."""
    def one(item):
        text = F.coalesce(item["raw"], item["text"])
        n = F.size(item["boxes"])
        return F.transform(item["boxes"], lambda b, i: F.struct(F.when(F.length(text) == n, F.substring(text, i + 1, F.lit(1))).alias("ch"), b.alias("box")))

    return F.flatten(F.transform(F.filter(items, lambda x: F.coalesce(F.size(x["boxes"]), F.lit(0)) > 0), one))


def hull(points: Column, dpr: Column) -> Column:
    """[left, top, right, bottom] in page units of a polygon in screen pixels."""
    xs, ys = (F.transform(points, lambda p: p[i] / dpr) for i in (0, 1))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def align_readings(captures: DataFrame, least: float = 0.9, name: str = "aligned") -> DataFrame:
    """captures with array<struct(place, text, kind, dom_text, similarity, image)>: where each accepted reading of a screenshot comes from.

    captures have marks (page_marks), images array<struct(alt, box)>, readings array<struct(text, accepted, bbox)> and dpr.
    dom_duplicate and ocr_variant stand on characters of the page (similar to them or not), image_text in an image, the first
    that holds its centre; unlocated_text nowhere. Null where there is no scale or nothing was read.
    """
    marks, images, readings, dpr = (F.col(c) for c in ("marks", "images", "readings", "dpr"))
    mid = lambda b, i: (b[i] + b[i + 2]) / 2
    indexed = F.filter(F.transform(readings, lambda r, i: F.struct(i.alias("place"), r["text"].alias("text"), r["accepted"].alias("accepted"), F.when(F.size(r["bbox"]) >= 3, hull(r["bbox"], dpr)).alias("box"))), lambda r: F.coalesce(r["accepted"], F.lit(False)))
    covered = lambda r: F.filter(marks, lambda m: center_in(r["box"], mid(m["box"], 0), mid(m["box"], 1)))
    owner = lambda r: F.array_min(F.filter(F.transform(images, lambda g, i: F.when(center_in(g["box"], mid(r["box"], 0), mid(r["box"], 1), 0.0), i)), lambda x: x.isNotNull()))
    found = F.transform(indexed, lambda r: F.struct(r["place"].alias("place"), r["text"].alias("text"), F.when(r["box"].isNotNull(), F.size(covered(r)) > 0).alias("on_page"), F.when(r["box"].isNotNull(), F.array_join(F.transform(covered(r), lambda m: F.coalesce(m["ch"], F.lit(""))), "")).alias("dom_text"), F.when(r["box"].isNotNull(), owner(r)).alias("image")))
    keys = lambda f: F.transform(F.split(nfkc(F.array_join(F.transform("_found", lambda x: F.regexp_replace(F.coalesce(x[f], F.lit("")), "\n", " ")), "\n")), "\n"), word_key)

    def judge(x, r):
        on_page = F.coalesce(x["on_page"], F.lit(False))
        similarity = F.when(on_page & (x["dom_text"] != ""), r)
        kind = F.when(on_page & (F.coalesce(similarity, F.lit(1.0)) >= least), "dom_duplicate").when(on_page, "ocr_variant").when(x["image"].isNotNull(), "image_text").otherwise("unlocated_text")
        return F.struct(x["place"].alias("place"), x["text"].alias("text"), kind.alias("kind"), F.when(on_page, x["dom_text"]).alias("dom_text"), similarity.alias("similarity"), F.when(~on_page, x["image"]).alias("image"))

    usable = F.coalesce((dpr > 0) & ~F.isnan(dpr), F.lit(False))
    rows = captures.withColumn("_found", F.when(usable, found)).withColumn("_ratios", place_ratios(keys("text"), keys("dom_text")))
    return rows.withColumn(name, F.when(usable & (F.size("_found") > 0), F.zip_with("_found", "_ratios", judge))).drop("_found", "_ratios")


def dom_redundancy(aligned: Column) -> Column:
    """Share of the readings that the page's own text already has."""
    return F.when(F.size(aligned) > 0, F.size(F.filter(aligned, lambda x: x["kind"].isin("dom_duplicate", "ocr_variant"))) / F.size(aligned))


def picture_segments(aligned: Column) -> Column:
    """Text that only a screenshot shows: one segment for each image, in their order, then each reading outside of any."""
    inside = F.filter(aligned, lambda x: x["kind"] == "image_text")
    owners = F.array_sort(F.array_distinct(F.transform(inside, lambda x: x["image"])))
    images = F.transform(owners, lambda o: F.array_join(F.transform(F.filter(inside, lambda x: x["image"] == o), lambda x: x["text"]), "\n"))
    loose = F.transform(F.filter(aligned, lambda x: x["kind"] == "unlocated_text"), lambda x: x["text"])
    return F.filter(F.concat(images, loose), lambda s: F.trim(s) != "")


def picture_gate(segments: Column, least: int = 20) -> Column:
    """struct(text, status): what of a screenshot alone is scored, after interface lines are gone; too little of it is not."""
    kept = F.transform(F.filter(line_reasons(F.flatten(F.transform(segments, lambda s: F.split(s, r"\r?\n")))), lambda x: x["reason"].isNull()), lambda x: x["line"])
    text = F.array_join(kept, "\n")
    return F.struct(text.alias("text"), F.when(alnum_count(text) < least, "SKIPPED_NO_IMAGE_ONLY_TEXT").otherwise("TO_SCORE").alias("status"))


def spatial_coverage(boxes: Column, readings: Column, dpr: Column, pad: float = 2.0) -> Column:
    """array<struct(place, text, kind)>: whether the middle of each accepted reading lies on a character of the page (matched, unmatched, unlocated)."""
    mean = lambda r, i: F.aggregate(r["bbox"], F.lit(0.0), lambda a, p: a + p[i]) / F.size(r["bbox"]) / dpr
    kind = lambda r: F.when(F.size(r["bbox"]) < 4, "unlocated").when(F.exists(boxes, lambda b: center_in(b, mean(r, 0), mean(r, 1), pad)), "matched").otherwise("unmatched")
    all_ = F.transform(readings, lambda r, i: F.struct(i.alias("place"), r["text"].alias("text"), r["accepted"].alias("accepted"), kind(r).alias("kind")))
    out = F.transform(F.filter(all_, lambda r: F.coalesce(r["accepted"], F.lit(False))), lambda r: F.struct(r["place"].alias("place"), r["text"].alias("text"), r["kind"].alias("kind")))
    return F.when((dpr > 0) & (F.size(boxes) > 0) & (F.size(readings) > 0), out)


def segment_regions(segments: Column, items: Column, width: Column, height: Column) -> Column:
    """array<struct(text, delta, left, top, width, height)> in percent: the items that show a segment as one of their lines.

    segments are array<struct(text, delta)>, items array<struct(text, boxes)>.
    """
    def region(s, item):
        edge = lambda i, pick: pick(F.transform(item["boxes"], lambda b: b[i]))
        left, top, right, bottom = edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)
        return F.struct(F.substring(s["text"], 1, 120).alias("text"), s["delta"].alias("delta"), (100 * left / width).alias("left"), (100 * top / height).alias("top"), (100 * (right - left) / width).alias("width"), (100 * (bottom - top) / height).alias("height"))

    shown = lambda s: F.filter(items, lambda x: (F.size(x["boxes"]) > 0) & F.array_contains(F.split(x["text"], r"\r?\n"), s["text"]))
    out = F.flatten(F.transform(F.filter(segments, lambda s: s["delta"].isNotNull()), lambda s: F.transform(shown(s), lambda x: region(s, x))))
    return F.when((width > 0) & (height > 0), F.filter(out, lambda r: (r["width"] > 0) & (r["height"] > 0))).otherwise(F.filter(out, lambda r: F.lit(False)))


def stable_viewport(before: Column, after: Column) -> Column:
    """Whether a page was the same before and after its screenshot, and captured in full."""
    same = before["text"].eqNullSafe(after["text"]) & before["viewport"].eqNullSafe(after["viewport"]) & before["items"].eqNullSafe(after["items"])
    cut = F.coalesce(before["truncated"], F.lit(False)) | F.coalesce(after["truncated"], F.lit(False))
    return same & ~cut
