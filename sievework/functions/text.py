"""Text normalisation and scalar text functions as column expressions; NFKC alone needs Python (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which edit distances do not reproduce."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def ratio_table(xs: Column, ys: Column, gap: int | None = None) -> Column:
    """array<double>: Ratcliff-Obershelp similarity of each x with each y, all of the first x first.

    With gap, strings whose lengths differ by more are not compared and have 0. What repeats in a worker is computed once.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def table(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher
        from functools import lru_cache

        ratio = lru_cache(100_000)(lambda x, y: SequenceMatcher(None, x, y).ratio() if gap is None or abs(len(x) - len(y)) <= gap else 0.0)
        return pd.Series([None if x is None or y is None else [ratio(p, q) for p in x for q in y] for x, y in zip(a, b)], dtype=object)

    return table(xs, ys)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def place_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """As ratio_table for the strings at the same places of two arrays."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else [SequenceMatcher(None, *p).ratio() for p in zip(x, y)] for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def anchored_ratios(keys: pd.Series, base: pd.Series) -> pd.Series:
    """For each key its similarity with the stretch of base, as long as the key, that lines up with their longest common run."""
    from difflib import SequenceMatcher

    def stretch(key, text):
        run = SequenceMatcher(None, key, text, autojunk=False).find_longest_match()
        begin = max(0, run.b - run.a)
        return SequenceMatcher(None, key, text[begin : begin + len(key)], autojunk=False).ratio() if run.size else 0.0

    return pd.Series([None if ks is None else [stretch(k, t or "") for k in ks] for ks, t in zip(keys, base)], dtype=object)


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All named and numbered character references of HTML decoded."""
    import html

    return s.map(lambda x: None if x is None else html.unescape(x) if "&" in x else x)


def word_key(c: Column) -> Column:
    """Lower-cased letters, digits and underscores of an NFKC text."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def quote_key(c: Column) -> Column:
    """As word_key without underscores; quotes are looked up in texts by it."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def line_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s·•|:：!！?？.。,，、\-_/]+", "")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def visible_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of word characters; null if either is empty."""
    x, y = (F.array_distinct(F.filter(F.split(word_key(c), ""), lambda v: v != "")) for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def shingles(c: Column, n: int = 4, least: int = 20) -> Column:
    """Distinct character n-grams of a normalised text that is long enough, else an empty array."""
    starts = F.sequence(F.lit(0), F.length(c) - n)
    grams = F.transform(F.array(F.split(c, "")), lambda cs: F.transform(starts, lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)])))
    return F.when(F.length(c) >= least, F.array_distinct(F.flatten(grams))).otherwise(F.array().cast("array<string>"))


def fold_confusables(c: Column) -> Column:
    return F.translate(c, "013457", "oieast")


def squash_confusables(c: Column) -> Column:
    """Letters and digits that screen readers mix up fold to one digit."""
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "tlioszbg", "71105289")


def title_of(c: Column, least: int = 6) -> Column:
    """First line without a reply mark and a short tag; null if what is left is short."""
    t = F.trim(F.regexp_replace(F.element_at(F.split(c, "\n"), 1), r"^(?:Re:\s*)?(?:\[[^\]]{1,6}\]\s*)?", ""))
    return F.when(F.length(word_key(t)) >= least, t)


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def html_to_text(c: Column) -> Column:
    """Tags to spaces, character references decoded, spaces trimmed."""
    return F.trim(F.regexp_replace(unescape(without_tags(c)), "[\\s\u00a0]+", " "))


def magnitude_number(c: Column) -> Column:
    """'12.3k' -> 12300; the unit may be k, m or the signs for thousand and ten thousand."""
    number = F.regexp_replace(F.regexp_extract(c, r"(\d[\d,.]*)\s*([kKmM萬千]?)", 1), ",", "")
    unit = F.regexp_extract(c, r"(\d[\d,.]*)\s*([kKmM萬千]?)", 2)
    scale = F.when(unit.isin("k", "K", "千"), 1e3).when(unit.isin("m", "M"), 1e6).when(unit == "萬", 1e4).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * scale)


def windows_of(c: Column, size: int, overlap: int) -> Column:
    """Token windows of a long array: each of size, sharing overlap with the one before."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(c) - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(c, i * step + 1, F.lit(size)))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def verified_quotes(quotes: Column, text: Column, least: int = 2) -> Column:
    """Quotes that stand in the text letter by letter, punctuation and case aside."""
    return F.filter(quotes, lambda q: (F.length(quote_key(q)) >= least) & F.contains(quote_key(text), quote_key(q)))


# Who speaks at the start of a line; marks that go where a line end, a return and a tab follow, as in the text model's training.
ROLES = ["骗子", "詐騙者", "欺诈者", "欺詐者", "騙人", "发言人", "發言人", "受害者", "被害者", "用户", "用戶", "客户", "客戶", "客服", "对方", "對方的", "陌生人", "朋友", "商家", "买家", "買家", "老师", "老師", "导师", "導師", "工作人员", "工作人員", "员工", "員工", "旁白"]
PUNCTUATION = r"""[，。！？；：、“”‘’「」『』()（）\[\] {}《》〈〉\-+=~@#$%\^\&*\\/<>\n]\n\r\t"""
# Counts that a profile shows, with the words next to the number.
PROFILE_WORDS = {"followers": "(?:followers|粉絲|位粉絲|追蹤者)", "following": "(?:following|追蹤中)", "posts": "(?:posts|threads|篇貼文|則貼文|貼文)"}
NUMBER = r"(\d[\d,.]*)\s*([kKmM萬千]?)"
HAN = "[\u4e00-\u9fff]"


def clean_text(c: Column, s2t: tuple[str, str] = ("", "")) -> Column:
    """A text as the text model takes it; s2t holds simplified characters and, place by place, their traditional ones."""
    spoken = F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), rf"(?im)^\s*(?:{'|'.join(ROLES)})\s*\d*\s*[:：]\s*", "")
    plain = F.regexp_replace(F.translate(spoken, *s2t) if s2t[0] else spoken, PUNCTUATION, " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def profile_counts(c: Column) -> Column:
    """struct(followers, following, posts) as a profile prints them, a number before its word or after it; null where not shown."""
    def count(words):
        before, after = rf"(?iU){NUMBER}\s*{words}", rf"(?iU){words}\s*[:：]?\s*{NUMBER}"
        found = F.when(F.rlike(c, F.lit(before)), F.struct(*[F.regexp_extract(c, before, i) for i in (1, 2)])).when(F.rlike(c, F.lit(after)), F.struct(*[F.regexp_extract(c, after, i) for i in (1, 2)]))
        return magnitude_number(F.concat(found["col1"], found["col2"]))

    return F.struct(*[count(w).alias(n) for n, w in PROFILE_WORDS.items()])


def changed_share(c: Column, simplified: str) -> Column:
    """Share of the Chinese characters of a text that are simplified ones; null under 20 of them."""
    han = F.regexp_replace(c, "[^\u4e00-\u9fff]", "")
    return F.when(F.length(han) >= 20, (F.length(han) - F.length(F.translate(han, simplified, ""))) / F.length(han))


def image_only_lines(lines: Column, text: Column, least: float = 0.7) -> Column:
    """Lines read from a picture that the case's text does not have, nor anything close to them."""
    base = word_key(nfkc(F.coalesce(text, F.lit(""))))
    keyed = F.zip_with(lines, F.split(word_sequence(lines), "\n"), lambda x, k: F.struct(x.alias("line"), k.alias("key")))
    known = F.zip_with(keyed, F.array_repeat(base, F.size(lines)), lambda x, b: F.struct(x["line"].alias("line"), x["key"].alias("key"), b.alias("base")))
    new = F.filter(known, lambda x: (x["key"] != "") & ~F.contains(x["base"], x["key"]))
    ratios = anchored_ratios(F.transform(new, lambda x: x["key"]), base)
    near = F.zip_with(new, ratios, lambda x, r: F.struct(x["line"].alias("line"), ((F.length(x["key"]) >= 4) & (x["base"] != "") & (r >= least)).alias("near")))
    return F.transform(F.filter(near, lambda x: ~x["near"]), lambda x: x["line"])


def word_sequence(lines: Column) -> Column:
    """The keys of an array of lines, joined by line ends: one call of the Unicode function for all of them."""
    joined = nfkc(F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "\n", " ")), "\n"))
    return F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}_\n]+", "")


def forum_text(page: Column, chars: int = 800) -> Column:
    """Title and body of a forum page: up to the sender's line, without head lines, quotes, signatures and blank lines; null without a body."""
    body = F.regexp_extract(page, r'(?s)<div id="main-content"[^>]*>(.*?)<span class="f2">※ 發信站', 1)
    title = F.regexp_extract(page, '<span class="article-meta-tag">標題</span><span class="article-meta-value">(.*?)</span>', 1)
    plain = unescape(F.regexp_replace(F.regexp_replace(body, r'(?s)<div class="article-metaline.*?</div>', ""), "<[^>]+>", ""))
    lines = F.filter(F.split(plain, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.rlike(x, F.lit("^(?:※|--|: )")))
    return F.when(body != "", F.concat_ws("\n", unescape(title), F.substring(F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""), 1, chars)))
