"""Text functions as Column expressions; Python only for Unicode compatibility forms, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that never count as terms of a query.
LATIN_STOP_TERMS = ["agent", "content", "current", "how", "knowledge", "method", "methods", "project", "projects", "should", "system", "the", "use", "what", "where", "why"]
CJK_STOP_TERMS = ["一下", "一个", "什么", "为什么", "使用", "内容", "可以", "哪个", "哪里", "如何", "应该", "当前", "判断", "推荐", "方法", "是否", "有关", "模型", "知识", "系统", "这个", "进行", "适合", "问题", "项目"]


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts pass unchanged."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalize_text(text: Column, compatible: bool = True) -> Column:
    """Lower case, anything but letters and numbers as one blank; with `compatible`, compatibility forms are folded first. Null is empty."""
    text = F.coalesce(nfkc(text) if compatible else text, F.lit(""))
    return F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def normalize_each(texts: Column, compatible: bool = True) -> Column:
    """normalize_text of every string of an array, null strings and a null array as empty ones; one pass over all of them joined."""
    listed = F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\u001f"), F.lit(" ")))
    if compatible:
        listed = F.when(F.size(listed) > 0, F.split(nfkc(F.array_join(listed, "\u001f")), "\u001f")).otherwise(listed)
    return F.transform(listed, lambda x: normalize_text(x, False))


def latin_terms(normal: Column) -> Column:
    """Distinct runs of Latin letters and numbers of at least two characters, without stop terms, of a normalised text."""
    runs = F.regexp_extract_all(normal, F.lit("([\\p{IsLatin}\\p{N}]+)"), 1)
    return F.array_except(F.array_distinct(F.filter(runs, lambda t: F.length(t) >= 2)), F.array(*map(F.lit, LATIN_STOP_TERMS)))


def _grams(run: Column, size: int) -> Column:
    count = F.length(run) - (size - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(run, i, size))).otherwise(F.array().cast("array<string>"))


def cjk_ngrams(normal: Column, size: int) -> Column:
    """Distinct n-grams of Han runs, without stop grams."""
    grams = F.flatten(F.transform(F.regexp_extract_all(normal, F.lit("(\\p{IsHan}+)"), 1), lambda r: _grams(r, size)))
    return F.array_except(F.array_distinct(grams), F.array(*map(F.lit, CJK_STOP_TERMS)))


def query_terms(text: Column, compatible: bool = True) -> Column:
    """MAP term -> weight: ASCII words (joined by . _ : -) 2, or 3 from five characters; pairs of CJK characters 1, fours 3, a lone character 0.5."""
    low = F.lower(F.coalesce(nfkc(text) if compatible else text, F.lit("")))
    words = F.transform(F.regexp_extract_all(low, F.lit("([a-z0-9]+(?:[._:-][a-z0-9]+)*)"), 1), lambda w: F.struct(w.alias("term"), F.when(F.length(w) >= 5, 3.0).otherwise(2.0).alias("weight")))
    runs = F.regexp_extract_all(low, F.lit("([\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]+)"), 1)
    lone = F.transform(F.filter(runs, lambda r: F.length(r) == 1), lambda r: F.struct(r.alias("term"), F.lit(0.5).alias("weight")))
    pairs = F.transform(F.flatten(F.transform(runs, lambda r: _grams(r, 2))), lambda g: F.struct(g.alias("term"), F.lit(1.0).alias("weight")))
    fours = F.transform(F.flatten(F.transform(runs, lambda r: _grams(r, 4))), lambda g: F.struct(g.alias("term"), F.lit(3.0).alias("weight")))
    return F.map_from_entries(F.array_distinct(F.concat(words, lone, pairs, fours)))


def count_occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of term in text; 0 for an empty term."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def excerpt(text: Column, terms: Column, limit: int = 1200, lead: int = 160) -> Column:
    """Blank-collapsed text from `lead` characters before the first occurrence of any term."""
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    low = F.lower(flat)
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, F.lower(t))), lambda p: p > 0))
    return F.substring(flat, F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - lead), F.lit(limit))


def lexical_tokens(text: Column, folded: bool = False) -> Column:
    """Distinct ASCII words, CJK characters and CJK pairs; texts are folded to compatibility forms first unless they already are."""
    low = F.coalesce(text if folded else casefold(text), F.lit(""))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1)
    runs = F.regexp_extract_all(low, F.lit("([\\u3400-\\u4dbf\\u4e00-\\u9fff]+)"), 1)
    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, lambda r: F.concat(_grams(r, 1), _grams(r, 2))))))


def distinctive(text: Column, compatible: bool = True) -> Column:
    """A normalised field of at least four characters that is no stop term."""
    compact = F.replace(normalize_text(text, compatible), F.lit(" "), F.lit(""))
    return (F.length(compact) >= 4) & ~compact.isin(LATIN_STOP_TERMS + CJK_STOP_TERMS)


def normalize_slug(raw: Column) -> Column:
    """Safe relative page path without .md; null for empty, absolute or escaping ones."""
    value = F.regexp_replace(F.btrim(raw), "\\.md$", "")
    value = F.regexp_replace(F.regexp_replace(value, "/{2,}", "/"), "(^|/)(\\./)+", "$1")
    bad = (value == "") | (value == ".") | value.contains("\\") | value.contains("\u0000") | value.startswith("/") | value.rlike("(^|/)\\.\\.(/|$)")
    return F.when(~bad, F.regexp_replace(value, "/$", ""))


def normalize_reference(raw: Column) -> Column:
    """Page path of a reference, without [[ ]], |label and #anchor."""
    value = F.btrim(raw)
    value = F.when(value.startswith("[[") & value.endswith("]]"), F.btrim(F.regexp_replace(value, "^\\[\\[|\\]\\]$", ""))).otherwise(value)
    return normalize_slug(F.regexp_replace(value, "[|#].*$", ""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def outside_fences(markdown: Column) -> Column:
    """Markdown without fenced code blocks."""
    return F.regexp_replace(F.coalesce(markdown, F.lit("")), "(?ms)^ {0,3}(`{3,}|~{3,})[^\\n]*\\n.*?(?:^ {0,3}\\1[`~]*[ \\t]*$|\\z)", "")


def wikilinks(markdown: Column) -> Column:
    """Targets of [[links]] outside fences."""
    return F.transform(F.regexp_extract_all(outside_fences(markdown), F.lit("\\[\\[([^\\]]+)\\]\\]"), 1), lambda x: F.btrim(F.regexp_replace(x, "[|#].*$", "")))


def plain_markdown(markdown: Column) -> Column:
    """Readable text of a Markdown line: links by label, no emphasis, code or heading marks, blanks collapsed."""
    x = F.regexp_replace(F.coalesce(markdown, F.lit("")), "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    x = F.regexp_replace(x, "\\[\\[(?:[^\\]|]*\\|)?([^\\]]*)\\]\\]", "$1")
    x = F.regexp_replace(x, "(?m)^\\s*(?:#{1,6}\\s+|>\\s?|[-*+]\\s+|\\d+\\.\\s+)", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, "[*_`]{1,3}", ""), "\\s+", " "))


def summary(body: Column, limit: int = 160) -> Column:
    """First quoted line, else the first paragraph that is no heading, of at most `limit` characters."""
    quote = F.regexp_extract(body, "(?m)^>\\s*(\\S.*)$", 1)
    plain = F.regexp_extract(body, "(?m)^(?!\\s*(?:#|---|```|$))(\\s*\\S.*)$", 1)
    return F.substring(plain_markdown(F.when(quote != "", quote).otherwise(plain)), 1, limit)


def subject_line(text: Column, limit: int = 60) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")), 1, limit)


@F.pandas_udf(T.StringType())
def _cut_bytes(values: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else v.encode()[: int(n)].decode(errors="ignore") for v, n in zip(values, limits)])


def truncate_bytes(text: Column, limit: int) -> Column:
    """Longest prefix of at most `limit` UTF-8 bytes."""
    return _cut_bytes(text, F.lit(limit))


def intersects(a: Column, b: Column) -> Column:
    """Whether two lists share a value, blanks and letter case aside."""
    plain = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.btrim(x)))
    return F.coalesce(F.arrays_overlap(plain(a), plain(b)), F.lit(False))


def markdown_label(c: Column) -> Column:
    """Text that stands as it is inside the brackets of a link."""
    for x in ("\\", "[", "]"):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def navigation_metadata(maturity: Column, modules: Column, domain: Column, priority: Column, updated: Column) -> Column:
    """A page's metadata in one line of code spans; what is null or empty is left out."""
    listed = F.array_join(F.filter(modules, lambda m: m != ""), ",")
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"`{n}:"), v, F.lit("`"))) for n, v in (("maturity", maturity), ("modules", listed), ("domain", domain), ("priority", priority), ("updated", updated))]
    return F.concat_ws(" · ", *parts)
