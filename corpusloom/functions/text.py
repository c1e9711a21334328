"""Column functions over texts, ids and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.labels import strip


def record_id(ut: Column) -> Column:
    """`WOS:` and 15 digits as a whole number; null otherwise."""
    return F.when(ut.rlike(r"^WOS:\d{15}$"), F.substring(ut, 5, 15).cast("bigint"))


def record_key(number: Column) -> Column:
    """The way back; null beyond what a double can hold exactly."""
    return F.when((number >= 0) & (number <= 2**53 - 1), F.concat(F.lit("WOS:"), F.lpad(number.cast("string"), 15, "0")))


def mentions(pattern: str, *parts: Column) -> Column:
    """Whether a pattern occurs in the parts, whatever the case; null if they hold no text."""
    text = F.concat_ws(" ", *parts)
    return F.when(F.length(F.trim(text)) > 0, text.rlike(f"(?i){pattern}"))


def embedding_text(prefix: str, title: Column, abstract: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(strip(title), F.lit("")), F.lit(". "), F.coalesce(strip(abstract), F.lit("")))


def article_text(*parts: Column) -> Column:
    """Non-empty parts with a blank line between them."""
    return F.concat_ws("\n\n", *[F.nullif(strip(p), F.lit("")) for p in parts])


def split_trimmed(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), strip), lambda y: y != F.lit(""))


def plain_name(x: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, the common entities replaced."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def bucket_by_keywords(text: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str = "other") -> Column:
    """The first rule with a keyword in the text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(other)
    for name, keys in reversed(rules):
        any_of = F.lit(False)
        for k in keys:
            any_of = any_of | F.contains(low, F.lit(k))
        out = F.when(any_of, name).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def empty_json_list(x: Column) -> Column:
    return F.coalesce(F.json_array_length(x) == 0, F.lit(True))


def attention_scale(x: Column) -> Column:
    return F.log1p(x)


def power_bin(x: Column) -> Column:
    """The lower end of the power-of-ten bin of a positive number; null for others."""
    digits = F.floor(F.log10(x.cast("double")) + F.lit(1e-12))
    return F.when(x > 0, F.round(F.pow(F.lit(10.0), digits)).cast("long"))
