"""HTML helpers as Column expressions.

They cover the well-formed part of HTML that list and detail pages use: blocks
are bounded by block-level tags, inline tags vanish, entities are decoded.
Everything stays in the JVM, one row at a time, with no text cut off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolens.functions.text import blank_to_null, collapse

# fixed values: named entities that occur in page text
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)
BLOCK_TAGS = (
    "div|section|article|main|header|footer|nav|aside|p|ul|ol|li|table|thead|tbody|tr|td|th|"
    "h[1-6]|dl|dt|dd|br|body|html|head|title|form"
)
BLOCK_EDGE = rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>"
ANY_TAG = r"(?s)<[^>]*>"


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def drop_elements(html: Column, tags: tuple[str, ...]) -> Column:
    """Remove whole elements and comments."""
    names = "|".join(tags)
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, rf"(?is)<({names})\b[^>]*>.*?</\1>", "")


def inline_text(fragment: Column, joiner: str = "") -> Column:
    """Text of a fragment; tags become ``joiner``."""
    return collapse(unescape(F.regexp_replace(fragment, ANY_TAG, joiner)))


def text_blocks(html: Column) -> Column:
    """Texts between block-level tags, in page order, blank ones dropped."""
    pieces = F.transform(F.split(html, BLOCK_EDGE), lambda p: inline_text(p))
    return F.filter(pieces, lambda p: p != "")


def visible_text(html: Column) -> Column:
    return F.array_join(text_blocks(html), "\n")


def first_element(html: Column, tags: tuple[str, ...]) -> Column:
    """Inner HTML of the first element with one of the tags, tags in priority order."""
    found = [
        blank_to_null(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)) for tag in tags
    ]
    return F.coalesce(*found)


def element_texts(html: Column, tag_pattern: str) -> Column:
    """Texts of all elements whose tag matches, e.g. ``h[1-3]``."""
    inner = F.regexp_extract_all(
        html, F.lit(rf"(?is)<(?:{tag_pattern})\b[^>]*>(.*?)</(?:{tag_pattern})>"), F.lit(1)
    )
    return F.transform(inner, lambda v: inline_text(v))


def class_text(html: Column, class_pattern: str) -> Column:
    """Text of the first element that carries a matching class; null when absent."""
    inner = F.regexp_extract(
        html,
        rf"(?is)<([a-z][a-z0-9]*)\b[^>]*\bclass=\"[^\"]*(?:{class_pattern})[^\"]*\"[^>]*>(.*?)</\1>",
        2,
    )
    return blank_to_null(inline_text(inner))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag, in double, single or no quotes; empty when absent."""
    value = F.regexp_extract(tag, rf"(?is)(?<=[\s\"'])(?:{name})\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return unescape(F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2"))


def meta_content(html: Column, key: str) -> Column:
    """Content of the first meta tag whose name or property is ``key``, whatever the order of its attributes."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: F.lower(attribute(t, "name|property")) == key)
    return blank_to_null(F.get(F.transform(named, lambda t: attribute(t, "content")), F.lit(0)))


def anchors(html: Column) -> Column:
    """All links as ``array<struct<href, onclick, inner, text>>`` in page order."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))

    def parse(a: Column) -> Column:
        opening = F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0)
        inner = F.regexp_replace(F.regexp_replace(a, r"(?is)^<a\b[^>]*>", ""), r"(?is)</a>$", "")
        return F.struct(
            attribute(opening, "href").alias("href"),
            attribute(opening, "onclick").alias("onclick"),
            inner.alias("inner"),
            inline_text(inner, " ").alias("text"),
        )

    return F.transform(whole, parse)
