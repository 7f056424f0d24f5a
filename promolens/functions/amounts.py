"""Money and percentage parsing, counts and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolens.functions.text import blank_to_null, wide
from promolens.vocabulary import FIVE_LEVEL_LOWEST, FIVE_LEVELS

# fixed values: the accepted shapes
STORED_AMOUNT = r"(\d+)(만|천)?원"
STORED_PCT = r"(\d+(?:\.\d+)?)%"
TEXT_AMOUNT = wide(r"(\d[\d,]{0,8})\s*(만|천)?\s*원")
TEXT_PCT = wide(r"(\d{1,3}(?:\.\d+)?)\s*(?:%|％|퍼센트)")


def _unit(text: Column) -> Column:
    return (
        F.when(text.contains("만"), F.lit(10000)).when(text.contains("천"), F.lit(1000)).otherwise(F.lit(1))
    ).cast("bigint")


def _won(matched: Column) -> Column:
    digits = F.regexp_replace(matched, r"[^\d]", "")
    return digits.try_cast("bigint") * _unit(matched)


def benefit_amount(c: Column) -> Column:
    """First amount in a stored benefit text, in won. Later amounts are ignored."""
    text = F.regexp_replace(c, "[, ]", "")
    return _won(blank_to_null(F.regexp_extract(text, STORED_AMOUNT, 0)))


def benefit_pct(c: Column) -> Column:
    text = F.regexp_replace(c, "[, ]", "")
    return blank_to_null(F.regexp_extract(text, STORED_PCT, 1)).cast("double")


def all_amounts(c: Column) -> Column:
    """All amounts of a text without inner blanks, ordered and distinct."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TEXT_AMOUNT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, wide(r"\s"), "")))


def all_percentages(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TEXT_PCT), F.lit(1))
    return F.array_distinct(F.transform(found, lambda v: F.concat(v, F.lit("%"))))


def max_amount(amounts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(amounts, _won)), F.lit(0).cast("bigint"))


def max_percentage(percentages: Column) -> Column:
    numbers = F.transform(percentages, lambda v: F.regexp_replace(v, "%", "").cast("double"))
    return F.coalesce(F.array_max(numbers), F.lit(0.0))


def rate(n: Column, d: Column) -> Column:
    """Half-even whole percentage; zero when there is nothing to divide by."""
    share = F.bround(F.lit(100.0) * n / F.nullif(d, F.lit(0)), 0).cast("bigint")
    return F.coalesce(share, F.lit(0).cast("bigint"))


def five_level(score: Column) -> Column:
    chain = None
    for floor, name in FIVE_LEVELS:
        chain = F.when(score >= floor, name) if chain is None else chain.when(score >= floor, name)
    return chain.otherwise(FIVE_LEVEL_LOWEST)


def heat_bucket(count: Column) -> Column:
    return F.when(count == 0, 0).when(count <= 2, 1).when(count <= 5, 2).otherwise(3)


def map_score(level: Column, scores: tuple[tuple[str, float], ...], default: float | None) -> Column:
    chain = None
    for name, value in scores:
        cond = level == name
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain.otherwise(F.lit(default).cast("double"))


def section_coverage(content: Column, sections) -> Column:
    """Share of the sections that hold anything, two decimals."""
    filled = F.lit(0)
    for name in sections:
        filled = filled + F.coalesce((F.size(F.try_element_at(content, F.lit(name))) > 0).cast("int"), F.lit(0))
    return F.bround(filled.cast("double") / F.lit(float(len(sections))), 2)
