"""Date and period parsing.

Three dialects of date ranges exist side by side and accept different inputs on
purpose; each has its own pattern and none is reused for another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolens.functions.text import WS, blank_to_null, clean_text, wide
from promolens.vocabulary import NO_INFO

# fixed values: the accepted range shapes
STORED_RANGE = wide(
    r"(\d{2,4})[./-](\d{1,2})[./-](\d{1,2})\s*(?:~|～|-|–)\s*"
    r"(\d{2,4})[./-](\d{1,2})[./-](\d{1,2})"
)
LIST_RANGE = wide(
    r"(\d{2,4})[./-](\d{1,2})[./-](\d{1,2})\s*(?:~|∼|～|-|–)\s*"
    r"(\d{1,4})[./-](\d{1,2})[./-](\d{1,2})"
)
PAGE_RANGE_FULL = wide(
    r"(\d{2,4})[./-]\s*(\d{1,2})[./-]\s*(\d{1,2})\s*(?:\([^)]*\))?\s*(?:~|～|-|–|∼)\s*"
    r"(\d{2,4})[./-]\s*(\d{1,2})[./-]\s*(\d{1,2})"
)
PAGE_RANGE_SHORT_END = wide(
    r"(\d{2,4})[./-]\s*(\d{1,2})[./-]\s*(\d{1,2})\s*(?:\([^)]*\))?\s*(?:~|～|-|–|∼)\s*"
    r"(\d{1,2})[./-]\s*(\d{1,2})"
)
PAGE_RANGE_KOREAN = wide(
    r"(\d{2,4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일?\s*(?:~|～|-|–|∼|부터)\s*"
    r"(\d{2,4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일?"
)
BLOCK_RANGE = wide(
    r"(\d{2,4}[./-]\d{1,2}[./-]\d{1,2})\s*(?:~|∼|～|-|–)\s*(\d{2,4}[./-]\d{1,2}[./-]\d{1,2})"
)
WEEKDAY_RANGE = wide(
    r"(\d{4}\.\d{1,2}\.\d{1,2})(?:\([^)]*\))?\s*(?:~|∼|～|-|–)\s*"
    r"(\d{1,4}\.\d{1,2}\.\d{1,2})(?:\([^)]*\))?"
)
STRICT_RANGE = r"20\d{2}\.\d{2}\.\d{2}~20\d{2}\.\d{2}\.\d{2}"
STRICT_RANGE_OR_DASH = r"20\d{2}\.\d{2}\.\d{2}[~\-]20\d{2}\.\d{2}\.\d{2}"
TRAILING_DATE = wide(r"(\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2})\s*$")


def _rewrite(text: Column, pattern: str, template: str) -> Column:
    """First match of ``pattern`` written as ``template``; null when nothing matches.

    All parsers below are straight chains of such rewrites. A chain evaluates its
    input once, which keeps generated code small where several dates are derived.
    """
    return F.regexp_replace(blank_to_null(F.regexp_extract(text, pattern, 0)), pattern, template)


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, template in steps:
        c = F.regexp_replace(c, pattern, template)
    return c


# Years below 100 belong to this century, three-digit years get a leading zero.
START_CENTURY = (r"^0{0,2}(\d\d)([.-])", "20$1$2")
START_WIDTH = (r"^(\d{3})([.-])", "0$1$2")
END_CENTURY = (r"~0{0,2}(\d\d)\.(\d+\.\d+)$", "~20$1.$2")
END_CENTURY_ONE_DIGIT = (r"~0{0,3}(\d)\.(\d+\.\d+)$", "~200$1.$2")
END_WIDTH = (r"~(\d{3})\.(\d+\.\d+)$", "~0$1.$2")
END_BORROWS_YEAR = (r"^(\d+)(\..*~)0?[1-9]\d\d(\.\d+\.\d+)$", "$1$2$1$3")
PAD_PARTS = (r"(?<!\d)(\d)(?!\d)", "0$1")
# Page text adds 2000 only to years written with exactly two digits.
PAGE_START_CENTURY = (r"^(\d\d)\.", "20$1.")
PAGE_END_CENTURY = (r"~(\d\d)\.(\d+\.\d+)$", "~20$1.$2")


def _one_date(period: Column, template: str) -> Column:
    return _chain(_rewrite(period, STORED_RANGE, template), START_CENTURY, START_WIDTH).try_cast("date")


def period_dates(period: Column) -> Column:
    """Stored period text to ``struct<start, end>``; one bad side voids both."""
    start, end = _one_date(period, "$1-$2-$3"), _one_date(period, "$4-$5-$6")
    return F.struct(
        F.when(end.isNotNull(), start).alias("start"), F.when(start.isNotNull(), end).alias("end")
    )


def compact_date(c: Column) -> Column:
    """``yyyymmdd`` with any separators to ``yyyy.mm.dd``, else an empty string."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.coalesce(_rewrite(digits, r"^(\d{4})(\d{2})(\d{2})$", "$1.$2.$3"), F.lit(""))


def period_from_compact(start: Column, end: Column) -> Column:
    return F.concat_ws("~", blank_to_null(compact_date(start)), blank_to_null(compact_date(end)))


def canonical_period(c: Column) -> Column:
    """Free period text to the canonical range; unmatched text is kept as it is."""
    text = clean_text(c)
    ranged = _chain(
        _rewrite(text, LIST_RANGE, "$1.$2.$3~$4.$5.$6"),
        START_CENTURY, END_CENTURY_ONE_DIGIT, END_CENTURY, END_BORROWS_YEAR, START_WIDTH, END_WIDTH, PAD_PARTS,
    )
    return F.coalesce(ranged, text)


def block_period(text: Column) -> Column:
    """First plain date range inside a list block, canonical; empty when absent."""
    return canonical_period(_rewrite(text, BLOCK_RANGE, "$1~$2"))


def weekday_period(text: Column) -> Column:
    """Range with weekday brackets; an end without a year borrows the start year."""
    bare = _rewrite(text, WEEKDAY_RANGE, "$1~$2")
    return canonical_period(F.regexp_replace(bare, r"^(\d{4})(\..*)~(\d{1,3}\.)", "$1$2~$1.$3"))


def detail_period(text: Column) -> Column:
    """First stored-shape range in a detail page, written canonically."""
    ranged = _chain(
        _rewrite(text, STORED_RANGE, "$1.$2.$3~$4.$5.$6"),
        START_CENTURY, END_CENTURY, START_WIDTH, END_WIDTH, PAD_PARTS,
    )
    return F.coalesce(ranged, F.lit(""))


def page_date_range(c: Column) -> Column:
    """Date range in running text: full, then short end, then year/month/day words."""
    text = clean_text(c)
    found = F.coalesce(
        _rewrite(text, PAGE_RANGE_FULL, "$1.$2.$3~$4.$5.$6"),
        _rewrite(text, PAGE_RANGE_SHORT_END, "$1.$2.$3~$1.$4.$5"),
        _rewrite(text, PAGE_RANGE_KOREAN, "$1.$2.$3~$4.$5.$6"),
    )
    ranged = _chain(found, PAGE_START_CENTURY, PAGE_END_CENTURY, START_WIDTH, END_WIDTH, PAD_PARTS)
    return F.coalesce(ranged, F.lit(""))


def strict_period(text: Column, allow_dash: bool = False) -> Column:
    """Literal four-digit-year range, else the no-information marker."""
    found = F.regexp_extract(text, STRICT_RANGE_OR_DASH if allow_dash else STRICT_RANGE, 0)
    if allow_dash:
        found = F.replace(found, F.lit("-"), F.lit("~"))
    return F.coalesce(blank_to_null(found), F.lit(NO_INFO))


def status_at(end: Column, as_of) -> Column:
    return (
        F.when(end.isNull(), "unknown").when(end >= F.lit(as_of), "active").otherwise("ended")
    )


def duration_days(start: Column, end: Column) -> Column:
    """Inclusive length; zero when a side is missing or the range is reversed."""
    return F.coalesce(F.greatest(F.date_diff(end, start) + 1, F.lit(0)), F.lit(0)) * (
        start.isNotNull() & end.isNotNull()
    ).cast("int")


def week_label(d: Column) -> Column:
    """Monday-based week of the year; days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(d) + F.lit(6) - F.weekday(d)) / F.lit(7))
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def _loose_date(text: Column) -> Column:
    dashed = F.translate(F.regexp_replace(text, WS, ""), "./", "--")
    return F.when(dashed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), dashed.try_cast("date"))


def lenient_end_date(period_end: Column, period: Column) -> Column:
    """Stored end date, else the text after the tilde, else a trailing date."""
    after = F.get(F.split(period, "~"), F.lit(1))
    tail = F.when(period.contains("~"), after).otherwise(F.regexp_extract(period, TRAILING_DATE, 1))
    return F.coalesce(period_end, _loose_date(tail))


def days_left(end: Column, as_of) -> Column:
    return F.date_diff(end, F.lit(as_of))


def lenient_active(status: Column, period: Column, as_of) -> Column:
    """Stored status first; without one, open-ended or unknown periods count as active."""
    pieces = F.split(F.coalesce(period, F.lit("")), "~")
    end_text = F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))
    return (
        F.when(status == "active", True)
        .when(status == "ended", False)
        .when(end_text == "", True)
        .otherwise(F.coalesce(_loose_date(end_text) >= F.lit(as_of), F.lit(False)))
    )


def period_text_active(period: Column, as_of) -> Column:
    """Text-only activity test: anything that is not a dated range is active."""
    text = F.coalesce(period, F.lit(""))
    pieces = F.split(text, "~")
    return (
        F.when(text.isin("", NO_INFO, "Info Missing") | (F.size(pieces) < 2), True)
        .otherwise(F.coalesce(_loose_date(F.get(pieces, F.lit(1))) >= F.lit(as_of), F.lit(False)))
    )

