"""Text predicates and cleaners. All of them are plain Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolens.vocabulary import Rules, Vocabulary

WS = r"(?U)\s+"
#: Any white space, as a class that leaves digits and letters of a pattern alone.
BLANK = "[\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# fixed values: every character that counts as white space at the edges of a text
EDGE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def wide(pattern: str) -> str:
    """``pattern`` with ``\\s`` for any white space instead of the ASCII kinds."""
    return pattern.replace(r"\s", BLANK)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ustrip(c: Column) -> Column:
    """Strip Unicode white space; plain ``trim`` knows the blank only."""
    return F.btrim(c, F.lit(EDGE_CHARS))


def column_strip(c: Column) -> Column:
    """``ustrip`` of a column or field, which is read several times: a text that starts and ends with neither white space
    nor a rare character is taken as it is, as comparing its ends costs far less than searching them among the kinds."""

    def filled(end: Column) -> Column:
        return ((end >= "!") & (end < "\x7f")) | (end >= "\u3001")

    return F.when(filled(c) & filled(F.right(c, F.lit(1))), c).otherwise(ustrip(c))


def collapse(c: Column) -> Column:
    """Whitespace runs to one blank, edges stripped; null stays null."""
    return F.trim(F.regexp_replace(c, WS, " "))


def clean_text(c: Column) -> Column:
    return F.coalesce(collapse(c.cast("string")), F.lit(""))


def clean_title(c: Column, vocab: Vocabulary) -> Column:
    text = clean_text(c)
    return F.when(text.isin(*vocab.title_noise), F.lit("")).otherwise(text)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def contains_any(c: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def starts_with_any(c: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | c.startswith(word)
    return hit


def hit_count(c: Column, words) -> Column:
    """How many different keywords occur in the text."""
    total = F.lit(0)
    for word in words:
        total = total + c.contains(word).cast("int")
    return total


def first_rule(c: Column, rules: Rules, default: str | None) -> Column:
    """Label of the first rule with any keyword in the text."""
    text = F.coalesce(c, F.lit(""))
    chain = None
    for label, words in rules:
        cond = contains_any(text, words)
        chain = F.when(cond, label) if chain is None else chain.when(cond, label)
    return chain.otherwise(F.lit(default))


def matching_rules(c: Column, rules: Rules) -> Column:
    """The distinct labels of all rules that hit, in rule order; ``c`` should be a column, as it is read for each word."""
    text = F.coalesce(c, F.lit(""))
    return without_nulls(F.array(*[F.when(contains_any(text, words), F.lit(label)) for label, words in rules]))


def without_nulls(labels: Column) -> Column:
    """Distinct labels that are not null. Unlike ``array_compact`` this is compiled, and so is what the array is made of."""
    return F.array_except(labels, F.array(F.lit(None).cast("string")))


def is_empty_value(c: Column, vocab: Vocabulary) -> Column:
    text = F.coalesce(column_strip(c), F.lit(""))
    return text.isin(*vocab.empty_markers) | contains_any(text, vocab.empty_substrings)


def is_meaningful(title: Column, period: Column, vocab: Vocabulary) -> Column:
    """A record worth listing: a real title and a filled period.

    Benefit and conditions cannot change the outcome once the period is filled.
    """
    name = F.coalesce(column_strip(title), F.lit(""))
    first, second = vocab.hidden_title_pair
    return (
        ~name.isin(*vocab.empty_markers)
        & ~starts_with_any(name, vocab.hidden_title_prefixes)
        & ~(name.contains(first) & name.contains(second))
        & ~is_empty_value(period, vocab)
    )


# fixed values: ASCII letters and digits one by one; Java looks listed characters up in one table, while a class of several
# ranges calls a chain of predicates per character (22 against 0.9 s over 0.17 GB of text)
ASCII_WORD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
NO_KEY = f"[^{ASCII_WORD}가-힣]+"


def comparison_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), NO_KEY, ""))


def _alternatives(words) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def is_header_like(c: Column, vocab: Vocabulary) -> Column:
    """Site names and menu labels, alone or at the edge of a text; also anything tiny."""
    words = _alternatives(vocab.header_words)
    return c.isNull() | (F.length(c) <= 5) | ustrip(c).rlike(rf"^(?:{words})(?: |$)| (?:{words})$")


def is_notification(c: Column, vocab: Vocabulary) -> Column:
    first, second = vocab.hidden_title_pair
    prefixes = _alternatives(vocab.notification_prefixes)
    return F.coalesce(
        (F.length(c) >= 10)
        & (ustrip(c).rlike(rf"^(?:{prefixes})") | (c.contains(first) & c.contains(second))),
        F.lit(False),
    )


def is_noise(text: Column, vocab: Vocabulary) -> Column:
    """Legal or privacy boilerplate, unless it speaks about the offer itself.

    ``text`` has its white space collapsed already.
    """
    rescued = contains_any(text, vocab.noise_rescue_words) & ~contains_any(
        text, vocab.noise_always_words
    )
    return (text == "") | (contains_any(text, vocab.noise_words) & ~rescued)


def benefit_type_of(c: Column, vocab: Vocabulary) -> Column:
    return first_rule(F.lower(c), vocab.benefit_type_rules, vocab.benefit_type_default)


def display_benefit(c: Column) -> Column:
    """Benefit text for a table cell; a dash stands for nothing to show."""
    bare = ustrip(F.regexp_replace(F.coalesce(c, F.lit("")), "상세 페이지 참조|정보 없음", ""))
    return F.coalesce(blank_to_null(bare), F.lit("—"))


def dedupe_key(url: Column, title: Column, period: Column) -> Column:
    by_title = F.concat(
        F.lit("title::"), F.lower(clean_text(title)), F.lit("::"), F.lower(clean_text(period))
    )
    return F.when(
        F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url::"), F.lower(url))
    ).otherwise(by_title)


def distinct_by_key(items: Column, key_of: Callable[[Column], Column]) -> Column:
    """First item per key, in order. Sort based, so long arrays stay n log n."""
    keyed = F.transform(
        items, lambda v, i: F.struct(key_of(v).alias("k"), i.alias("p"), v.alias("v"))
    )
    firsts = let(
        F.sort_array(keyed),
        lambda s: F.filter(
            s, lambda e, i: (e["k"] != "") & ((i == 0) | (e["k"] != s[F.greatest(i - 1, F.lit(0))]["k"]))
        ),
    )
    back = F.sort_array(
        F.transform(firsts, lambda e: F.struct(e["p"].alias("p"), e["v"].alias("v")))
    )
    return F.transform(back, lambda e: e["v"])


def company_rank(company: Column, order) -> Column:
    """Position in the preferred order; others share the place after the last."""
    pos = F.array_position(F.array(*[F.lit(c) for c in order]), company)
    return F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1).cast("bigint"))
