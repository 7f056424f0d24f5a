"""URL normalisation without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolens.functions.text import blank_to_null, clean_text, column_strip, let
from promolens.vocabulary import Vocabulary

# RFC 3986, appendix B: scheme, authority, path, query, fragment
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
UNUSABLE = r"^(?i)(javascript|mailto|tel):"
# what a query part may hold that is written in another way when encoded
CODED = r"[^A-Za-z0-9._-]"


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", acc)
            .when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(seg)))
        )

    segments = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    slash = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), slash)
    dotted = path.contains(".") & path.rlike(r"(^|/)\.{1,2}(/|$)")
    return F.when(dotted, folded).otherwise(path)


def _up_to(c: Column, sign: str) -> Column:
    """``c`` before the first ``sign``; looking whether there is one costs far less than looking for its place."""
    return F.when(c.contains(sign), F.substring_index(c, sign, 1)).otherwise(c)


def _is_web(c: Column) -> Column:
    return c.startswith("https://") | c.startswith("http://")


def absolutise(href: Column, base: Column) -> Column:
    """Resolve a reference against its page address."""

    def part(url: Column, group: int) -> Column:
        return F.regexp_extract(url, SPLIT, group)

    scheme, host = part(base, 1), part(base, 2)
    root = F.concat(scheme, F.lit("://"), host)
    base_path = F.coalesce(blank_to_null(part(base, 3)), F.lit("/"))
    # without scheme and host, the path of a reference goes up to its first "?" or "#"
    ref_path = _up_to(_up_to(href, "#"), "?")
    tail = F.substr(href, F.length(ref_path) + F.lit(1))
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    without_fragment = F.regexp_replace(base, "#.*$", "")
    without_query = F.regexp_replace(base, "[?#].*$", "")
    return (
        F.when(_is_web(href) | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, _fold_dots(ref_path), tail))
        .when(href.startswith("?"), F.concat(without_query, href))
        .when(href.startswith("#"), F.concat(without_fragment, href))
        .otherwise(F.concat(root, _fold_dots(F.concat(folder, ref_path)), tail))
    )


def _decode(c: Column) -> Column:
    return F.when(c.contains("%") | c.contains("+"), F.coalesce(F.try_url_decode(c), c)).otherwise(c)


def _encode(c: Column) -> Column:
    coded = F.url_encode(c)
    written = F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(c.rlike(CODED), written).otherwise(c)


def normalise_query(query: Column, vocab: Vocabulary) -> Column:
    """Drop tracking and blank search parameters, then sort by name and value."""
    parts = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(p.contains("="), F.regexp_extract(p, "^[^=]*=(.*)$", 1)).otherwise(F.lit(""))).alias("v"),
        ),
    )
    pairs = F.transform(parts, lambda p: F.struct(column_strip(p["k"]).alias("k"), column_strip(p["v"]).alias("v")))
    kept = F.filter(
        pairs,
        lambda p: (p["k"] != "")
        & ~F.lower(p["k"]).isin(*vocab.dropped_query_keys)
        & ~((p["k"] == vocab.dropped_when_blank) & (p["v"] == "")),
    )
    coded = F.transform(
        F.sort_array(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))
    )
    return F.array_join(coded, "&")


def normalise_url(href: Column, base: Column, vocab: Vocabulary) -> Column:
    """Absolute address without fragment and tracking parameters; empty when unusable."""

    def build(url: Column) -> Column:
        # the parts of an absolute address lie between its first ":", "?" and "#": no pattern is needed
        whole = _up_to(url, "#")
        bare = _up_to(whole, "?")
        scheme = F.substring_index(bare, ":", 1)
        query = F.when(F.length(whole) > F.length(bare) + 1, let(
            normalise_query(F.substr(whole, F.length(bare) + 2), vocab),
            lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)),
        )).otherwise(F.lit(""))
        rest = F.substr(bare, F.length(scheme) + 1)
        no_host = F.substring(url, 9, 1).isin("", "/", "?", "#")
        usable = F.when(url.startswith("https://"), ~no_host).otherwise(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"))
        return F.when(usable, F.concat(F.lower(scheme), rest, query)).otherwise(F.lit(""))

    def resolve(raw: Column) -> Column:
        bad = (raw == "") | (~_is_web(raw) & raw.rlike(UNUSABLE))
        return F.when(bad, F.lit("")).otherwise(let(absolutise(raw, base), build))

    return F.coalesce(let(clean_text(href), resolve), F.lit(""))


def site_domain(url: Column, vocab: Vocabulary) -> Column:
    """First configured domain inside the address, else empty."""
    text = F.lower(F.coalesce(url, F.lit("")))
    chain = None
    for domain in vocab.site_domains:
        cond = text.contains(domain)
        chain = F.when(cond, domain) if chain is None else chain.when(cond, domain)
    return chain.otherwise("")


def id_in_url(url: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(url, pattern, 1)).try_cast("bigint")
