"""List and detail pages to staged promotion records.

Pages come as rows ``page_id, url, html``. They are parsed once to element arrays
(``functions/dom.py``); what a page yields is an array that is exploded, so a page
is handled where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import dom, markup, periods, text, urls
from promolens.functions.rows import computed_once, posexploded
from promolens.vocabulary import (
    BLOCK_TITLE_WORDS, CATEGORY_RULES, CATEGORY_DEFAULT, DETAIL_HEADER_NOISE, DETAIL_JUNK_TITLES,
    DETAIL_TITLE_SUFFIXES, HIDDEN_TITLE_PREFIXES, LEGACY_CATEGORY_RULES, NO_INFO, NOT_FOUND_MARKER, SEE_DETAIL,
    LEGACY_THREAT_RULES, THREAT_DEFAULT, Vocabulary,
)

# fixed values: link shapes of the list pages
DETAIL_CALL = r"goDetail\('(\d+)'"
EVENT_HREF = r"(/pconts/html/benefit/event/|/evt/|MOBEVENTN|MOBFM829R02)"
LIST_AREAS = "#main_contents, .eventList"
CALL_TITLES = (".evtlist-desc .tit", ".evtlist-desc .title", ".tit", ".title", "strong")
LINK_BLOCKS = ("li", "div", "article", "section")
DETAIL_SCOPES = ("main", ".content", ".event-detail", "[class*='event']", "article")
CONTAINERS = (
    ".event-list li, .list-item, article.event, div.event-card, .event-box, .event-item, .card-item, li.item, div.item, li"
)
CONTAINER_TITLES = "h3, h4, .title, .event-title, strong, span.subject"
CONTAINER_PERIODS = ".period, .date, .event-date"
LIST_DATE_RANGE = (
    r"\d{4}\.\d{1,2}\.\d{1,2}\s*(?:\([^)]*\))?\s*(?:~|∼|～|-|–)\s*\d{1,4}\.\d{1,2}\.\d{1,2}\s*(?:\([^)]*\))?"
)


def _dom() -> Column:
    return F.col("dom")


def _constant(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value




def call_links(pages: DataFrame, company: str | Column, list_url: str, vocab: Vocabulary, areas: str = LIST_AREAS) -> DataFrame:
    """Links of the list areas that open a detail by script call: id, title by fallback, period from the link text."""
    tree = dom.parsed(pages.select("page_id", "html"), "script style")
    anchors = F.filter(
        dom.select(_dom(), ", ".join(f"{area.strip()} a" for area in areas.split(","))),
        lambda a: F.coalesce(F.regexp_extract(a["attrs"]["href"], DETAIL_CALL, 1), F.lit("")) != "",
    )

    def link(a: Column) -> Column:
        titled = dom.texts_of(_dom(), dom.firsts(_dom(), CALL_TITLES, a), " ")
        alt = dom.first(dom.select(_dom(), "img[alt]", a))["attrs"]["alt"]
        whole = dom.text_of(_dom(), a, " ")
        options = F.concat(titled, F.array(F.coalesce(alt, F.lit("")), F.regexp_replace(whole, LIST_DATE_RANGE, "")))
        title = dom.first(F.filter(F.transform(options, lambda t: text.clean_title(t, vocab)), lambda t: t != ""))
        return F.struct(
            F.regexp_extract(a["attrs"]["href"], DETAIL_CALL, 1).alias("event_no"), title.alias("title"), whole.alias("raw_text"))

    links = posexploded(tree, ["page_id"], F.transform(anchors, link), "link_no", "a")
    return links.select(
        "page_id", "link_no", _constant(company).alias("company"), F.lit(list_url).alias("base_url"),
        F.concat(F.lit(f"{list_url}?mainCC=a&eventNum="), F.col("a.event_no")).alias("url"),
        F.col("a.title").alias("title"), periods.weekday_period(F.col("a.raw_text")).alias("period"), F.col("a.raw_text").alias("raw_text"),
    ).where(F.col("title").isNotNull())


def block_links(pages: DataFrame, company: str | Column, list_url: str, vocab: Vocabulary) -> DataFrame:
    """Links by address pattern with the text of the nearest list item or section around them.

    A link without a usable title takes the first piece of its block that names an offer.
    """
    tree = dom.parsed(pages.select("page_id", "html"), "script style")
    anchors = F.filter(dom.select(_dom(), "a[href]"), lambda a: a["attrs"]["href"].rlike(EVENT_HREF))

    def link(a: Column) -> Column:
        around = text.let(dom.enclosing(_dom(), a, LINK_BLOCKS), lambda block: dom.text_of(_dom(), block, " "))
        return F.struct(a["attrs"]["href"].alias("href"), dom.text_of(_dom(), a, " ").alias("text"), around.alias("raw_text"))

    links = posexploded(tree, ["page_id"], F.transform(anchors, link), "link_no", "a").select("page_id", "link_no", "a.*")
    pieces = F.transform(F.split("raw_text", r"[|·•]+"), lambda p: text.clean_title(p, vocab))
    named = F.filter(pieces, lambda p: (F.length(p) >= 4) & text.contains_any(p, BLOCK_TITLE_WORDS))
    title = F.coalesce(text.blank_to_null(text.clean_title(F.col("text"), vocab)), dom.first(named))
    return links.select(
        "page_id", "link_no", _constant(company).alias("company"), F.lit(list_url).alias("base_url"),
        F.col("href").alias("url"), title.alias("title"), periods.block_period(F.col("raw_text")).alias("period"), "raw_text",
    ).where(F.col("title").isNotNull())


def detail_records(pages: DataFrame, company: str | Column) -> DataFrame:
    """Detail pages to records with the outcome of the probe.

    The title is the first usable heading of the first scope that has one, else the share title. ``outcome``: miss (no
    such promotion), short (no usable title), junk (app redirect page) or hit. Only hits are records.
    """
    def usable(t: Column) -> Column:
        return (
            (F.length(t) >= 4) & ~text.contains_any(t, DETAIL_HEADER_NOISE) & ~text.starts_with_any(t, HIDDEN_TITLE_PREFIXES)
        )

    tree = dom.parsed(pages, "script style")
    headings = F.flatten(F.transform(
        dom.firsts(_dom(), DETAIL_SCOPES), lambda scope: dom.texts_of(_dom(), dom.select(_dom(), "h1, h2, h3", scope))))
    og = text.ustrip(dom.meta(_dom(), "og:title"))
    for suffix in DETAIL_TITLE_SUFFIXES:
        og = F.when(og.endswith(suffix), text.ustrip(F.substr(og, F.lit(1), F.length(og) - len(suffix)))).otherwise(og)
    title = F.coalesce(dom.first(F.filter(headings, usable)), F.when(F.length(og) >= 4, og), F.lit(""))
    rows = computed_once(tree, {"_body": F.array_join(dom.blocks(_dom()), " "), "title": title})
    outcome = (
        F.when(F.col("html").contains(NOT_FOUND_MARKER), "miss")
        .when(F.length("title") < 3, "short")
        .when(text.contains_any(F.col("title"), DETAIL_JUNK_TITLES), "junk")
        .otherwise("hit")
    )
    return rows.select(
        "page_id", "url", _constant(company).alias("company"),
        "title", periods.detail_period(F.col("_body")).alias("period"),
        text.first_rule(F.col("title"), CATEGORY_RULES, CATEGORY_DEFAULT).alias("category"),
        F.col("_body").alias("raw_text"), outcome.alias("outcome"),
    )


def promotion_links(pages: DataFrame, vocab: Vocabulary, per_page: int | None = None) -> DataFrame:
    """Links that look like promotions, absolute, distinct in order; all of a page, or its first ``per_page``."""
    href = lambda a: a["href"]

    def target(a: Column, base: Column) -> Column:
        param = F.regexp_extract(a["onclick"], r"['\"]([^'\"]+)['\"]", 1)
        scripted = (href(a).startswith("javascript:") | href(a).startswith("#")) & F.lower(a["onclick"]).contains("event")
        return (
            F.when(href(a).startswith("/"), urls.absolutise(href(a), base))
            .when(href(a).startswith("http"), href(a))
            .when(scripted & (param != ""), F.concat(base, F.lit("?id="), param))
        )

    wanted = F.filter(
        markup.anchors(F.col("html")),
        lambda a: (href(a) != "")
        & (text.contains_any(href(a), vocab.link_href_words) | text.contains_any(a["text"], vocab.link_text_words)),
    )
    found = F.transform(wanted, lambda a: target(a, F.col("url")))
    kept = F.filter(
        found,
        lambda u: u.isNotNull() & (~F.lower(u).contains("list") | F.lower(u).contains("detail")),
    )
    firsts = F.array_distinct(kept)
    firsts = firsts if per_page is None else F.slice(firsts, 1, per_page)
    return posexploded(pages, ["page_id"], firsts, "position", "target")


def container_records(
    pages: DataFrame, company: str | Column, list_url: str, per_page: int | None = None,
    required_words: tuple[str, ...] = (), containers: str = CONTAINERS,
) -> DataFrame:
    """List containers of a generic list page to records, nested ones each for itself.

    Title from a heading, a title class or strong text (at least three characters, on one site also with a required
    word); address made absolute, or the list page itself where it is empty or a script; period text from a date or
    period class, else the no-information marker.
    """
    items = dom.select(_dom(), containers)
    items = items if per_page is None else F.slice(items, 1, per_page)

    def item(n: Column) -> Column:
        return F.struct(
            dom.text_of(_dom(), dom.first(dom.select(_dom(), CONTAINER_TITLES, n))).alias("title"),
            dom.first(dom.select(_dom(), "a", n))["attrs"]["href"].alias("href"),
            dom.text_of(_dom(), dom.first(dom.select(_dom(), CONTAINER_PERIODS, n))).alias("period"),
            dom.text_of(_dom(), n).alias("raw_text"),
        )

    tree = dom.parsed(pages.select("page_id", "html"), "script style")
    staged = posexploded(tree, ["page_id"], F.transform(items, item), "position", "n").select("page_id", "position", "n.*")
    if required_words:
        staged = staged.where(text.contains_any(F.col("title"), required_words))
    href = F.coalesce("href", F.lit(""))
    address = F.when((href == "") | href.rlike(urls.UNUSABLE), F.lit(list_url)).otherwise(urls.absolutise(href, F.lit(list_url)))
    return staged.where(F.length("title") >= 3).select(
        "page_id", "position", _constant(company).alias("company"), address.alias("url"), "title",
        F.coalesce(text.blank_to_null(F.col("period")), F.lit(NO_INFO)).alias("period"),
        text.first_rule(F.col("title"), LEGACY_CATEGORY_RULES, CATEGORY_DEFAULT).alias("category"),
        text.first_rule(F.col("title"), LEGACY_THREAT_RULES, THREAT_DEFAULT).alias("threat_level"),
        F.lit(SEE_DETAIL).alias("benefit_value"), F.lit(SEE_DETAIL).alias("conditions"), "raw_text",
    )
