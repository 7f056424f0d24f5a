"""Text structuring: page text to candidate lines, sections and fields.

A document is worked on inside its own row with array functions. Nothing is
exploded and regrouped, so there is no shuffle and no skew, and the cost of a
row follows the length of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import amounts, dom, periods, text
from promolens.functions.rows import computed_once
from promolens.functions.text import let
from promolens.vocabulary import Vocabulary

NO_TEXTS = "array<string>"
MIN_LINE, MENU_LINE = 6, 35
#: Lines at the top of a page that are searched for its period first.
TOP_LINES = 40


def _none() -> Column:
    return F.array().cast(NO_TEXTS)


def _usable(c: Column, vocab: Vocabulary) -> Column:
    return ~text.is_header_like(c, vocab) & ~text.is_notification(c, vocab) & ~text.is_noise(c, vocab)


def candidate_lines(raw: Column, vocab: Vocabulary) -> Column:
    """Lines, their sentences and their bulleted parts; useful and distinct, in order."""

    def pieces(line: Column, pattern: str) -> Column:
        parts = F.transform(F.split(line, pattern), text.clean_text)
        return F.filter(parts, lambda p: (p != "") & (p != line))

    def expand(line: Column) -> Column:
        cuts = [pieces(line, r"(?<=[.!?])\s+")]
        cuts += [
            F.when(line.contains(m), pieces(line, r"\Q" + m + r"\E")).otherwise(_none())
            for m in vocab.line_markers
        ]
        return F.concat(F.array(line), *cuts)

    lines = F.filter(
        F.transform(F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit("\r"), F.lit("\n")), "\n"), text.clean_text),
        lambda v: v != "",
    )

    def keep(c: Column) -> Column:
        menu = text.contains_any(c, vocab.menu_words) & (F.length(c) <= MENU_LINE)
        return (F.length(c) >= MIN_LINE) & ~menu & _usable(c, vocab)

    chunks = F.filter(F.flatten(F.transform(lines, expand)), keep)
    return text.distinct_by_key(chunks, text.comparison_key)


def merged_lines(lines: Column, full_lines: Column, few: int | None = None) -> Column:
    """Lines of the raw text, then those of the full page text; with ``few`` only when the former are fewer."""
    both = F.concat(lines, full_lines)
    both = both if few is None else F.when(F.size(lines) < few, both).otherwise(lines)
    return text.distinct_by_key(both, text.comparison_key)


# fixed values: where the body of a page is, and which of its elements may be a block of text
AREAS = "main, article, .content, .event-detail, [class*='event'], [class*='detail'], [class*='campaign']"
AREA_ELEMENTS = "div, section, p, li, td, span, h2, h3, h4, dl, dd"
#: A container with more text than this is no block; what it contains is looked at by itself and by lines.
BLOCK_CHARS, SECTION_BLOCK_CHARS = 320, 500


def container_texts(tree: Column) -> Column:
    """Texts of all elements of the body areas (of the page, if it has none), nested ones too."""

    def below(area: Column) -> Column:
        return dom.texts_of(tree, dom.select(tree, AREA_ELEMENTS, area), " ")

    areas = dom.select(tree, AREAS)
    return let(areas, lambda found: F.when(
        F.size(found) > 0, F.flatten(F.transform(found, below))).otherwise(dom.texts_of(tree, dom.select(tree, AREA_ELEMENTS), " ")))


def up_to(texts: Column, chars: int) -> Column:
    return F.filter(texts, lambda t: F.length(t) <= chars)


def keyword_blocks(sources: list[Column], keywords, vocab: Vocabulary) -> Column:
    """Texts with any keyword from several sources in priority order, distinct."""

    def keep(c: Column) -> Column:
        return (F.length(c) >= MIN_LINE) & text.contains_any(c, keywords) & _usable(c, vocab)

    kept = F.filter(F.concat(*sources), keep)
    return text.distinct_by_key(kept, text.comparison_key)


def benefit_blocks(sources: list[Column], vocab: Vocabulary) -> Column:
    words = dict(vocab.section_rules)[vocab.benefit_section]
    return F.array_join(keyword_blocks(sources, words, vocab), " | ")


def condition_blocks(sources: list[Column], vocab: Vocabulary) -> Column:
    rules = dict(vocab.section_rules)
    words = list(dict.fromkeys(w for s in vocab.condition_sections for w in rules[s]))
    return F.array_join(keyword_blocks(sources, words, vocab), " | ")


def target_text(
    tree: Column, lines: Column, vocab: Vocabulary, element_max: int | None = None, line_max: int | None = None,
) -> Column:
    """Text of the element with a label (at least six characters), else a labelled line; at most as long as given."""
    options = [
        let(
            dom.labelled(tree, label),
            lambda t: F.when((F.length(t) >= MIN_LINE) & (F.lit(True) if element_max is None else F.length(t) <= element_max), t),
        )
        for label in vocab.target_element_labels
    ]
    found = F.filter(
        lines, lambda v: text.contains_any(v, vocab.target_labels) & (F.lit(True) if line_max is None else F.length(v) <= line_max)
    )
    return F.coalesce(*options, dom.first(found), F.lit(""))


# fixed values: where a title may stand
TITLE_CLASSES = (".event-title", ".title", ".tit", ".campaign-title", "[class*='tit']", "[class*='title']")


def page_title(tree: Column, vocab: Vocabulary) -> Column:
    """Longest usable heading, title-class text or og:title; one with an offer word first.

    All headings are candidates, so the scopes they stand in do not matter.
    """
    og = text.ustrip(dom.meta(tree, "og:title"))
    stripped = None
    for suffix in vocab.title_brand_suffixes:
        cond = og.endswith(suffix)
        bare = text.ustrip(F.left(og, F.length(og) - F.lit(len(suffix))))
        stripped = F.when(cond, bare) if stripped is None else stripped.when(cond, bare)
    og = stripped.otherwise(og) if stripped is not None else og
    found = F.concat(
        dom.texts_of(tree, dom.select(tree, "h1, h2, h3")), dom.texts_of(tree, dom.firsts(tree, TITLE_CLASSES)), F.array(og))
    usable = F.filter(
        found,
        lambda t: t.isNotNull() & (F.length(t) >= 4) & ~text.is_header_like(t, vocab) & ~text.is_notification(t, vocab),
    )
    ranked = F.sort_array(F.transform(usable, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))

    def choose(r: Column) -> Column:
        offer = F.filter(r, lambda e: text.contains_any(e["t"], vocab.title_preferred_words))
        return F.coalesce(F.get(offer, F.lit(0))["t"], F.get(r, F.lit(0))["t"], F.lit(""))

    return let(ranked, choose)


def page_period(
    body: Column, tree: Column, lines: Column, vocab: Vocabulary, top_lines: int = TOP_LINES,
    element_max: int | None = None, line_max: int | None = None,
) -> Column:
    """Date range from the first lines, labelled lines, the body, a labelled element or line.

    Without a range, the labelled element's text or the labelled line itself, whole and at most as long as given.
    """

    def first_range(texts: Column) -> Column:
        ranges = F.filter(F.transform(texts, periods.page_date_range), lambda r: r != "")
        return F.get(ranges, F.lit(0))

    labelled = F.filter(lines, lambda v: text.contains_any(v, vocab.period_labels))

    def from_element(t: Column) -> Column:
        fits = (F.length(t) >= MIN_LINE) & (F.lit(True) if element_max is None else F.length(t) <= element_max)
        return F.coalesce(text.blank_to_null(periods.page_date_range(t)), F.when(fits, t))

    elements = [let(dom.labelled(tree, label), from_element) for label in vocab.period_labels[:3]]
    label = vocab.period_labels[0]
    line = dom.first(F.filter(
        lines, lambda v: v.contains(label) & (F.lit(True) if line_max is None else F.length(v) <= line_max)))
    return F.coalesce(
        first_range(F.slice(lines, 1, top_lines)),
        first_range(labelled),
        text.blank_to_null(periods.page_date_range(body)),
        *elements,
        let(line, lambda v: F.coalesce(text.blank_to_null(periods.page_date_range(v)), v)),
        F.lit(""),
    )


def score_lines(lines: Column, vocab: Vocabulary) -> Column:
    """Per line the accepted score in each section (0 = not in that section).

    A section takes a line when its score reaches two; a line with single hits
    only goes to the first section it hits. Hints count only on lines with a hit.
    """
    names = list(vocab.section_names)
    hints = {name: (bonus, words) for name, bonus, words in vocab.section_hints}

    def score(line: Column) -> Column:
        base = F.array(*[text.hit_count(line, words) for _, words in vocab.section_rules])
        bonus = F.array(
            *[
                F.when(text.contains_any(line, hints[n][1]), hints[n][0]).otherwise(0) if n in hints else F.lit(0)
                for n in names
            ]
        )

        def accept(b: Column) -> Column:
            totals = F.zip_with(b, bonus, lambda x, y: x + y)
            first_hit = F.array_position(F.transform(b, lambda x: x > 0), True)
            facts = lambda t: F.struct(
                t.alias("t"), F.array_max(t).alias("best"), first_hit.alias("first")
            )

            def mark(f: Column) -> Column:
                taken = lambda t, i: (t >= 2) | ((f["best"] == 1) & (i + 1 == f["first"]))
                return F.transform(f["t"], lambda t, i: F.when(taken(t, i), t).otherwise(0))

            return let(let(totals, facts), mark)

        accepted = let(base, lambda b: F.when(F.array_max(b) > 0, accept(b)))
        return F.struct(line.alias("text"), accepted.alias("scores"))

    return F.filter(F.transform(lines, score), lambda e: e["scores"].isNotNull())


def section_items(scored: Column, index: int, fallback: Column) -> Column:
    """Best texts of one section; keyword blocks stand in when it got no line.

    The scored lines are useful and distinct already, as ``candidate_lines`` and ``merged_lines`` give them.
    """
    own = F.transform(
        F.filter(scored, lambda e: e["scores"][index] > 0),
        lambda e, i: F.struct(
            (-e["scores"][index]).alias("s"), (-F.length(e["text"])).alias("l"), i.alias("p"), e["text"].alias("t")
        ),
    )
    spare = F.transform(
        fallback,
        lambda t, i: F.struct(F.lit(-1).alias("s"), (-F.length(t)).alias("l"), i.alias("p"), t.alias("t")),
    )

    def best(items: Column) -> Column:
        return F.transform(F.sort_array(items), lambda e: e["t"])

    return let(own, lambda o: best(F.when(F.size(o) > 0, o).otherwise(spare)))


def sections(df: DataFrame, vocab: Vocabulary, lines: str, block_sources: list[Column]) -> DataFrame:
    """Add ``sections``: map of section name to its best texts. ``lines`` are candidate lines, distinct by key."""
    scored = df.withColumn("_scored", score_lines(F.col(lines), vocab))
    pieces = []
    for i, (name, words) in enumerate(vocab.section_rules):
        spare = keyword_blocks(block_sources, words, vocab)
        pieces += [F.lit(name), section_items(F.col("_scored"), i, spare)]
    return scored.withColumn("sections", F.create_map(*pieces)).drop("_scored")


# ---- pages ----------------------------------------------------------------------------

# fixed values: elements and menus that never hold page text
HIDDEN = (
    "script style nav footer .all_menu_container #allMenuList .siteList .rect_list #gnb #header #footer"
)


def page_texts(pages: DataFrame, vocab: Vocabulary, rendered: str | None = None, supplement_below: float | None = None) -> DataFrame:
    """Elements, visible text, blocks, container texts and candidate lines of each page.

    ``rendered`` names an optional column with browser text. It leads and the markup text follows; with
    ``supplement_below`` only when the browser text is shorter than that share of it.
    """
    tree = dom.parsed(pages, HIDDEN)
    texts = computed_once(tree, {"blocks": dom.blocks(F.col("dom")), "containers": container_texts(F.col("dom"))})
    texts = texts.withColumn("full_text", F.array_join("blocks", "\n"))
    full_lines = candidate_lines(F.col("full_text"), vocab)
    if rendered is None:
        found = computed_once(texts, {"full_lines": full_lines}).withColumn("page_lines", F.col("full_lines"))
    else:
        shown, both = text.clean_text(F.col(rendered)), F.concat_ws("\n", text.clean_text(F.col(rendered)), "full_text")
        source = F.when(shown == "", F.col("full_text")).otherwise(both)
        if supplement_below is not None:
            whole = F.length(text.clean_text(F.col("full_text")))
            source = F.when((shown == "") | (F.length(shown) < whole * supplement_below), source).otherwise(shown)
        found = computed_once(texts, {"full_lines": full_lines, "page_lines": candidate_lines(source, vocab)})
    found = found.withColumn("raw_text", F.array_join("page_lines", "\n"))
    return computed_once(found, {"lines": candidate_lines(F.col("raw_text"), vocab)})


def extract_pages(
    pages: DataFrame, vocab: Vocabulary, rendered: str | None = None, benefit_items: int | None = None,
    condition_items: int | None = None, target_items: int | None = None, few_lines: int | None = None,
) -> DataFrame:
    """Detail pages to structured promotion fields and section content.

    Fields that the page does not give directly are taken from its sections, whole unless a number of items is given.
    """
    t = page_texts(pages, vocab, rendered)
    tree, blocks = F.col("dom"), up_to(F.col("containers"), BLOCK_CHARS)
    sources = [blocks, F.col("lines"), F.col("full_lines")]
    fields = computed_once(t, {
        "title": text.first_filled(page_title(tree, vocab), dom.first(F.col("page_lines")), F.lit("")),
        "period": page_period(
            F.concat_ws(" ", F.array_join("blocks", " "), F.col("raw_text")), tree, F.col("lines"), vocab),
        "_benefit": benefit_blocks(sources, vocab),
        "_conditions": condition_blocks(sources, vocab),
        "_target": target_text(tree, F.col("lines"), vocab),
        "benefit_type": text.benefit_type_of(F.col("full_text"), vocab),
        "_merged": merged_lines(F.col("lines"), F.col("full_lines"), few_lines),
    })
    done = sections(
        fields, vocab, "_merged", [up_to(F.col("containers"), SECTION_BLOCK_CHARS), F.col("lines"), F.col("full_lines")])

    def sec(name: str, n: int | None) -> Column:
        return F.col("sections")[name] if n is None else F.slice(F.col("sections")[name], 1, n)

    conditions = F.concat(*[sec(s, condition_items) for s in vocab.condition_sections])
    assembled = computed_once(done, {
        "benefit_value": text.first_filled(
            F.col("_benefit"), F.array_join(sec(vocab.benefit_section, benefit_items), " | "), F.lit("")),
        "conditions": text.first_filled(F.col("_conditions"), F.array_join(conditions, " | "), F.lit("")),
        "target_segment": text.first_filled(
            F.col("_target"), F.array_join(sec(vocab.target_section, target_items), " | "), F.lit("")),
        "one_line_summary": F.col("title"),
    })
    everything = F.concat_ws(" ", "benefit_value", "conditions", "raw_text", "full_text")
    money = assembled.withColumns(
        {"amounts": amounts.all_amounts(everything), "percentages": amounts.all_percentages(everything)}
    )
    content = F.map_concat(
        F.col("sections"), F.create_map(F.lit("혜택_금액"), F.col("amounts"), F.lit("혜택_비율"), F.col("percentages"))
    )
    keep = [c for c in pages.columns if c not in ("html", "title", "period")]
    gone = F.coalesce(F.col("html").contains("조회 결과가 없습니다"), F.lit(False))
    fields = {
        **{c: F.col(c) for c in ("title", "period", "benefit_value", "conditions", "target_segment", "benefit_type",
                                 "one_line_summary", "raw_text")},
        "marketing_content": content,
    }
    return money.select(
        *keep, *[F.when(~gone, c).alias(name) for name, c in fields.items()],
        F.when(gone, "no such promotion").alias("error"),
    )


# fixed values: what a rich page digest is made of
DIGEST_DROPPED = "script style nav footer header aside iframe noscript"
DIGEST_TITLES = (
    "h1.event-title", "h1.title", "div.event-title h1", "h2.event-title", "h2.title", "div.title h2", "h1", "h2", ".page-title", "title",
)
DIGEST_PERIODS = (".event-period", ".period", ".date", ".event-date")
DIGEST_BODIES = (
    "div.event-content", "div.event-detail", "article.event", "div.detail-content", "div.content", "article", "main",
    "div.container", "div#content",
)
PERIOD_MARKS = "[~-]|부터|까지|기간"


def page_digest(
    pages: DataFrame, max_chars: int | None = None, body_chars: int = 1, item_chars: int = 1, list_items: int | None = None,
) -> DataFrame:
    """Title, period, body, tables, lists, image texts and description of a page as lines.

    Repeated neighbouring lines appear once. The body is the first content element with ``body_chars`` characters, else
    all of the page. Items and image texts under ``item_chars`` and lists of more than ``list_items`` are left out;
    without these numbers all are there. ``max_chars`` shortens the digest for display, never the lines.
    """
    tree = F.col("_dom")

    def head(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.array(F.concat(F.lit(label), value))).otherwise(_none())

    def block(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.array(F.lit(label)), values)).otherwise(_none())

    def block_at(label: str, i: Column, values: Column) -> Column:
        name = F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("]"))
        return let(values, lambda v: F.when(F.size(v) > 0, F.concat(F.array(name), v)).otherwise(_none()))

    title = dom.first(F.filter(dom.texts_of(tree, dom.firsts(tree, DIGEST_TITLES)), lambda t: F.length(t) > 3))
    said = F.concat(
        dom.texts_of(tree, dom.firsts(tree, DIGEST_PERIODS)),
        F.array_compact(F.array(
            dom.first(F.filter(dom.texts_of(tree, dom.select(tree, "span")), lambda t: t.contains("기간"))),
            dom.first(F.filter(dom.texts_of(tree, dom.select(tree, "div")), lambda t: t.contains("이벤트 기간"))))))
    period = dom.first(F.filter(said, lambda t: t.rlike(PERIOD_MARKS)))
    bodies = F.filter(
        F.transform(dom.firsts(tree, DIGEST_BODIES), lambda n: F.transform(
            F.filter(tree["blocks"], lambda b: (b["first"] > n["i"]) & (b["last"] <= n["last"])), lambda b: b["text"])),
        lambda lines: F.length(F.array_join(lines, "\n")) >= body_chars)
    body = F.coalesce(dom.first(bodies), dom.blocks(tree))

    def table_lines(t: Column, i: Column) -> Column:
        rows = F.transform(
            dom.select(tree, "tr", t), lambda r: F.array_join(dom.texts_of(tree, dom.select(tree, "th, td", r)), " | "))
        return block_at("표", i, F.filter(rows, lambda r: r != ""))

    def list_lines(u: Column, i: Column) -> Column:
        items = dom.texts_of(tree, dom.select(tree, "li", u))
        useful = F.filter(items, lambda t: F.length(t) >= item_chars)
        if list_items is not None:
            useful = F.when(F.size(items) <= list_items, useful).otherwise(_none())
        return block_at("목록", i, F.transform(useful, lambda t: F.concat(F.lit("- "), t)))

    alts = F.transform(dom.select(tree, "img[alt]"), lambda n: text.ustrip(n["attrs"]["alt"]))
    images = F.transform(
        F.filter(alts, lambda a: (F.length(a) >= item_chars) & ~a.contains("로고") & ~F.lower(a).contains("logo")),
        lambda a: F.concat(F.lit("- "), a),
    )
    lines = F.concat(
        head("[제목] ", title), head("[기간] ", period), block("[본문]", body),
        F.flatten(F.transform(dom.select(tree, "table"), table_lines)),
        F.flatten(F.transform(dom.select(tree, "ul, ol"), list_lines)),
        block("[이미지 설명]", images), head("[메타 설명] ", dom.meta(tree, "description")),
    )
    tree_of = dom.parsed(pages.select("page_id", "html"), DIGEST_DROPPED, name="_dom")
    digest = computed_once(tree_of, {"lines": drop_repeats(lines)})
    shown = F.array_join("lines", "\n")
    if max_chars is not None:
        shown = let(
            shown,
            lambda w: F.when(
                F.length(w) > max_chars, F.concat(F.substring(w, 1, max_chars), F.lit("\n...(내용 생략)"))
            ).otherwise(w),
        )
    return digest.select("page_id", "lines", shown.alias("digest"))


def drop_repeats(lines: Column) -> Column:
    """Blank lines out, runs of equal neighbours to one line."""
    kept = F.filter(F.transform(lines, text.ustrip), lambda v: v != "")
    return let(
        kept,
        lambda k: F.filter(k, lambda v, i: (i == 0) | (v != k[F.greatest(i - 1, F.lit(0))])),
    )
