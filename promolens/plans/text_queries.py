"""Registered queries: text structuring, scoring and model response tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from promolens.functions import dom, periods, records, text
from promolens.functions.rows import computed_once, exploded, posexploded
from promolens.operators import responses as rs
from promolens.operators import scoring as sc
from promolens.operators import structure as st
from promolens.plans import adapters as ad
from promolens.plans import oracle_views as ov
from promolens.plans import page_views as pv
from promolens.plans.flat import flat
from promolens.plans.sample_vocab import SAMPLE
from promolens.plans.settings import PARAMS
from promolens.vocabulary import (
    CATEGORY_DEFAULT, CHANNEL_RULES, LEGACY_CATEGORY_RULES, LEVEL_KEEP_WORDS, OBJECTIVE_RULES, STRATEGY_RULES,
    TARGET_SIGNALS, TARGET_TAGS, VIP_WORDS,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
V = PARAMS.vocab


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, base: flat(fn(spark, base))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# ---- documents ----------------------------------------------------------------------------

def alternatives(words) -> str:
    return "|".join(w.replace(".", "\\.") for w in words)


def usable(c: str, v) -> str:
    heads = alternatives(v.header_words)
    first, second = v.hidden_title_pair
    return f"""(NOT (length({c}) <= 5 OR regexp_matches(trim({c}), '^(?:{heads})(?: |$)| (?:{heads})$'))
      AND NOT (length({c}) >= 10 AND (regexp_matches({c}, '^(?:{alternatives(v.notification_prefixes)})') OR (contains({c}, '{first}') AND contains({c}, '{second}'))))
      AND NOT ({ov.any_of(c, v.noise_words)} AND NOT ({ov.any_of(c, v.noise_rescue_words)} AND NOT {ov.any_of(c, v.noise_always_words)})))"""


KEY = "lower(regexp_replace({0}, '[^0-9A-Za-z가-힣]', '', 'g'))"


def candidate_cte(source: str, v, name: str = "cand") -> str:
    """Candidate lines of ``source(doc_id, text)`` as ``name(doc_id, pos, line)``."""
    norm = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
    cuts = "\n".join(
        f"UNION ALL SELECT doc_id, ln, {i + 2}, p, unnest(parts), line FROM (SELECT doc_id, ln, line, string_split(line, '{m}') AS parts, "
        f"unnest(range(1, len(string_split(line, '{m}')) + 1)) AS p FROM {name}_lines) WHERE false"
        for i, m in enumerate(v.line_markers)
    )
    cuts = "\n".join(
        f"UNION ALL SELECT doc_id, ln, {i + 2}, unnest(range(1, len(string_split(line, '{m}')) + 1)), unnest(string_split(line, '{m}')), line FROM {name}_lines WHERE contains(line, '{m}')"
        for i, m in enumerate(v.line_markers)
    )
    return f"""{name}_lines AS (SELECT doc_id, ln, {norm.format('raw')} AS line FROM (
    SELECT doc_id, unnest(range(1, len(ls) + 1)) AS ln, unnest(ls) AS raw FROM (SELECT doc_id, string_split(replace(text, chr(13), chr(10)), chr(10)) AS ls FROM {source})) WHERE {norm.format('raw')} <> ''),
  {name}_chunks AS (SELECT doc_id, ln, 0 AS kind, 0 AS p, line AS chunk, '' AS line FROM {name}_lines
    UNION ALL SELECT doc_id, ln, 1, unnest(range(1, len(string_split(regexp_replace(line, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))) + 1)),
      unnest(string_split(regexp_replace(line, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))), line FROM {name}_lines
    {cuts}),
  {name}_kept AS (SELECT doc_id, ln, kind, p, c, {KEY.format('c')} AS key FROM (SELECT *, {norm.format('chunk')} AS c FROM {name}_chunks)
    WHERE c <> '' AND (kind = 0 OR c <> line) AND length(c) >= 6 AND NOT ({ov.any_of('c', v.menu_words)} AND length(c) <= 35) AND {usable('c', v)}),
  {name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, kind, p) AS pos, c AS line FROM (
    SELECT * FROM {name}_kept WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY ln, kind, p) = 1))
"""


DOCS = "WITH " + candidate_cte("documents", SAMPLE)


def _doc_lines(spark, base):
    return ad.spread(ad.table(spark, base, "documents").select("doc_id", "text")).select("doc_id", st.candidate_lines(F.col("text"), SAMPLE).alias("lines"))


@query("candidate_lines", DOCS + "SELECT doc_id, pos, line FROM cand")
def candidate_lines(spark, base):
    return posexploded(_doc_lines(spark, base), ["doc_id"], F.col("lines"), "pos", "line").withColumn("pos", F.col("pos") + 1)


NAMES = SAMPLE.section_names


def hits(c: str, words) -> str:
    return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


def scored_sql(v, spare: str = "") -> str:
    """Section texts of the lines cand(doc_id, pos, line) as ranked(doc_id, sec, rank, c); ``spare`` gives what stands in
    for a section without lines of its own (doc_id, sec, pos, line), by default its keyword lines."""
    names, bonus = v.section_names, {n: (b, w) for n, b, w in v.section_hints}
    spare = spare or "SELECT doc_id, sec, pos, line FROM (SELECT *, unnest(range(1, 8)) AS sec FROM scored) WHERE b[sec] > 0"
    return f""", scored AS (SELECT doc_id, pos, line, [{', '.join(hits('line', w) for _, w in v.section_rules)}] AS b,
    [{', '.join(f"CASE WHEN {ov.any_of('line', bonus[n][1])} THEN {bonus[n][0]} ELSE 0 END" if n in bonus else '0' for n in names)}] AS h FROM cand),
  totals AS (SELECT *, [b[i] + h[i] for i in range(1, 8)] AS t FROM scored WHERE list_max(b) > 0),
  placed AS (SELECT doc_id, pos, line, i AS sec, t[i] AS score FROM (SELECT *, unnest(range(1, 8)) AS i FROM totals)
    WHERE t[i] >= 2 OR (list_max(t) = 1 AND i = list_position([x > 0 for x in b], true))),
  cut AS (SELECT doc_id, sec, pos, score, line AS c FROM placed),
  firsts AS (SELECT * FROM (SELECT *, {KEY.format('c')} AS key FROM cut WHERE length(c) >= 6 AND {usable('c', v)}) WHERE key <> ''
    QUALIFY row_number() OVER (PARTITION BY doc_id, sec, key ORDER BY pos) = 1),
  taken AS (SELECT * FROM firsts),
  kw AS ({spare}),
  spare AS (SELECT k.doc_id, k.sec, k.pos, 1 AS score, k.line AS c FROM kw k WHERE NOT EXISTS (SELECT 1 FROM taken x WHERE x.doc_id = k.doc_id AND x.sec = k.sec)),
  ranked AS (SELECT doc_id, sec, c, row_number() OVER (PARTITION BY doc_id, sec ORDER BY score DESC, length(c) DESC, pos) AS rank FROM (
    SELECT doc_id, sec, pos, score, c FROM taken UNION ALL SELECT * FROM spare))
"""


SCORED = scored_sql(SAMPLE)


def _doc_sections(spark, base):
    lines = _doc_lines(spark, base)
    return st.sections(lines, SAMPLE, "lines", [F.col("lines")])


@query("document_sections", DOCS + SCORED + f"""SELECT doc_id, [{', '.join("'" + n + "'" for n in NAMES)}][sec] AS section, rank, c AS content FROM ranked""")
def document_sections(spark, base):
    found = _doc_sections(spark, base).select("doc_id", F.explode_outer("sections").alias("section", "items"))
    return posexploded(found, ["doc_id", "section"], F.col("items"), "rank", "content").withColumn("rank", F.col("rank") + 1)


@query("line_hits", DOCS + "SELECT doc_id, count(*) AS lines, " + ", ".join(
    f"sum({hits('line', w)})::BIGINT AS hits_{n}" for n, w in SAMPLE.section_rules) + " FROM cand GROUP BY doc_id")
def line_hits(spark, base):
    lines = exploded(_doc_lines(spark, base), ["doc_id"], F.col("lines"), "line")
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        *[F.sum(text.hit_count(F.col("line"), w)).alias(f"hits_{n}") for n, w in SAMPLE.section_rules],
    )


@query("keyword_blocks", DOCS + f"""SELECT doc_id, string_agg(line, ' | ' ORDER BY pos) AS benefits FROM (
  SELECT * FROM cand WHERE {ov.any_of('line', dict(SAMPLE.section_rules)['benefit'])}) GROUP BY doc_id""")
def keyword_blocks(spark, base):
    lines = _doc_lines(spark, base)
    blocks = computed_once(lines, {"benefits": st.benefit_blocks([F.col("lines")], SAMPLE)})
    return blocks.select("doc_id", "benefits").where(F.col("benefits") != "")


NOISE_SQL = f"({ov.any_of('c', SAMPLE.noise_words)} AND NOT ({ov.any_of('c', SAMPLE.noise_rescue_words)} AND NOT {ov.any_of('c', SAMPLE.noise_always_words)}))"


@query("text_predicates", f"""SELECT doc_id, {KEY.format('text')} AS key, c = '' OR {NOISE_SQL} AS noise,
  length(text) >= 10 AND regexp_matches({ov.strip('text')}, '^(?:{alternatives(SAMPLE.notification_prefixes)})') AS notification FROM (
  SELECT doc_id, text, {ov.clean('text')} AS c FROM documents)""")
def text_predicates(spark, base):
    t = F.col("text")
    return ad.table(spark, base, "documents").select("doc_id", "text", text.clean_text(t).alias("c")).select(
        "doc_id", text.comparison_key(t).alias("key"), text.is_noise(F.col("c"), SAMPLE).alias("noise"),
        text.is_notification(t, SAMPLE).alias("notification"),
    )


@query("unrepeated_lines", """SELECT doc_id, count(*) AS kept_lines, sum(length(l))::BIGINT AS kept_chars FROM (
  SELECT doc_id, l, lag(l) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM (
    SELECT doc_id, n, trim(l, ' ' || chr(9)) AS l FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS l FROM (
      SELECT doc_id, string_split(text || chr(10) || text, chr(10)) AS ls FROM documents)) WHERE trim(l, ' ' || chr(9)) <> ''))
  WHERE before IS NULL OR before <> l GROUP BY doc_id""")
def unrepeated_lines(spark, base):
    twice = F.split(F.concat("text", F.lit("\n"), "text"), "\n")
    kept = exploded(ad.table(spark, base, "documents"), ["doc_id"], st.drop_repeats(twice), "l")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept_lines"), F.sum(F.length("l")).alias("kept_chars"))


# ---- pages --------------------------------------------------------------------------------

P = "WITH " + ov.PROMO_PAGES
SHOWN = P + ", " + pv.elements().strip()
HEADER_SQL = alternatives(V.header_words)
FULL = """full_texts AS (SELECT page_id AS doc_id, string_agg(s, chr(10) ORDER BY n) AS text FROM blk GROUP BY page_id)"""


@query("page_texts", SHOWN + ", " + FULL + """ SELECT doc_id AS page_id, len(string_split(text, chr(10)))::BIGINT AS blocks, text AS full_text FROM full_texts""")
def page_texts(spark, base):
    t = dom.parsed(ad.promo_pages(spark, base).select("page_id", "html"), st.HIDDEN).select("page_id", dom.blocks(F.col("dom")).alias("b"))
    return t.select("page_id", F.size("b").alias("blocks"), F.array_join("b", "\n").alias("full_text"))


TITLED = f"""found_titles AS (SELECT page_id, joined AS t FROM el WHERE tag IN ('h1', 'h2', 'h3')
    UNION ALL SELECT page_id, first(joined ORDER BY n) FROM el WHERE list_bool_or([contains(x, 'tit') FOR x IN cls]) GROUP BY page_id),
  titles AS (SELECT page_id, t AS title FROM (SELECT *, {ov.any_of('t', V.title_preferred_words)} AS pref FROM found_titles
    WHERE length(t) > 5 AND NOT regexp_matches(t, '^(?:{HEADER_SQL})(?: |$)| (?:{HEADER_SQL})$'))
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pref DESC, length(t) DESC, t) = 1)"""


@query("page_titles", SHOWN + ", " + TITLED + " SELECT page_id, title FROM titles")
def page_titles(spark, base):
    t = dom.parsed(ad.promo_pages(spark, base).select("page_id", "html"), st.HIDDEN)
    return t.select("page_id", st.page_title(F.col("dom"), V).alias("title"))


#: Lines of the whole page text (fl) and of the text made of these (ln).
LINES = FULL + ", " + candidate_cte("full_texts", V, "fl").strip() + """,
  raw_texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM fl GROUP BY doc_id), """ + candidate_cte("raw_texts", V, "ln").strip()
DATED = f"""ranges AS (SELECT doc_id, CASE WHEN pos <= 40 THEN 1 ELSE 2 END AS place, pos, {pv.date_range('line')} AS r FROM ln WHERE pos <= 40 OR {ov.any_of('line', V.period_labels)}
    UNION ALL SELECT f.doc_id, 3, 0, {pv.date_range("replace(f.text, chr(10), ' ')")} FROM full_texts f),
  dated AS (SELECT doc_id AS page_id, first(r ORDER BY place, pos) AS period FROM ranges WHERE r <> '' GROUP BY doc_id)"""
TARGETED = f"""target_words AS (SELECT unnest(range(1, {len(V.target_element_labels) + 1})) AS k, unnest([{ov.quoted(V.target_element_labels)}]) AS word),
  label_texts AS (SELECT x.page_id, k, x.n FROM txt x JOIN target_words w ON contains(x.s, w.word) QUALIFY row_number() OVER (PARTITION BY x.page_id, k ORDER BY x.n) = 1),
  holders AS (SELECT l.page_id, l.k, e.joined FROM label_texts l JOIN el e ON e.page_id = l.page_id AND l.n BETWEEN e.n AND e.e
    QUALIFY row_number() OVER (PARTITION BY l.page_id, l.k ORDER BY e.n DESC) = 1),
  target_options AS (SELECT page_id, k, joined AS t FROM holders WHERE length(joined) >= 6
    UNION ALL SELECT doc_id, 100 + pos, line FROM ln WHERE {ov.any_of('line', V.target_labels)}),
  targets AS (SELECT page_id, first(t ORDER BY k) AS target FROM target_options GROUP BY page_id)"""


@query("page_periods", f"{SHOWN}, {LINES}, {DATED} SELECT page_id, period FROM dated")
def page_periods(spark, base):
    t = st.page_texts(ad.promo_pages(spark, base), V)
    body = F.concat_ws(" ", F.array_join("blocks", " "), F.col("raw_text"))
    return t.select("page_id", st.page_period(body, F.col("dom"), F.col("lines"), V).alias("period"))


@query("page_targets", f"{SHOWN}, {LINES}, {TARGETED} SELECT page_id, target FROM targets")
def page_targets(spark, base):
    t = st.page_texts(ad.promo_pages(spark, base), V)
    return t.select("page_id", st.target_text(F.col("dom"), F.col("lines"), V).alias("target"))


#: Block texts of a page in order of their sources: container texts, lines of the raw text, lines of the full text.
SOURCES = f"""areas AS (SELECT page_id, n, e FROM el WHERE tag IN ('main', 'article') OR {pv.has('content', 'event-detail')}
      OR list_bool_or([contains(x, 'event') OR contains(x, 'detail') OR contains(x, 'campaign') FOR x IN cls])),
  held AS (SELECT a.page_id AS doc_id, 1 AS src, a.n * 1000000 + b.n AS pos, b.spaced AS line FROM areas a JOIN el b ON b.page_id = a.page_id AND b.n > a.n AND b.n <= a.e
      AND b.tag IN ('div', 'section', 'p', 'li', 'td', 'span', 'h2', 'h3', 'h4', 'dl', 'dd')
    UNION ALL SELECT doc_id, 2, pos, line FROM ln UNION ALL SELECT doc_id, 3, pos, line FROM fl),
  spare_lines AS (SELECT *, {KEY.format('line')} AS key FROM held WHERE length(line) >= 6 AND {usable('line', V)} AND (src > 1 OR length(line) <= {st.SECTION_BLOCK_CHARS})),
  cand AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY src, pos) AS pos, line FROM (SELECT * FROM (
    SELECT *, {KEY.format('line')} AS key FROM held WHERE src > 1) QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY src, pos) = 1))"""


def blocks_with(name: str, words) -> str:
    return f"""{name} AS (SELECT doc_id AS page_id, string_agg(line, ' | ' ORDER BY src, pos) AS text FROM (SELECT * FROM spare_lines
    WHERE {ov.any_of('line', words)} AND (src > 1 OR length(line) <= {st.BLOCK_CHARS}) AND key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY src, pos) = 1) GROUP BY doc_id)"""


RULES = dict(V.section_rules)
CONDITION_WORDS = tuple(w for s in V.condition_sections for w in RULES[s])
FIELDS = ", ".join((blocks_with("benefits", RULES[V.benefit_section]), blocks_with("condition_texts", CONDITION_WORDS)))
SECTIONED = scored_sql(V, f"""SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY src, pos) AS pos, line FROM (
    SELECT *, unnest(range(1, 8)) AS sec FROM spare_lines) WHERE key <> '' AND [{', '.join(ov.any_of('line', w) for _, w in V.section_rules)}][sec]
    QUALIFY row_number() OVER (PARTITION BY doc_id, sec, key ORDER BY src, pos) = 1""")
SECTION_TEXTS = f"""section_lists AS (SELECT doc_id AS page_id, sec, list(c ORDER BY rank) AS items FROM ranked GROUP BY doc_id, sec),
  section_rows AS (SELECT page_id, map_from_entries(list((sec, items))) AS m FROM section_lists GROUP BY page_id)"""


def of_sections(names) -> str:
    lists = [f"coalesce(m[{V.section_names.index(n) + 1}], [])" for n in names]
    joined = lists[0]
    for one in lists[1:]:
        joined = f"list_concat({joined}, {one})"
    return f"array_to_string({joined}, ' | ')"


EVERYTHING = "concat_ws(' ', benefit_value, conditions, raw_text, full_text)"
AMOUNTS = f"list_transform(regexp_extract_all({EVERYTHING}, '\\d[\\d,]{{0,8}}\\s*(?:만|천)?\\s*원'), lambda x: regexp_replace(x, '\\s', '', 'g'))"
SHARES = f"list_transform(regexp_extract_all({EVERYTHING}, '(\\d{{1,3}}(?:\\.\\d+)?)\\s*(?:%|％|퍼센트)', 1), lambda x: x || '%')"


def in_order(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


SECTION_COLUMNS = {name: f"section_{i}" for i, name in enumerate((*V.section_names, "혜택_금액", "혜택_비율"))}


@query("extracted_pages", f"{SHOWN}, {LINES}, {TITLED}, {DATED}, {TARGETED}, {SOURCES}, {FIELDS}{SECTIONED}, {SECTION_TEXTS}" + f""",
  parts AS (SELECT f.doc_id AS page_id, coalesce(nullif(title, ''), (SELECT line FROM fl WHERE fl.doc_id = f.doc_id AND pos = 1), '') AS title, coalesce(period, '') AS period,
    coalesce(nullif(b.text, ''), {of_sections([V.benefit_section])}, '') AS benefit_value, coalesce(nullif(c.text, ''), {of_sections(V.condition_sections)}, '') AS conditions,
    coalesce(nullif(target, ''), {of_sections([V.target_section])}, '') AS target_segment, {ov.first_rule('lower(f.text)', V.benefit_type_rules, V.benefit_type_default)} AS benefit_type,
    coalesce(r.text, '') AS raw_text, f.text AS full_text, m
    FROM full_texts f LEFT JOIN raw_texts r USING (doc_id) LEFT JOIN titles t ON t.page_id = f.doc_id LEFT JOIN dated d ON d.page_id = f.doc_id
    LEFT JOIN targets g ON g.page_id = f.doc_id LEFT JOIN benefits b ON b.page_id = f.doc_id LEFT JOIN condition_texts c ON c.page_id = f.doc_id LEFT JOIN section_rows s ON s.page_id = f.doc_id)
  SELECT page_id, title, period, benefit_value, conditions, target_segment, benefit_type, raw_text,
    {', '.join(f"{of_sections([n])} AS {SECTION_COLUMNS[n]}" for n in V.section_names)},
    array_to_string({in_order(AMOUNTS)}, ' | ') AS section_7, array_to_string({in_order(SHARES)}, ' | ') AS section_8, NULL::VARCHAR AS error FROM parts""")
def extracted_pages(spark, base):
    x = st.extract_pages(ad.promo_pages(spark, base).select("page_id", "url", "html"), V)
    return x.select(
        "page_id", "title", "period", "benefit_value", "conditions", "target_segment", "benefit_type", "raw_text",
        *[F.col("marketing_content")[name].alias(column) for name, column in SECTION_COLUMNS.items()], "error",
    )


DIGEST = P + ", " + pv.elements(("nav", "footer", "header", "aside", "iframe", "noscript"), menu=False).strip()


@query("page_digests", DIGEST + f""", details AS (SELECT page_id, n, e FROM el WHERE tag = 'div' AND {pv.has('event-detail')} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) = 1),
  listed AS (SELECT page_id, n, e, row_number() OVER (PARTITION BY page_id ORDER BY n) AS k FROM el WHERE tag IN ('ul', 'ol')),
  tabled AS (SELECT page_id, n, e, row_number() OVER (PARTITION BY page_id ORDER BY n) AS k FROM el WHERE tag = 'table'),
  table_rows AS (SELECT t.page_id, t.k, r.n, string_agg(c.joined, ' | ' ORDER BY c.n) AS line FROM tabled t JOIN el r ON r.page_id = t.page_id AND r.tag = 'tr' AND r.n BETWEEN t.n AND t.e
    JOIN el c ON c.page_id = t.page_id AND c.tag IN ('td', 'th') AND c.n BETWEEN r.n AND r.e GROUP BY ALL),
  list_rows AS (SELECT u.page_id, u.k, i.n, '- ' || i.joined AS line FROM listed u JOIN el i ON i.page_id = u.page_id AND i.tag = 'li' AND i.n BETWEEN u.n AND u.e WHERE i.joined <> ''),
  images AS (SELECT page_id, n, '- ' || {pv.attribute('alt')} AS line FROM dep WHERE tag = 'img' AND {pv.attribute('alt')} <> ''),
  found AS (SELECT page_id, 1 AS part, 0 AS k, 0 AS n, '[제목] ' || first(joined ORDER BY n) AS line FROM el WHERE tag = 'h1' AND length(joined) > 3 GROUP BY page_id
    UNION ALL SELECT page_id, 2, 0, 0, '[기간] ' || first(joined ORDER BY n) FROM el WHERE list_contains(cls, 'period') GROUP BY page_id HAVING regexp_matches(first(joined ORDER BY n), '~|-|부터|까지|기간')
    UNION ALL SELECT page_id, 3, 0, 0, '[본문]' FROM details
    UNION ALL SELECT d.page_id, 3, 1, b.n, b.s FROM details d JOIN blk b ON b.page_id = d.page_id AND b.n BETWEEN d.n AND d.e
    UNION ALL SELECT page_id, 4, k, 0, '[표 ' || k || ']' FROM table_rows GROUP BY page_id, k UNION ALL SELECT page_id, 4, k, n, line FROM table_rows
    UNION ALL SELECT page_id, 5, k, 0, '[목록 ' || k || ']' FROM list_rows GROUP BY page_id, k UNION ALL SELECT page_id, 5, k, n, line FROM list_rows
    UNION ALL SELECT page_id, 6, 0, 0, '[이미지 설명]' FROM images GROUP BY page_id UNION ALL SELECT page_id, 6, 1, n, line FROM images),
  kept AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY page_id ORDER BY part, k, n) AS before FROM found) WHERE before IS NULL OR before <> line)
  SELECT page_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY part, k, n) AS digest FROM kept GROUP BY page_id""")
def page_digests(spark, base):
    return st.page_digest(ad.promo_pages(spark, base)).select("page_id", F.size("lines").alias("lines"), "digest")


# ---- scoring -----------------------------------------------------------------------------------

POOLS = f""", base AS (SELECT *, id % 5 = 3 AS hc,
    CASE WHEN id % 5 = 3 THEN title || ' 혜택 ' END AS s1, CASE WHEN id % 5 = 3 THEN '앱 응모 ' || segment END AS s2,
    CASE WHEN id % 5 = 3 AND id % 2 = 0 THEN '스타벅스' END AS s5 FROM campaigns),
  pools AS (SELECT *, concat_ws(' ', nullif(benefit_value, ''), nullif(conditions, ''), s1, s2, s5) AS bp, nullif(target_segment, '') AS tp,
    s5 IS NOT NULL AS partner FROM base),
  pools2 AS (SELECT *, concat_ws(' ', title, target_segment, raw_text, nullif(bp, '')) AS pool FROM pools),
  figs AS (SELECT *, list_transform(regexp_extract_all(bp, '\\d[\\d,]{{0,8}}\\s*(?:만|천)?\\s*원'), lambda x: regexp_replace(x, '\\s', '', 'g')) AS w1,
    regexp_extract_all(bp, '(\\d{{1,3}}(?:\\.\\d+)?)\\s*(?:%|％|퍼센트)', 1) AS p1,
    list_transform(regexp_extract_all(pool, '\\d[\\d,]{{0,8}}\\s*(?:만|천)?\\s*원'), lambda x: regexp_replace(x, '\\s', '', 'g')) AS w2,
    regexp_extract_all(pool, '(\\d{{1,3}}(?:\\.\\d+)?)\\s*(?:%|％|퍼센트)', 1) AS p2 FROM pools2),
  maxes AS (SELECT *, coalesce(list_max(list_transform(CASE WHEN len(w1) + len(p1) = 0 THEN w2 ELSE w1 END,
      lambda x: try_cast(regexp_replace(x, '[^\\d]', '', 'g') AS BIGINT) * CASE WHEN contains(x, '만') THEN 10000 WHEN contains(x, '천') THEN 1000 ELSE 1 END)), 0) AS mwon,
    coalesce(list_max(list_transform(CASE WHEN len(w1) + len(p1) = 0 THEN p2 ELSE p1 END, lambda x: x::DOUBLE)), 0) AS mp FROM figs),
  lev AS (SELECT *, CASE WHEN mwon >= 100000 OR mp >= 30 THEN '높음' WHEN mwon >= 50000 OR mp >= 20 THEN '중상'
    WHEN mwon >= 10000 OR mp >= 10 OR {ov.any_of('pool', LEVEL_KEEP_WORDS)} THEN '보통' ELSE '낮음' END AS lv,
    ({' + '.join(f"contains(tp, '{s}')::INT" for s in TARGET_SIGNALS)}) AS sig FROM maxes),
  rated AS (SELECT *, CASE lv WHEN '높음' THEN 4.0 WHEN '중상' THEN 3.0 WHEN '보통' THEN 2.0 ELSE 1.0 END::DOUBLE AS score,
    CASE WHEN trim(tp) = '' THEN '낮음' WHEN {ov.any_of('tp', ('전체', '전 고객', '전회원'))} AND sig <= 2 THEN '낮음'
      WHEN sig >= 3 OR regexp_matches(tp, '[가-힣A-Za-z0-9\\s]{{2,25}}카드') THEN '높음' ELSE '보통' END AS clarity,
    {ov.labels(("contains(pool, '무이자') OR contains(pool, '할부')", '무이자/할부 혜택'), ("mp >= 20", '높은 할인율'), ("mwon >= 50000", '고액 혜택'),
      ("contains(pool, '캐시백')", '즉시 체감형 캐시백'), ("contains(pool, '포인트') OR contains(pool, '적립')", '포인트 적립형 혜택'), ("partner", '제휴 파트너 연계'),
      (ov.any_of('pool', VIP_WORDS), '프리미엄 고객 혜택'))} AS pts,
    {ov.labels(*[(ov.any_of('pool', w), n) for n, w in STRATEGY_RULES], ("partner OR contains(pool, '제휴')", '브랜드 제휴 확장'), ("mwon >= 50000 OR mp >= 20", '공격적 가격 프로모션'))} AS strat,
    {ov.labels(*[(ov.any_of("concat_ws(' ', title, nullif(benefit_value, ''), nullif(conditions, ''), nullif(raw_text, ''))", w), n) for n, w in OBJECTIVE_RULES])} AS obj,
    {ov.labels(*[(f"contains(concat_ws(' ', target_segment, conditions), '{t}')", t) for t in TARGET_TAGS])} AS tgt,
    {ov.labels(*[(ov.any_of("concat_ws(' ', nullif(conditions, ''), nullif(raw_text, ''))", w), n) for n, w in CHANNEL_RULES])} AS chn,
    CASE WHEN hc THEN round_even((2 + (id % 2 = 0)::INT) / 7.0, 2) ELSE 0.0 END::DOUBLE AS coverage FROM lev)
"""
RATED = "WITH " + ov.CAMPAIGNS + POOLS


def _scored(spark, base):
    events = ad.campaigns(spark, base).withColumn("marketing_content", records.content_map(F.col("marketing_content")))
    return sc.rule_insights(events, V)


@query("rule_insights", RATED + """SELECT id, lv AS benefit_level, score AS benefit_score, clarity AS target_clarity, array_to_string(pts, ' | ') AS competitive_points,
  array_to_string(CASE WHEN len(strat) > 0 THEN strat WHEN lv IN ('높음', '중상') THEN ['혜택 중심 인지도 강화'] ELSE ['기본 혜택 유지형'] END, ' | ') AS promo_strategies,
  array_to_string(obj, ' | ') AS objective_tags, array_to_string(CASE WHEN len(tgt) > 0 THEN tgt ELSE ['전연령'] END, ' | ') AS target_tags,
  array_to_string(chn, ' | ') AS channel_tags, 0.5::DOUBLE AS insight_confidence, coverage AS section_coverage, 'rule' AS source FROM rated""")
def rule_insights(spark, base):
    return _scored(spark, base).select(
        "id", "benefit_level", "benefit_score", "target_clarity", "competitive_points", "promo_strategies", "objective_tags",
        "target_tags", "channel_tags", "insight_confidence", "section_coverage", "source",
    )


R = "WITH " + ov.RESPONSES


@query("parsed_responses", R + """SELECT id, ok, CASE WHEN ok THEN level END AS benefit_level, CASE WHEN ok THEN threat END AS threat_level,
  CASE WHEN ok THEN 'k' || k END AS point, CASE WHEN ok THEN event_type END AS category FROM responses""")
def parsed_responses(spark, base):
    p = rs.parse_responses(ad.response_texts(spark, base))
    return p.select(
        "id", F.col("answer").isNotNull().alias("ok"), "answer.benefit_level", "answer.threat_level",
        F.get("answer.competitive_points", F.lit(0)).alias("point"), "answer.category",
    )


@query("hybrid_insights", RATED + ", " + ov.RESPONSES.strip() + """SELECT c.id, CASE WHEN ok THEN r.level ELSE lv END AS benefit_level,
  CASE WHEN ok THEN CASE r.level WHEN '높음' THEN 4.0 WHEN '중상' THEN 3.0 WHEN '낮음' THEN 1.0 ELSE 2.0 END ELSE score END::DOUBLE AS benefit_score,
  CASE WHEN ok THEN 'gemini' ELSE 'rule' END AS source, CASE WHEN ok THEN 0.85 ELSE 0.5 END::DOUBLE AS insight_confidence,
  CASE WHEN ok THEN r.threat ELSE threat_level END AS threat_level, CASE WHEN ok THEN r.event_type ELSE category END AS category,
  CASE WHEN ok THEN 'summary ' || k ELSE one_line_summary END AS one_line_summary, CASE WHEN ok THEN 'reason ' || k END AS threat_reason,
  CASE WHEN ok THEN 'takeaway ' || k END AS marketing_takeaway, CASE WHEN ok THEN 'e' || k ELSE '' END AS evidence, CASE WHEN ok THEN 'w | ' || k ELSE '' END AS weaknesses,
  CASE WHEN ok THEN 'k' || k ELSE array_to_string(pts, ' | ') END AS competitive_points
  FROM (SELECT * FROM rated) c LEFT JOIN responses r ON r.id = c.id""")
def hybrid_insights(spark, base):
    merged = sc.hybrid_insights(_scored(spark, base), rs.parse_responses(ad.response_texts(spark, base)))
    return merged.select(
        "id", "benefit_level", "benefit_score", "source", "insight_confidence", "threat_level", "category",
        "one_line_summary", "threat_reason", "marketing_takeaway", "evidence", "weaknesses", "competitive_points",
    )


@query("insight_overlay", RATED + ", " + ov.RESPONSES.strip() + """SELECT c.id, CASE WHEN ok AND r.level <> '' THEN r.level ELSE lv END AS benefit_level, clarity AS target_clarity,
  CASE WHEN ok THEN r.threat ELSE threat_level END AS threat_level, CASE WHEN ok THEN 'k' || k ELSE array_to_string(pts, ' | ') END AS competitive_points
  FROM (SELECT * FROM rated) c LEFT JOIN responses r ON r.id = c.id""")
def insight_overlay(spark, base):
    none = F.lit(None).cast("string")
    rules = _scored(spark, base).withColumns({"threat_reason": none, "marketing_takeaway": none})
    merged = rs.overlay(rules, rs.parse_responses(ad.response_texts(spark, base)))
    return merged.select("id", "benefit_level", "target_clarity", "threat_level", "competitive_points")


@query("request_prompts", "WITH " + ov.CAMPAIGNS + """SELECT id, concat_ws(chr(10), 'company: ' || company, 'title: ' || title, 'period: ' || coalesce(nullif(period, ''), '미추출'),
  'target: ' || target_segment, 'benefit: ' || coalesce(nullif(benefit_value, ''), '미추출'), 'conditions: ' || coalesce(nullif(conditions, ''), '미추출'),
  'sections:', CASE WHEN has_content THEN concat_ws(chr(10), '[혜택_상세] ' || title || ' 혜택' || ' / ', '[참여방법] 앱 응모 / ' || segment,
    CASE WHEN id % 2 = 0 THEN '[파트너십] 스타벅스' END) ELSE '(섹션 데이터 없음)' END, 'page:', coalesce(raw_text, '')) AS prompt FROM campaigns""")
def request_prompts(spark, base):
    events = ad.campaigns(spark, base).withColumn("marketing_content", records.content_map(F.col("marketing_content")))
    return rs.request_table(events, V.section_names)


def _answers(spark, base, body):
    """Answer texts built from behaviour events: fenced for even ids, cut for every ninth."""
    ev = ad.table(spark, base, "events")
    whole = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    broken = F.when(F.col("event_id") % 9 == 0, F.substring(body, 1, 12)).otherwise(whole)
    return ev.select(
        F.col("event_id").alias("id"), F.concat(F.lit("https://www.example.com/e/"), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit("source "), F.repeat(F.col("event_type"), 300)).alias("source_text"), broken.alias("response"),
    )


E = "WITH ev AS (SELECT *, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 9 <> 0) "


@query("company_briefs", E + """SELECT event_id AS id, 'view of ' || event_type AS overview, '' AS key_strategy, 'a | k' || k || ' | c | d' AS strongest_categories FROM ev WHERE k % 4 <> 0""")
def company_briefs(spark, base):
    k = ad.props_k()
    body = F.concat(
        F.lit('{"overview":"'), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit(" view of "), F.col("event_type"))),
        F.lit('","strongest_categories":[" a ","","k'), k.cast("string"), F.lit('","c","d"]}'),
    )
    return rs.valid_briefs(_answers(spark, base, body)).select("id", "overview", "key_strategy", "strongest_categories")


@query("level_comparisons", E + """SELECT event_id AS id, '카드 4사 비교 요약' AS title, 4::BIGINT AS metrics, 'A=높음' AS first_cells, 's' AS summary FROM ev WHERE k % 3 <> 0""")
def level_comparisons(spark, base):
    k = ad.props_k()
    row = lambda n, level: F.concat(F.lit(f'{{"metric":"m{n}","values":{{"A":"'), level, F.lit('","B":"최고"},"reason":"r"}'))
    high = F.lit("높음")
    last = F.when(k % 3 == 0, "최저").otherwise("낮음")
    body = F.concat(
        F.lit('{"title":"","rows":['), F.concat_ws(",", row(1, high), row(2, high), row(3, high), row(4, last)), F.lit('],"summary":["s",""," "]}')
    )
    found = rs.valid_comparisons(_answers(spark, base, body))
    cells = F.transform(F.map_entries(F.col("rows")[0]["values"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("id", "title", F.size("rows").alias("metrics"), cells.alias("first_cells"), "summary")


@query("text_comparisons", E + """SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'p' || k ELSE '' END AS common_patterns, 'q' AS condition_patterns, 1::BIGINT AS companies FROM ev""")
def text_comparisons(spark, base):
    k = ad.props_k()
    body = F.concat(
        F.lit('{"common_patterns":'), F.when(k % 2 == 0, F.concat(F.lit('["p'), k.cast("string"), F.lit('"]'))).otherwise('"oops"'),
        F.lit(',"differentiators":{"A":["x"]},"condition_patterns":["q"]}'),
    )
    found = rs.valid_text_comparisons(_answers(spark, base, body))
    return found.select("id", "common_patterns", "condition_patterns", F.size(F.map_keys("differentiators")).alias("companies"))


@query("extraction_records", E + """SELECT event_id AS id, 'https://www.example.com/e/' || event_id AS url, 't' || k AS title, 'source ' || repeat(event_type, 300) AS raw_text FROM ev""")
def extraction_records(spark, base):
    body = F.concat(F.lit('{"title":"t'), ad.props_k().cast("string"), F.lit('"}'))
    return rs.extraction_records(_answers(spark, base, body)).select("id", "url", "title", "raw_text")


@query("vision_records", f"""WITH ev AS (SELECT *, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events),
  a AS (SELECT event_id AS id, event_id % 9 = 0 AS bad, k, CASE WHEN k % 5 = 0 THEN '' ELSE '여행 ' || event_type END AS title, CASE WHEN k % 2 = 0 THEN '' ELSE k || '원' END AS benefit,
    CASE WHEN k % 3 = 0 THEN '' ELSE '2026.03.31' END AS e FROM ev)
  SELECT id, CASE WHEN bad THEN '제목 없음' ELSE title END AS title, CASE WHEN bad THEN '~정보 없음' ELSE '~' || e END AS period,
    CASE WHEN bad THEN '상세 페이지 참조' ELSE benefit END AS benefit_value, CASE WHEN bad THEN ' / ' ELSE '- / 30만원' END AS conditions,
    CASE WHEN NOT bad AND {ov.any_of('title', dict(LEGACY_CATEGORY_RULES)['여행'])} THEN '여행' ELSE '{CATEGORY_DEFAULT}' END AS category,
    CASE WHEN bad THEN 'json' WHEN title = '' THEN 'title' WHEN benefit = '' AND e = '' THEN 'empty' END AS reject_reason FROM a""")
def vision_records(spark, base):
    k = ad.props_k()
    body = F.concat(
        F.lit('{"이벤트명":"'), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("여행 "), F.col("event_type"))),
        F.lit('","혜택금액내용":"'), F.when(k % 2 == 0, "").otherwise(F.concat(k.cast("string"), F.lit("원"))),
        F.lit('","참여방법":"-","전월실적조건":"30만원","이벤트종료일":"'), F.when(k % 3 == 0, "").otherwise("2026.03.31"), F.lit('"}'),
    )
    found = rs.vision_records(_answers(spark, base, body), "V", V, LEGACY_CATEGORY_RULES)
    return found.select("id", "title", "period", "benefit_value", "conditions", "category", "reject_reason")
