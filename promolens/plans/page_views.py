"""DuckDB views of pages as elements, read from the page's own tokens, for checking results.

They hold for pages whose tags of ``BALANCED`` are balanced, as those of the adapter are; a paragraph ends at the next
tag that is not inline. Nothing here uses the library's parser or patterns.
"""

from __future__ import annotations

from promolens.plans import oracle_views as ov

BALANCED = "nav ul li a article div strong span table tr th td h1 footer title head".split()
INLINE = "b br span strong a img".split()
EDGES = (
    "div section article main header footer nav aside p ul ol li table thead tbody tr td th h1 h2 h3 h4 h5 h6 dl dt dd "
    "br body html head title form"
).split()


def plain(c: str) -> str:
    return ov.clean(ov.unescape(f"replace({c}, '&#49888;', '신')"))


def elements(hidden: tuple[str, ...] = ("nav", "footer"), menu: bool = True) -> str:
    """Views tok, el (elements with classes, id, ``joined`` and ``spaced`` text), txt (texts) and blk (text blocks); without
    the hidden tags and, if any tag is hidden, the named menu."""
    gone = f"tag IN ({ov.quoted(hidden)})" + (" OR regexp_matches(t, 'id=\"gnb\"')" if menu else "") if hidden else "false"
    return f"""
src AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script>', '', 'g'),
    '(?is)<style\\b.*?</style>', '', 'g') AS h FROM promo_pages),
tok AS (SELECT page_id, n, t, starts_with(t, '<') AS is_tag, starts_with(t, '</') AS closing, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag
  FROM (SELECT page_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS n FROM (SELECT page_id, regexp_extract_all(h, '<[^>]*>|[^<]+') AS ts FROM src))),
dep AS (SELECT *, sum(CASE WHEN tag IN ({ov.quoted(BALANCED)}) THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER w AS d,
    sum(CASE WHEN tag IN ({ov.quoted(EDGES)}) THEN 1 ELSE 0 END) OVER w AS g FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY n)),
el0 AS (SELECT o.page_id, o.n, o.tag, o.t, min(c.n) AS e FROM dep o JOIN dep c ON c.page_id = o.page_id AND c.n > o.n AND c.closing AND c.tag = o.tag AND c.d = o.d - 1
    WHERE o.tag IN ({ov.quoted(BALANCED)}) AND NOT o.closing GROUP BY ALL
  UNION ALL SELECT o.page_id, o.n, o.tag, o.t, min(c.n) FROM dep o JOIN dep c ON c.page_id = o.page_id AND c.n > o.n AND c.is_tag AND c.tag NOT IN ({ov.quoted(INLINE)})
    WHERE o.tag = 'p' AND NOT o.closing GROUP BY ALL),
hid AS (SELECT page_id, n, e FROM el0 WHERE {gone}),
raw_txt AS (SELECT page_id, n, g, t, {plain('t')} AS s FROM dep WHERE NOT is_tag AND NOT EXISTS (SELECT 1 FROM hid WHERE hid.page_id = dep.page_id AND dep.n BETWEEN hid.n AND hid.e)),
txt AS (SELECT * FROM raw_txt WHERE s <> ''),
blk AS (SELECT page_id, g, min(n) AS n, {plain("string_agg(t, '' ORDER BY n)")} AS s FROM raw_txt GROUP BY page_id, g HAVING {plain("string_agg(t, '' ORDER BY n)")} <> ''),
el AS (SELECT a.*, string_split(regexp_extract(a.t, 'class=["'']([^"'']*)["'']', 1), ' ') AS cls, coalesce(string_agg(s, ' ' ORDER BY x.n), '') AS spaced,
    coalesce(string_agg(s, '' ORDER BY x.n), '') AS joined
  FROM el0 a LEFT JOIN txt x ON x.page_id = a.page_id AND x.n BETWEEN a.n AND a.e
  WHERE NOT EXISTS (SELECT 1 FROM hid WHERE hid.page_id = a.page_id AND a.n BETWEEN hid.n AND hid.e) GROUP BY a.page_id, a.n, a.tag, a.t, a.e)
"""


def has(*classes: str) -> str:
    return f"list_has_any(cls, [{ov.quoted(classes)}])"


def attribute(name: str, t: str = "t") -> str:
    value = f"regexp_extract({t}, '\\b{name}=(\"[^\"]*\"|''[^'']*'')', 1)"
    return ov.unescape(f"substr({value}, 2, length({value}) - 2)")


def date_range(c: str) -> str:
    """First date range of a text, canonical, else empty: whole, with a short end, in words."""
    day = "(\\d{2,4})[./-]\\s*(\\d{1,2})[./-]\\s*(\\d{1,2})"
    to = "\\s*(?:\\([^)]*\\))?\\s*(?:~|～|-|–|∼)\\s*"
    words = "(\\d{2,4})\\s*년\\s*(\\d{1,2})\\s*월\\s*(\\d{1,2})\\s*일?"
    shapes = (
        (day + to + day, (1, 2, 3, 4, 5, 6)), (day + to + "(\\d{1,2})[./-]\\s*(\\d{1,2})", (1, 2, 3, 1, 4, 5)),
        (words + "\\s*(?:~|～|-|–|∼|부터)\\s*" + words, (1, 2, 3, 4, 5, 6)),
    )
    cases = ""
    for pattern, groups in shapes:
        part = [f"try_cast(regexp_extract({c}, '{pattern}', {g}) AS INT)" for g in groups]
        year = lambda y: f"{y} + CASE WHEN {y} < 100 THEN 2000 ELSE 0 END"
        cases += (
            f" WHEN regexp_matches({c}, '{pattern}') THEN printf('%04d.%02d.%02d~%04d.%02d.%02d', {year(part[0])}, {part[1]}, {part[2]}, "
            f"{year(part[3])}, {part[4]}, {part[5]})"
        )
    return f"CASE{cases} ELSE '' END"
