"""Pages as element arrays: one pass of the standard library's HTML parser, then Column expressions.

``parsed`` adds to each page a struct ``dom`` of two arrays. ``nodes`` holds elements and texts (tag ``#text``) in page
order, each with its parent (``up``), its last descendant (``last``), id, classes and attributes; so the inside of an
element is a slice, and nested elements end where they end. ``blocks`` holds the texts between block-level tags with
the nodes they cover. Character references are decoded, attributes may stand in any quotes, tags that HTML closes by
itself are closed, end tags without a start are skipped. Dropped elements, scripts, styles and comments leave no node.

The parser sees batches of bounded size and keeps no state between pages; all else runs in the JVM.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.functions import text
from promolens.functions.text import let

DOM = (
    "struct<nodes:array<struct<i:int,last:int,up:int,tag:string,id:string,classes:array<string>,"
    "attrs:map<string,string>,text:string>>,blocks:array<struct<first:int,last:int,text:string>>>"
)
#: Characters of markup that a worker parses before it hands the result on; its nodes take some hundred times as much.
SLICE_CHARS = 1 << 17
# fixed values: tags without content, tags that bound text blocks, and what a start tag closes up to which tags
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK_TAGS = (
    "div section article main header footer nav aside p ul ol li table thead tbody tr td th h1 h2 h3 h4 h5 h6 dl dt dd "
    "br body html head title form"
).split()
CLOSES_P = "address article aside blockquote dl div fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "tr": ("tr", "table"), "tbody": ("thead tbody tfoot", "table"), "option": ("option", "select"),
}


def _reader(drop: str):
    """A function from HTML to (nodes, blocks); made inside the task."""
    from html.parser import HTMLParser

    void, edges, ends_p = frozenset(VOID), frozenset(BLOCK_TAGS), frozenset(CLOSES_P)
    closes = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}
    names = {s for s in drop.split() if s[0] not in ".#"}
    ids, classes = {s[1:] for s in drop.split() if s[0] == "#"}, {s[1:] for s in drop.split() if s[0] == "."}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.nodes, self.blocks, self.open, self.count = [], [], [], {}
            self.hidden, self.parts, self.first, self.mute = 0, [], None, 0

        def edge(self):
            if self.first is not None and (words := "".join(self.parts).split()):
                self.blocks.append((self.first, len(self.nodes) - 1, " ".join(words)))
            self.parts, self.first = [], None

        def pop(self):
            tag, node, hides = self.open.pop()
            self.count[tag] -= 1
            self.hidden -= hides
            self.mute -= tag in ("script", "style")
            if tag in edges:
                self.edge()
            if node >= 0:
                self.nodes[node][1] = len(self.nodes) - 1

        def close_open(self, tags, up_to):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in tags:
                    while len(self.open) > k:
                        self.pop()
                    return
                if self.open[k][0] in up_to:
                    return

        def handle_starttag(self, tag, attrs):
            if tag in ends_p and self.count.get("p"):
                self.close_open({"p"}, {"table", "td", "th", "button"})
            if tag in closes:
                self.close_open(*closes[tag])
            if tag in edges:
                self.edge()
            own = {}
            for k, v in attrs:
                own.setdefault(k, v or "")
            kinds = own.get("class", "").split()
            hides = tag in names or own.get("id", "") in ids or not classes.isdisjoint(kinds)
            node = -1
            if not (self.hidden or hides):
                node = len(self.nodes)
                self.nodes.append([node, node, self.parent(), tag, own.get("id", ""), kinds, own, None])
            if tag not in void:
                self.open.append((tag, node, int(hides)))
                self.count[tag] = self.count.get(tag, 0) + 1
                self.hidden += hides
                self.mute += tag in ("script", "style")

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)

        def handle_endtag(self, tag):
            if self.count.get(tag):
                while self.open[-1][0] != tag:
                    self.pop()
                self.pop()
            elif tag in edges:
                self.edge()

        def parent(self):
            return self.open[-1][1] if self.open else -1

        def handle_data(self, data):
            if not (self.hidden or self.mute):
                self.parts.append(data)
                if data.strip():
                    node = len(self.nodes)
                    self.first = node if self.first is None else self.first
                    self.nodes.append([node, node, self.parent(), "#text", "", [], {}, data])

        def done(self):
            self.close()
            while self.open:
                self.pop()
            self.edge()
            return self.nodes, self.blocks

    def read(html):
        reader = Reader()
        reader.feed(html or "")
        return reader.done()

    return read


def _arrow(pages: list) -> pa.Array:
    """``DOM`` values of parsed pages, built column by column."""

    def offsets(sizes):
        out = [0]
        for n in sizes:
            out.append(out[-1] + n)
        return pa.array(out, pa.int32())

    nodes = [n for p, _ in pages for n in p]
    blocks = [b for _, p in pages for b in p]
    classes = pa.ListArray.from_arrays(offsets(len(n[5]) for n in nodes), pa.array([c for n in nodes for c in n[5]], pa.string()))
    attrs = pa.MapArray.from_arrays(
        offsets(len(n[6]) for n in nodes), pa.array([k for n in nodes for k in n[6]], pa.string()),
        pa.array([v for n in nodes for v in n[6].values()], pa.string()))
    ints, strings = pa.int32(), pa.string()
    flat = [pa.array([n[k] for n in nodes], ints) for k in range(3)]
    flat += [pa.array([n[k] for n in nodes], strings) for k in (3, 4)]
    flat += [classes, attrs, pa.array([n[7] for n in nodes], strings)]
    node = pa.StructArray.from_arrays(flat, names=["i", "last", "up", "tag", "id", "classes", "attrs", "text"])
    block = pa.StructArray.from_arrays(
        [pa.array([b[k] for b in blocks], t) for k, t in enumerate((ints, ints, strings))], names=["first", "last", "text"])
    return pa.StructArray.from_arrays([
        pa.ListArray.from_arrays(offsets(len(p) for p, _ in pages), node),
        pa.ListArray.from_arrays(offsets(len(p) for _, p in pages), block),
    ], names=["nodes", "blocks"])


def parsed(pages: DataFrame, drop: str = "", html: str = "html", name: str = "dom") -> DataFrame:
    """``pages`` with the column ``name``; elements that match ``drop`` (tags, ``#ids``, ``.classes``) are left out."""
    kept = [c for c in pages.columns if c not in (html, name)]
    fields = [T.StructField("row", T.StructType([pages.schema[c] for c in kept])), T.StructField("html", T.StringType())]
    schema = T.StructType([*fields, T.StructField("dom", T._parse_datatype_string(DOM))])
    reader, to_arrow, limit = _reader, _arrow, SLICE_CHARS

    def run(batches):
        read = reader(drop)
        for batch in batches:
            at, held, pages = 0, 0, []
            for k, html in enumerate(batch.column(1)):
                page = html.as_py() or ""
                pages.append(read(page))
                held += len(page)
                if held >= limit or k + 1 == batch.num_rows:
                    tree = to_arrow(pages)
                    pages.clear()
                    yield pa.record_batch([*batch.slice(at, k + 1 - at).columns, tree], names=schema.names)
                    at, held, tree = k + 1, 0, None
            pa.default_memory_pool().release_unused()

    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{html}`").alias("html"))
    return packed.mapInArrow(run, schema).select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("html").alias(html), F.col("dom").alias(name))


# ---- selecting ------------------------------------------------------------------------

def _compound(selector: str):
    """``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr*=x]``, ``[attr^=x]`` and combinations, as a predicate on a node."""
    tag = re.match(r"[a-z][a-z0-9]*", selector)
    rest = re.findall(r"([.#])([\w-]+)|\[([\w:-]+)(?:([*^])='([^']*)')?\]", selector)

    def holds(n: Column) -> Column:
        found = F.lit(True) if not tag else n["tag"] == tag[0]
        for mark, name, attr, how, value in rest:
            own = n["attrs"][attr] if attr else None
            if mark == ".":
                found = found & F.array_contains(n["classes"], name)
            elif mark == "#":
                found = found & (n["id"] == name)
            elif not how:
                found = found & F.map_contains_key(n["attrs"], attr)
            else:
                found = found & F.coalesce(own.contains(value) if how == "*" else own.startswith(value), F.lit(False))
        return found

    return holds


def inside(dom: Column, node: Column) -> Column:
    """All nodes below a node."""
    return F.slice(dom["nodes"], node["i"] + 2, node["last"] - node["i"])


def select(dom: Column, selector: str, root: Column | None = None) -> Column:
    """Elements of the page, or below ``root``, that a comma list of selectors matches, in page order.

    A selector is a compound, or two with a blank between: an ancestor and what lies below it.
    """
    nodes = dom["nodes"] if root is None else inside(dom, root)
    plain, nested = [], []
    for one in selector.split(","):
        parts = one.split()
        if len(parts) == 1:
            plain.append(_compound(parts[0]))
        else:
            nested.append((F.filter(dom["nodes"], _compound(parts[0])), _compound(parts[1])))

    def holds(n: Column) -> Column:
        found = F.lit(False)
        for p in plain:
            found = found | p(n)
        for tops, p in nested:
            found = found | (p(n) & F.exists(tops, lambda a: (a["i"] < n["i"]) & (n["i"] <= a["last"])))
        return found

    return F.filter(nodes, holds)


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def firsts(dom: Column, selectors: tuple[str, ...], root: Column | None = None) -> Column:
    """The first element of each selector that has one, in the order of the selectors."""
    return F.array_compact(F.array(*[first(select(dom, s, root)) for s in selectors]))


def enclosing(dom: Column, node: Column, tags: tuple[str, ...]) -> Column:
    """The nearest element around ``node`` with one of the tags, else the node itself."""
    around = F.filter(dom["nodes"], lambda n: (n["i"] < node["i"]) & (n["last"] >= node["i"]) & n["tag"].isin(*tags))
    return F.coalesce(F.get(around, F.size(around) - 1), node)


# ---- texts ----------------------------------------------------------------------------

def strings(nodes: Column) -> Column:
    """The stripped texts among the nodes."""
    return F.transform(F.filter(nodes, lambda n: n["tag"] == "#text"), lambda n: text.collapse(n["text"]))


def text_of(dom: Column, node: Column, joiner: str = "") -> Column:
    """All text below a node; null for no node."""
    return F.when(node.isNotNull(), F.array_join(strings(inside(dom, node)), joiner))


def texts_of(dom: Column, nodes: Column, joiner: str = "") -> Column:
    return F.transform(nodes, lambda n: text_of(dom, n, joiner))


def blocks(dom: Column) -> Column:
    """Texts between block-level tags, in page order."""
    return F.transform(dom["blocks"], lambda b: b["text"])


def labelled(dom: Column, label: str) -> Column:
    """Text of the element that directly holds the first text with the label; null when absent."""
    hit = first(F.filter(dom["nodes"], lambda n: (n["tag"] == "#text") & n["text"].contains(label)))
    return let(hit, lambda n: F.when(n["up"] >= 0, text_of(dom, F.get(dom["nodes"], n["up"]))).otherwise(text.collapse(n["text"])))


def meta(dom: Column, key: str) -> Column:
    """Content of the first meta element whose name or property is ``key``; null when absent or blank."""
    own = F.filter(dom["nodes"], lambda n: (n["tag"] == "meta") & ((F.lower(n["attrs"]["name"]) == key) | (F.lower(n["attrs"]["property"]) == key)))
    return text.blank_to_null(first(own)["attrs"]["content"])
