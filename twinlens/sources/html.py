"""Raw HTML to tables: a small element scanner, and DataFrame rules over its rows.

The scanner turns one page into one row per element and decides nothing. What is a block,
a link, a price or a region is decided by column expressions below.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.prices import scan_currency
from twinlens.functions.text import collapse_space
from twinlens.functions.urls import canonicalize, classify_href, in_origins, resolve_href, serialize_url

# Element groups the rules refer to.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = tuple("h1 h2 h3 h4 h5 h6 p li td th dt dd blockquote figcaption".split())
HEADINGS = BLOCKS[:6]
PRICE_SOURCES = ("jsonld", "microdata", "selector", "text")
MACHINE = ("script", "style", "noscript", "template")
CARRIERS = ("img", "button", "select", "textarea")
CONTROLS = ("button", "summary", "label", "select", "textarea")
SKIP_GENERIC = ("a", "script", "style", "noscript", "template", "option", "title", "br")
SECTIONING = ("article", "aside", "main", "nav", "section")
ROLE_REGIONS = {
    "banner": "header", "navigation": "nav", "contentinfo": "footer", "complementary": "aside", "main": "main",
}
# Name hints for pages without landmarks, most specific first.
REGION_HINTS = (
    ("nav", "(^| )(nav|navbar|menu|topnav|mainnav)( |$)|navigation|breadcrumb"),
    ("footer", "(^| )(footer|foot)( |$)|footer|colophon"),
    ("aside", "(^| )(aside|rail|secondary)( |$)|sidebar|complementary"),
    ("header", "(^| )(header|banner|topbar)( |$)|header|masthead"),
    ("main", "(^| )(main|content|body|primary|article)( |$)|maincontent"),
)
# Start tags that end an open element of these kinds.
_P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
_PARTS = ("thead", "tbody", "tfoot")
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
             "tr": {"tr", "td", "th"}, "option": {"option"}, **{p: {*_PARTS, "tr", "td", "th"} for p in _PARTS}}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"},
           "tr": {"table", *_PARTS}, "option": {"select"}, **{p: {"table"} for p in _PARTS}}

KEYS = ("side", "path")
# Elements and bytes of page text at which a batch of scanned pages is handed on.
BATCH_ROWS = 1 << 12
BATCH_TEXT = 1 << 22
_BRIEF = "struct<tag:string,class:string,id:string>"
ELEMENTS_DDL = (
    "pos int, exit int, parent int, tag string, attrs map<string,string>, runs array<string>, text_from int, text_to int, parent_from int, "
    f"parent_to int, child_index int, tag_index int, table_row int, carries boolean, trail array<{_BRIEF}>, page_text binary"
)


class _Elements(HTMLParser):
    """Elements of one page in document order, as lists by column.

    An element is an interval: `pos` is its number, `exit` the number after its last descendant's. Its text is a range of
    bytes of the page's text. So the rows of a page take room in proportion to the page, however deep it nests.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[dict] = []
        self.open: Counter[str] = Counter()
        self.pieces: list[bytes] = []
        self.size = self.carriers = self.machines = 0

    def _write(self, piece: str) -> None:
        raw = piece.encode("utf-8", "replace")
        self.pieces.append(raw)
        self.size += len(raw)

    def handle_starttag(self, tag, attrs):
        if tag in _P_ENDERS:
            self._close({"p"}, {"body", "td", "th", "li", "div", "button"})
        if tag in _SIBLINGS:
            self._close(_SIBLINGS[tag], _SCOPES[tag])
        parent = self.stack[-1] if self.stack else None
        a = {k: v or "" for k, v in attrs}
        if self.stack and (tag == "br" or tag in BLOCKS or tag in _P_ENDERS):
            self._write("\n")
        here = parent if parent and parent["tag"] not in ("html", "body") else None
        row = {
            "pos": len(self.rows), "parent": parent["pos"] if parent else -1, "tag": tag, "attrs": a, "runs": [], "kids": 0, "tag_kids": {},
            "child_index": parent["kids"] if parent else 0, "tag_index": parent["tag_kids"].get(tag, 0) if parent else 0,
            "text_from": self.size, "trail": [{"tag": r["tag"], "class": r["attrs"].get("class", ""), "id": r["attrs"].get("id", "")} for r in ([here, here["above"]] if here else []) if r],
            "above": here, "table": self._table_of(tag, parent), "table_row": -1,
        }
        if parent:
            parent["kids"] += 1
            parent["tag_kids"][tag] = parent["tag_kids"].get(tag, 0) + 1
        self.carriers += tag in CARRIERS or (tag == "a" and "href" in a) or a.get("role") == "button"
        row["carried"] = self.carriers
        self.rows.append(row)
        self.stack.append(row)
        self.open[tag] += 1
        self.machines += tag in MACHINE
        if tag in VOID:
            self._leave(len(self.stack) - 1)

    def _table_of(self, tag: str, parent: dict | None) -> tuple[int, int] | None:
        """For a table row, its table and the part of it: head, body, foot."""
        part = {"thead": 0, "tfoot": 2}.get(parent["tag"], 1) if parent else 1
        if parent and parent["tag"] in _PARTS:
            parent = self.rows[parent["parent"]] if parent["parent"] >= 0 else None
        return (parent["pos"], part) if tag == "tr" and parent and parent["tag"] == "table" else None

    def _leave(self, depth: int) -> None:
        """Close the open elements from `depth` on."""
        for row in self.stack[depth:]:
            row["exit"], row["text_to"], row["carries"] = len(self.rows), self.size, self.carriers > row["carried"]
            self.open[row["tag"]] -= 1
            self.machines -= row["tag"] in MACHINE
        del self.stack[depth:]

    def handle_endtag(self, tag):
        if self.open[tag] > 0:
            self._leave(next(d for d in range(len(self.stack) - 1, -1, -1) if self.stack[d]["tag"] == tag))

    def handle_data(self, data):
        if self.stack:
            self.stack[-1]["runs"].append(data)
            if not self.machines:
                self._write(data)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        if not any(self.open[tag] > 0 for tag in tags):
            return
        found = None
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth]["tag"]
            if name in tags:
                found = depth
            elif name in stop:
                break
        if found is not None:
            self._leave(found)

    def result(self, names: Sequence[str]) -> dict[str, list]:
        self._leave(0)
        tables: dict[int, list[tuple[int, int]]] = {}
        for row in self.rows:
            if row["table"]:
                tables.setdefault(row["table"][0], []).append((row["table"][1], row["pos"]))
        number = {pos: i for members in tables.values() for i, (_, pos) in enumerate(sorted(members))}
        for row in self.rows:
            parent = self.rows[row["parent"]] if row["parent"] >= 0 else None
            row["parent_from"], row["parent_to"] = (parent["text_from"], parent["text_to"]) if parent else (0, 0)
            row["page_text"] = None
            if row["tag"] in ("td", "th") and parent:
                row["table_row"] = number.get(parent["pos"], -1)
        if self.rows:
            self.rows[0]["page_text"] = b"".join(self.pieces)
        return {name: [row[name] for row in self.rows] for name in names}


def elements(pages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per element of each page: an interval of element numbers and a range of the page's text.

    The first row of a page carries its text; `page_texts` and `inner_text` bring ranges back as text. `table_row` is a
    cell's row in its table (heads before bodies before feet), or -1; `trail` names the nearest two elements around.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = list(keys)
    schema = pages.sparkSession.createDataFrame([], ELEMENTS_DDL).schema
    names = schema.names
    types = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            rows: dict[str, list] = {n: [] for n in names}
            size = 0
            for i, page in enumerate(batch.column("html")):
                parser = _Elements()
                parser.feed(page.as_py() or "")
                parser.close()
                for name, values in parser.result(names).items():
                    rows[name] += values
                owner += [i] * len(parser.rows)
                size += parser.size
                # Small pages share a batch: one of their own costs more than the parsing.
                if i + 1 == batch.num_rows or len(owner) >= BATCH_ROWS or size >= BATCH_TEXT:
                    rows["attrs"] = [list(a.items()) for a in rows["attrs"]]
                    made = [pa.array(rows[n], types.field(n).type) for n in names]
                    at = pa.array(owner, pa.int32())
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *made], names=[*keys, *names])
                    owner, rows, size = [], {n: [] for n in names}, 0

    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    ddl = ", ".join([f"`{k}` {fields[k]}" for k in keys]) + ", " + ELEMENTS_DDL
    return pages.select(*keys, "html").mapInArrow(scan, schema=ddl)


def own_text() -> Column:
    return F.array_join("runs", "")


def page_texts(raw: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The text of each page, from its first element; element rows refer to ranges of it."""
    return raw.where(F.col("page_text").isNotNull()).select(*keys, F.col("page_text").alias("_page"))


def inner_text(df: DataFrame, texts: DataFrame, keys: Sequence[str] = KEYS, low: str = "text_from", high: str = "text_to", out: str = "inner_text") -> DataFrame:
    """Add the text between two places of the page. Machine-only elements have their own text only."""
    part = F.substring(F.col("_page"), F.col(low) + 1, F.col(high) - F.col(low)).cast("string")
    text = F.when(F.col("tag").isin(*MACHINE), own_text()).otherwise(F.coalesce(part, F.lit("")))
    return df.join(texts, list(keys), "left").withColumn(out, text).drop("_page")


def enclosing(df: DataFrame, marks: dict[str, Column], nearest: dict[str, Column] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add `in_<mark>`: how many marked elements an element stands in, itself included; and values of the nearest one.

    `nearest` names a mark and the value that its elements pass down; it is added as `near_<mark>`. Intervals nest, so
    the marked elements around one are those that have begun less those that have ended, two running sums; and the last
    one that began at that count is the nearest. Both are windows over one page.
    """
    keys, names, nearest = list(keys), list(marks), nearest or {}
    rest = [c for c in df.columns if c not in keys]
    flagged = df.withColumns({f"_is_{n}": F.coalesce(cond, F.lit(False)).cast("int") for n, cond in marks.items()})
    # A marked element also has an event at its end, one that comes before an element that begins there.
    event = lambda at, kind: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"))
    marked = reduce(lambda x, y: x | y, [F.col(f"_is_{n}") == 1 for n in names])
    events = flagged.withColumn("_event", F.explode(F.when(marked, F.array(event("pos", 1), event("exit", 0))).otherwise(F.array(event("pos", 1)))))
    begins = F.col("_event.kind") == 1
    events = events.select(
        *keys, "_event", F.when(begins, F.struct(*rest)).alias("_row"), *[F.when(begins, F.col(f"_is_{n}")).otherwise(-F.col(f"_is_{n}")).alias(f"_is_{n}") for n in names]
    )
    until = Window.partitionBy(*keys).orderBy("_event").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumns({f"in_{n}": F.sum(f"_is_{n}").over(until) for n in names}).where(begins)
    # The keys stay the columns that the rows are dealt by, so the windows below only sort.
    columns = [F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    counted = counted.select(*columns, *[f"in_{n}" for n in names], *[f"_is_{n}" for n in nearest])
    for name, value in nearest.items():
        before = Window.partitionBy(*keys, f"in_{name}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        passed = F.struct(value.alias("v"))
        counted = counted.withColumn(f"near_{name}", F.last(F.when(F.col(f"_is_{name}") == 1, passed), True).over(before)["v"])
    return counted.drop(*[f"_is_{n}" for n in nearest])


def is_landmark() -> Column:
    role = F.lower(F.coalesce(F.col("attrs")["role"], F.lit("")))
    return F.col("tag").isin("header", "nav", "main", "footer", "aside") | role.isin(*ROLE_REGIONS)


def identity_tokens(class_name: Column, element_id: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.concat(class_name, F.lit(" "), element_id)), "[^a-z0-9]+", " "))


def region_from_identity(class_name: Column, element_id: Column) -> Column:
    """Region hinted at by class and id words, or NULL; the first hint to match wins."""
    tokens = identity_tokens(class_name, element_id)
    out = F
    for region, pattern in REGION_HINTS:
        out = out.when(tokens.rlike(pattern), F.lit(region))
    return F.when(tokens != "", out.otherwise(F.lit(None)))


def in_role() -> Column:
    return F.lower(F.coalesce(F.col("attrs")["role"], F.lit("")))


def annotate(raw: DataFrame, ignore_selectors: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """Add what stands around each element: `region`, `ignored`, the nearest card and scope, and counts of kinds.

    The region is that of the nearest landmark; class and id are consulted only on pages without any. An element is
    ignored inside machine-only content and inside an element that one of the selectors names.
    """
    keys = list(keys)
    attr = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    scope = F.map_contains_key("attrs", "itemscope")
    card = scope | F.col("tag").isin("article", "li", "tr") | F.arrays_overlap(F.split(attr("class"), r"\s+"), F.array(F.lit("product"), F.lit("card")))
    ignored = reduce(lambda x, y: x | y, [matches_selector(selector) for selector in ignore_selectors], F.col("tag").isin(*MACHINE))
    marks = {
        "section": F.col("tag").isin(*SECTIONING), "ignored": ignored, "block": F.col("tag").isin(*BLOCKS), "body": F.col("tag") == "body",
        "link": (F.col("tag") == "a") & F.map_contains_key("attrs", "href"), "list": F.col("tag").isin("ul", "ol", "dl"), "card": card, "scope": scope,
    }
    ranges = F.struct(F.col("text_from").alias("low"), F.col("text_to").alias("high"))
    df = enclosing(raw.drop("page_text"), marks, {"card": ranges, "scope": F.col("pos")}, keys)
    landmarks = F.max(F.coalesce(is_landmark(), F.lit(False))).over(Window.partitionBy(*keys))
    roles = F.create_map(*[F.lit(x) for kv in ROLE_REGIONS.items() for x in kv])
    page_level = F.col("in_section") == F.col("tag").isin(*SECTIONING).cast("int")
    own = (
        F.when(in_role().isin(*ROLE_REGIONS), F.element_at(roles, in_role()))
        .when(F.col("tag").isin("nav", "aside", "main"), F.col("tag"))
        .when(F.col("tag").isin("header", "footer") & page_level, F.col("tag"))
        .when(~F.col("_landmarks"), region_from_identity(attr("class"), attr("id")))
    )
    df = df.withColumn("_landmarks", landmarks).withColumn("_region", F.when(F.col("tag") != "html", own))
    df = enclosing(df, {"region": F.col("_region").isNotNull()}, {"region": F.col("_region")}, keys)
    above = lambda n, own: (F.col(f"in_{n}") > F.when(own, 1).otherwise(0))
    return df.withColumns(
        {
            "region": F.coalesce("near_region", F.lit("other")), "ignored": F.col("in_ignored") > 0, "lists": F.col("in_list") - F.col("tag").isin("ul", "ol", "dl").cast("int"),
            "in_blocks": above("block", F.col("tag").isin(*BLOCKS)), "in_link": F.col("in_link") > 0, "in_body": above("body", F.col("tag") == "body"),
        }
    ).drop("in_section", "in_ignored", "in_block", "in_list", "in_card", "in_scope", "in_region", "near_region", "_landmarks", "_region")


def kept(annotated: DataFrame) -> DataFrame:
    """Elements outside machine-only content and outside what is to be ignored."""
    return annotated.where(~F.col("ignored"))


def matches_selector(selector: str) -> Column:
    """Simple selector on an element: tag, .class, #id or [attr] / [attr=value], combined."""

    cond = F.lit(True)
    for kind, name, attr, value in re.findall(r'([.#]?)([\w-]+)|\[([\w-]+)(?:=["\']?([^"\'\]]*)["\']?)?\]', selector):
        if attr:
            here = F.map_contains_key("attrs", attr)
            cond = cond & (here & (F.col("attrs")[attr] == value) if value else here)
        elif kind == ".":
            cond = cond & F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), name)
        elif kind == "#":
            cond = cond & (F.coalesce(F.col("attrs")["id"], F.lit("")) == name)
        else:
            cond = cond & (F.col("tag") == name.lower())
    return cond


def is_visible() -> Column:
    style = F.lower(F.regexp_replace(F.coalesce(F.col("attrs")["style"], F.lit("")), r"\s+", ""))
    hidden = F.map_contains_key("attrs", "hidden") | style.rlike("display:none|visibility:hidden|(^|;)opacity:0(;|$)")
    return ~hidden


def selector_hint() -> Column:
    """Up to three levels, nearest last, stopping at an id, with at most two classes each."""
    me = F.struct(F.col("tag"), F.coalesce(F.col("attrs")["class"], F.lit("")).alias("class"), F.coalesce(F.col("attrs")["id"], F.lit("")).alias("id"))
    chain = F.when(F.col("tag").isin("body", "html"), F.array().cast(f"array<{_BRIEF}>")).otherwise(F.concat(F.array(me), F.col("trail")))
    near = F.slice(chain, 1, 3)
    with_id = F.filter(F.transform(near, lambda n, i: F.when(n["id"] != "", i)), lambda i: i.isNotNull())
    cut = F.when(F.size(with_id) > 0, F.slice(near, F.lit(1), F.get(with_id, F.lit(0)) + 1)).otherwise(near)

    def part(n: Column) -> Column:
        classes = F.slice(F.filter(F.split(F.trim(n["class"]), r"\s+"), lambda c: c != ""), 1, 2)
        suffix = F.when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(classes, "."))).otherwise(F.lit(""))
        return F.concat(n["tag"], F.when(n["id"] != "", F.concat(F.lit("#"), n["id"])).otherwise(suffix))

    return F.array_join(F.reverse(F.transform(cut, part)), " > ")


def is_block() -> Column:
    """Text-bearing block that is not nested in another and does more than wrap a link or image."""
    wrapper = (F.trim(collapse_space(own_text())) == "") & F.col("carries")
    return F.col("tag").isin(*BLOCKS) & ~F.col("in_blocks") & ~wrapper


def block_kind() -> Column:
    return (
        F.when(F.col("tag").isin(*HEADINGS), F.lit("heading"))
        .when(F.col("tag").isin("li", "dt", "dd"), F.lit("listItem"))
        .when(F.col("tag").isin("td", "th"), F.lit("tableCell"))
        .otherwise(F.lit("paragraph"))
    )


def with_captured(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The elements that bear content, with `captured`: block or generic.

    Blocks are taken first; other elements with text of their own only if no element around them is taken.
    """
    own = collapse_space(own_text()) != ""
    generic = own & ~F.col("tag").isin(*SKIP_GENERIC) & ~F.col("in_link") & F.col("in_body")
    df = df.withColumn("_block", is_block())
    marks = enclosing(df.where(F.col("_block") | generic), {"taken": F.lit(True)}, keys=keys)
    captured = F.when(F.col("_block"), F.lit("block")).when(F.col("in_taken") == 1, F.lit("generic"))
    return marks.withColumn("captured", captured).where(F.col("captured").isNotNull()).drop("_block", "in_taken")


def raw_nodes(df: DataFrame, texts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Content elements in reading passes: blocks, generic text, links, images; `pos` orders them.

    `df` is what `annotate` returns, without what is to be ignored; `texts` is `page_texts` of the scanned elements.
    """
    keys = list(keys)
    common = [*keys, "region", selector_hint().alias("selector_hint"), is_visible().alias("visible")]
    int_or = lambda name, default: F.coalesce(F.col("attrs")[name].try_cast("int"), F.lit(default))
    none = lambda kind: F.lit(None).cast(kind)
    order = lambda run: (F.lit(run).cast("bigint") * F.lit(1 << 30) + F.col("pos")).alias("pos")
    anchor = (F.col("tag") == "a") & F.map_contains_key("attrs", "href")
    links = df.where(anchor).withColumn("captured", F.lit("link"))
    captured = inner_text(with_captured(df, keys).unionByName(links), texts, keys)
    kind = F.when(F.col("captured") == "block", block_kind()).when(F.col("captured") == "link", F.lit("link")).when(
        F.col("tag").isin(*CONTROLS) | (F.lower(F.coalesce(F.col("attrs")["role"], F.lit(""))) == "button"),
        F.lit("control"),
    ).otherwise(F.lit("paragraph"))
    block, link = F.col("captured") == "block", F.col("captured") == "link"
    label = F.trim(F.col("inner_text"))
    found = captured.select(
        *common, F.when(block, order(0)).when(link, order(2)).otherwise(order(1)).alias("pos"), kind.alias("kind"),
        F.when(block, F.col("inner_text"))
        .when(link & (label != ""), label).when(link, F.coalesce(F.col("attrs")["aria-label"], F.lit("")))
        .otherwise(own_text()).alias("text"),
        F.when(block & F.col("tag").isin(*HEADINGS), F.substring("tag", 2, 1).cast("int")).alias("level"),
        F.when(link, F.col("attrs")["href"]).alias("href"), none("string").alias("src"), none("string").alias("alt"),
        none("int").alias("natural_width"), none("int").alias("natural_height"),
        F.when(block & (kind == "listItem"), F.col("lists").cast("int")).alias("depth"),
        F.when(block & (kind == "tableCell"), F.col("table_row")).alias("row"),
        F.when(block & (kind == "tableCell"), F.col("child_index")).alias("col"),
    )
    pictures = df.where(F.col("tag") == "img").select(
        *common, order(3), F.lit("image").alias("kind"), F.coalesce(F.col("attrs")["alt"], F.lit("")).alias("text"),
        none("int").alias("level"), none("string").alias("href"),
        F.coalesce(F.col("attrs")["src"], F.lit("")).alias("src"), F.coalesce(F.col("attrs")["alt"], F.lit("")).alias("alt"),
        int_or("width", 0).alias("natural_width"), int_or("height", 0).alias("natural_height"),
        none("int").alias("depth"), none("int").alias("row"), none("int").alias("col"),
    )
    return found.unionByName(pictures)


def link_records(df: DataFrame, texts: DataFrame, page_urls: DataFrame, allowed_origins: Sequence[str]) -> DataFrame:
    """Links of each page: resolved, classified, one row per href and region; visible if any is."""
    anchors = inner_text(df.where((F.col("tag") == "a") & F.map_contains_key("attrs", "href")), texts).select(
        "side", "path", "pos", F.col("attrs")["href"].alias("href"), collapse_space(F.col("inner_text")).alias("text"),
        "region", is_visible().alias("visible"),
    )
    grouped = anchors.groupBy("side", "path", "href", "region").agg(
        F.bool_or("visible").alias("visible"), F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos")
    )
    return resolve_links(grouped.join(page_urls, ["side", "path"]), allowed_origins)


def resolve_links(links: DataFrame, allowed_origins: Sequence[str]) -> DataFrame:
    """Add `resolved`, `kind` and `link_path` to rows with `href` and `page_url`."""

    df = links.withColumn("resolved", resolve_href(F.col("href"), F.col("page_url")))
    allowed = in_origins(F.col("resolved"), allowed_origins) if allowed_origins else F.lit(True)
    df = df.withColumn("kind", classify_href(F.col("href"), F.col("page_url"), allowed))
    df = canonicalize(serialize_url(df, "resolved", "resolved"), "resolved", prefix="l")
    return df.withColumn("link_path", F.when(F.col("kind") == "internal", F.col("l_key"))).drop(
        *[f"l_{c}" for c in ("origin", "path", "search", "hash", "key", "href")]
    )


def image_rows(df: DataFrame) -> DataFrame:
    """`img` elements and inline background images. An element may be both, so each has a position of its own."""
    common = lambda backdrop: [
        "side", "path", (F.col("pos").cast("bigint") * 2 + backdrop).alias("pos"), "region", is_visible().alias("visible")
    ]
    size = lambda name: F.coalesce(F.col("attrs")[name].try_cast("int"), F.lit(0))
    shown = df.where(F.col("tag") == "img").select(
        *common(0), F.coalesce(F.col("attrs")["src"], F.lit("")).alias("src"),
        F.coalesce(F.col("attrs")["alt"], F.lit("")).alias("alt"), size("width").alias("natural_width"),
        size("height").alias("natural_height"), F.lit(False).alias("is_background"),
    )
    url = F.regexp_extract(F.col("attrs")["style"], r"background(?:-image)?\s*:[^;]*url\((['\"]?)(.*?)\1\)", 2)
    backdrop = df.where(F.coalesce(url, F.lit("")) != "").select(
        *common(1), url.alias("src"), F.lit("").alias("alt"), F.lit(0).alias("natural_width"),
        F.lit(0).alias("natural_height"), F.lit(True).alias("is_background"),
    )
    return shown.unionByName(backdrop)


def page_meta(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Title, description, canonical, robots, lang and social fields of each page; first one wins."""
    attr = lambda name: F.col("attrs")[name]
    field = (
        F.when(F.col("tag") == "title", F.struct(F.lit("title").alias("k"), collapse_space(F.col("inner_text")).alias("v")))
        .when(F.col("tag") == "html", F.struct(F.lit("lang").alias("k"), attr("lang").alias("v")))
        .when(
            (F.col("tag") == "link") & (attr("rel") == "canonical"),
            F.struct(F.lit("canonical").alias("k"), attr("href").alias("v")),
        )
        .when(
            (F.col("tag") == "meta") & attr("name").isin("description", "robots"),
            F.struct(attr("name").alias("k"), F.trim(attr("content")).alias("v")),
        )
        .when(
            (F.col("tag") == "meta") & attr("property").isin("og:title", "og:description", "og:image"),
            F.struct(F.regexp_replace(attr("property"), ":", "_").alias("k"), F.trim(attr("content")).alias("v")),
        )
    )
    df = inner_text(df.where(F.col("tag").isin("title", "html", "link", "meta")), texts)
    rows = df.select("side", "path", "pos", field.alias("f")).where(F.col("f").isNotNull())
    names = ["title", "description", "canonical", "robots", "lang", "og_title", "og_description", "og_image"]
    pick = lambda n: F.min_by(F.when(F.col("f.k") == n, F.col("f.v")), F.when(F.col("f.k") == n, F.col("pos")))
    return rows.groupBy("side", "path").agg(*[pick(n).alias(n) for n in names])


def price_context(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Add `context`: text of the nearest card-like element around, else of the parent, in full."""
    near = F.col("near_card")
    df = df.withColumns({"_low": F.coalesce(near["low"], F.col("parent_from")), "_high": F.coalesce(near["high"], F.col("parent_to"))})
    part = F.substring(F.col("_page"), F.col("_low") + 1, F.col("_high") - F.col("_low")).cast("string")
    short = F.regexp_replace(F.trim(F.coalesce(part, F.lit(""))), r"\s+", " ")
    return df.join(texts, list(KEYS), "left").withColumn("context", short).drop("_page", "_low", "_high")


def _place(sub: Column | int, source: str) -> Column:
    """A position of its own for each row of an element: the element's, then the row's, then the kind of source."""
    below = (F.lit(sub) if isinstance(sub, int) else sub).cast("bigint") * len(PRICE_SOURCES) + PRICE_SOURCES.index(source)
    return F.shiftleft(F.col("pos").cast("bigint"), 24) + below


def _structured_prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per object that names a price, at any depth, in the order of the text."""
    for batch in batches:
        names = ["side", "path", "pos", "sub", "raw", "context", "hint"]
        rows: dict[str, list] = {n: [] for n in names}
        for side, path, pos, text in zip(*(batch.column(n).to_pylist() for n in ("side", "path", "pos", "own_text")), strict=True):
            try:
                # Numbers stay as they are written.
                stack = [json.loads(text or "", parse_float=str, parse_int=str)]
            except (ValueError, RecursionError):
                continue
            sub = 0
            while stack:
                node = stack.pop()
                if isinstance(node, list):
                    stack.extend(reversed(node))
                elif isinstance(node, dict):
                    said = lambda name, node=node: node[name] if isinstance(node.get(name), str) else None
                    raw = next((v for v in map(said, ("price", "lowPrice", "highPrice")) if v is not None), None)
                    if raw is not None:
                        values = (side, path, pos, sub, raw, said("name") or said("@type") or "", said("priceCurrency"))
                        for name, value in zip(names, values, strict=True):
                            rows[name].append(value)
                    sub += 1
                    stack.extend(v for v in reversed(node.values()) if isinstance(v, dict | list))
        kinds = [batch.schema.field("side").type, batch.schema.field("path").type, batch.schema.field("pos").type, pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, kinds, strict=True)], names)


def json_ld_prices(raw: DataFrame) -> DataFrame:
    """Prices in structured data blocks: texts and numbers of objects at any depth.

    The blocks are read once; a block that is no JSON, or nests beyond what the reader follows, gives no row.
    """
    scripts = raw.where(
        (F.col("tag") == "script") & (F.lower(F.coalesce(F.col("attrs")["type"], F.lit(""))) == "application/ld+json")
    ).select("side", "path", "pos", own_text().alias("own_text"))
    kinds = {f.name: f.dataType.simpleString() for f in scripts.schema}
    schema = f"side {kinds['side']}, path {kinds['path']}, pos {kinds['pos']}, sub int, raw string, context string, hint string"
    found = scripts.mapInArrow(_structured_prices, schema)
    return found.select(
        "side", "path", _place(F.col("sub"), "jsonld").alias("pos"), "raw", F.lit("jsonld").alias("source"),
        F.lit("other").alias("region"), "context", "hint",
    )


def marked_prices(df: DataFrame, texts: DataFrame, selectors: Sequence[str] = ()) -> DataFrame:
    """Microdata prices with the currency of their scope, and prices under configured selectors."""
    keys = list(KEYS)
    content = F.trim(F.coalesce(F.col("attrs")["content"], F.col("inner_text")))
    prop = F.col("attrs")["itemprop"]
    chosen = reduce(lambda x, y: x | y, [matches_selector(selector) for selector in selectors], prop.isin("price", "priceCurrency"))
    here = price_context(inner_text(df.where(chosen), texts), texts)
    # The currency of a scope is the first one that begins inside it.
    named = here.where(prop == "priceCurrency").select(*keys, "pos", F.lit(0).alias("exit"), F.struct("pos", content.alias("hint")).alias("_said"))
    scopes = df.where(F.map_contains_key("attrs", "itemscope")).select(*keys, "pos", "exit", F.lit(None).cast(named.schema["_said"].dataType).alias("_said"))
    after = Window.partitionBy(*keys).orderBy("pos", F.col("_said").isNull()).rowsBetween(1, Window.unboundedFollowing)
    said = named.unionByName(scopes).withColumn("_next", F.first("_said", True).over(after)).where(F.col("_said").isNull())
    currencies = said.where(F.col("_next.pos") < F.col("exit")).select(*keys, F.col("pos").alias("near_scope"), F.col("_next.hint").alias("hint"))
    micro = here.where((prop == "price") & (content != ""))
    columns = [*keys, _place(0, "microdata").alias("pos"), content.alias("raw")]
    rows = micro.join(currencies, [*keys, "near_scope"], "left").select(
        *columns, F.lit("microdata").alias("source"), "region", "context", "hint"
    )
    for number, selector in enumerate(selectors):
        text = F.trim(F.col("inner_text"))
        rows = rows.unionByName(
            here.where(matches_selector(selector) & (text != "")).select(
                *keys, _place(number, "selector").alias("pos"), text.alias("raw"), F.lit("selector").alias("source"), "region", "context",
                F.lit(None).cast("string").alias("hint"),
            )
        )
    return rows


def text_prices(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Currency-looking runs in every text node."""
    found = df.withColumn("_hits", F.flatten(F.transform("runs", scan_currency))).where(F.size("_hits") > 0)
    rows = price_context(found, texts).select("side", "path", "pos", "region", "context", F.posexplode("_hits").alias("sub", "raw"))
    return rows.select(
        "side", "path", _place(F.col("sub"), "text").alias("pos"), "raw", F.lit("text").alias("source"),
        "region", "context", F.lit(None).cast("string").alias("hint"),
    )
