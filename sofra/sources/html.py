"""Menus in web pages: elements chosen by tag, id and class, dish groups of menu cards, calories of day cards.

Pages are parsed within Arrow batches by the standard library's tokenizer and a stack of open tags that stands what browsers
stand: elements that end where a sibling begins, end tags without a beginning, ends of outer elements that leave inner ones
open, and pages that stop in the middle. Everything after the parse is column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import long_date
from ..functions.guard import contains_any, is_junk
from ..functions.names import web_alternatives
from ..functions.turkish import soft_lower, trim

#: Elements without content; which open ones a tag ends, and where the search for them stops.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("html body table td th ul ol dl article section div button".split())
#: Words that mark a line as a package to take away.
TAKEAWAY = ("al götür", "al-götür", "algötür", "al gotur")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    up: Element | None = None
    texts: list[str] = field(default_factory=list)
    written: list[str] = field(default_factory=list)
    below: list[Element] = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def all(self) -> Iterator[Element]:
        """The elements below, in the order of the page."""
        stack = self.below[::-1]
        while stack:
            e = stack.pop()
            yield e
            stack += e.below[::-1]


class Tree(HTMLParser):
    """Builds elements; each text piece is kept with every element that is open around it, resolved and as it is written.

    It is fed pages in which each & is &amp;, so that the tokenizer gives back what is written."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        tag = tag.replace("&amp;", "&")
        if tag in ENDS:
            self.end(ENDS[tag], SCOPES - {tag})
        if tag in BLOCKS:
            self.end(("p",), SCOPES)
        e = Element(tag, {}, self.open[-1])
        for k, v in attrs:
            e.attrs.setdefault(k.replace("&amp;", "&"), unescape(v or ""))
        self.open[-1].below.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        tag = tag.replace("&amp;", "&")
        if any(e.tag == tag for e in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def end(self, tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        """Close the innermost open element of the tags, unless a scope lies between."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in scopes:
                return

    def handle_data(self, data: str) -> None:
        if self.cdata_elem:
            text = data = data.replace("&amp;", "&")
        else:
            text = unescape(data)
        for e in self.open:
            e.texts.append(text)
            e.written.append(data)


def parsed(html: str | None) -> Element:
    """The root of a page; an empty one for a null."""
    tree = Tree()
    tree.feed((html or "").replace("&", "&amp;"))
    tree.close()
    return tree.root


def chosen(root: Element, tag: str | None = None, id: str | None = None, cls: str | None = None) -> Iterator[Element]:
    """Elements below the root with the tag, the id and the class, where given."""
    for e in root.all():
        if (tag is None or e.tag == tag) and (id is None or e.attrs.get("id") == id) and (cls is None or cls in e.classes):
            yield e


def per_page(pages: DataFrame, key: str, html: str, make: Callable[[Element], list[dict]], row: T.StructType) -> DataFrame:
    """key and the rows that make() gives for each parsed page; rows is a small helper's output, one page at a time."""
    schema = T.StructType([T.StructField("key", pages.schema[key].dataType), *row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [{"key": k} | r for k, page in zip(part.column("key").to_pylist(), part.column("html").to_pylist()) for r in make(parsed(page))]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, schema).withColumnRenamed("key", key)


def elements(pages: DataFrame, key: str, html: str, wanted: dict[str, dict[str, str]]) -> DataFrame:
    """(key, name, place, id, classes, text, pieces, written) of the chosen elements of each page: for each name of `wanted` those
    with its tag, id and cls, numbered from 0. pieces are the text nodes, text is all of them in a row; written is the text
    with its character references as they stand in the page."""
    row = T.StructType([T.StructField("name", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("written", T.StringType())])

    def make(root: Element) -> list[dict]:
        return [{"name": name, "place": i, "id": e.attrs.get("id"), "classes": e.classes, "text": "".join(e.texts), "pieces": e.texts, "written": "".join(e.written)} for name, by in wanted.items() for i, e in enumerate(chosen(root, **by))]

    return per_page(pages, key, html, make, row)


def _is_date(e: Element) -> bool:
    return "cardDate" in e.classes or e.tag == "p" and ("date" in e.classes or e.attrs.get("id", "").startswith("date_"))


def _packages(card: Element) -> list[str]:
    """Names of packages in the data and click attributes of a card."""
    out = []
    for e in card.all():
        try:
            items = json.loads(e.attrs.get("data-fastmenus", "[]"))
        except ValueError:
            items = []
        for item in items if isinstance(items, list) else []:
            name = item.get("name", item.get("title")) if isinstance(item, dict) else None
            out.append(name if isinstance(name, str) else "Al Götür")
        if "showFastMenu" in e.attrs.get("onclick", ""):
            out.append(e.attrs["onclick"])
    return out


def _cards(root: Element) -> list[dict]:
    rows = []
    for place, card in enumerate(chosen(root, cls="cardStyle")):
        headers = (s for h in chosen(card, cls="card-header") for s in chosen(h, tag="span"))
        date = next((e for e in card.all() if _is_date(e)), None) or next(headers, None)
        body = next(chosen(card, cls="card-body"), None)
        if date is not None and body is not None:
            lines = [" / ".join(p.texts) for p in chosen(body, tag="p") if "data-fastmenus" not in p.attrs and "showFastMenu" not in p.attrs.get("onclick", "")]
            rows.append({"card": place, "date_text": "".join(date.texts), "lines": lines, "packages": _packages(card)})
    return rows


def dish_groups(lines: Column) -> Column:
    """Lines of a card as arrays of alternatives; junk and lines of which nothing is left go."""
    return F.filter(F.transform(lines, web_alternatives), lambda g: F.size(g) > 0)


def menu_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, card, date, dishes, takeaways) of the menu cards of each page that have a date, a body and a dish.

    A line is a paragraph of the body; line breaks within it and slashes part alternatives, the word for "or" does not.
    takeaways: the lines, data and click attributes that name packages, each once, in order."""
    row = T.StructType([T.StructField("card", T.IntegerType()), T.StructField("date_text", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("packages", T.ArrayType(T.StringType()))])
    raw = per_page(pages, key, html, _cards, row).withColumn("date", long_date(trim(F.col("date_text")))).where("date IS NOT NULL")
    lines = F.filter(F.transform("lines", trim), lambda x: ~is_junk(x))
    taken = lambda x: contains_any(soft_lower(x), TAKEAWAY)
    raw = raw.withColumn("lines", lines)
    out = raw.select(key, "card", "date", dish_groups(F.filter("lines", lambda x: ~taken(x))).alias("dishes"), F.array_distinct(F.concat(F.filter("lines", taken), "packages")).alias("takeaways"))
    return out.where(F.size("dishes") > 0)


def day_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, breakfast, breakfast_kcal, dinner, dinner_kcal) of each page's article cards; null without a card or a dish."""
    fields = [T.StructField(f"{meal}_{what}", kind) for meal in ("breakfast", "dinner") for what, kind in (("items", T.ArrayType(T.StringType())), ("meta", T.StringType()))]

    def make(root: Element) -> list[dict]:
        out: dict = {}
        for meal in ("breakfast", "dinner"):
            card = next(chosen(root, tag="article", id=f"{meal}-card"), None)
            meta = None if card is None else next(chosen(card, cls="menu-card-meta"), None)
            out[f"{meal}_items"] = None if card is None else ["".join(e.texts) for e in chosen(card, cls="menu-item-name")]
            out[f"{meal}_meta"] = None if meta is None else "".join(meta.texts)
        return [out]

    raw = per_page(pages, key, html, make, T.StructType(fields))
    groups = {meal: dish_groups(F.filter(F.transform(f"{meal}_items", trim), lambda x: ~is_junk(x))) for meal in ("breakfast", "dinner")}
    return raw.select(key, *[c for meal, g in groups.items() for c in (F.when(F.size(g) > 0, g).alias(meal), trim(F.col(f"{meal}_meta")).alias(f"{meal}_kcal"))])
