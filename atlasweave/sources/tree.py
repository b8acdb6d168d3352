"""Tables and repeated blocks of pages by their elements, so that what is nested ends where its own tag ends.

A page is scanned once, in a task, with a stack of open tags; its rows leave with the keys of the page, so nothing is
shuffled. Time and memory go with the page's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript"))
_INLINE = frozenset("a abbr b bdi cite code em font i kbd mark q s samp small span strong sub sup time u var".split())
#: An opening tag ends open elements of these tags, as far as the nearest of those that hold them.
_ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), {"tr", "td", "th"})
_HOLDS = frozenset(("table", "ul", "ol", "dl", "select"))


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    up: int  # the nearest wanted element around it, by place in the page, or -1
    start: int
    end: int = -1
    first: dict[str, str] = field(default_factory=dict)

    @property
    def classes(self) -> set[str]:
        return set(self.attributes.get("class", "").split())


class Scan(HTMLParser):
    """The wanted elements of a page in its order."""

    def __init__(self, source: str, wanted: Callable[[str, dict[str, str]], bool]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.found, self.pieces = wanted, [], []
        self._open: list[tuple[str, Element | None]] = []
        self._around: list[int] = []
        self._hidden = 0
        self.feed(source)
        self.close()
        self._end(0)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections of other languages are skipped as comments are."""
        return self.rawdata.find(">", i) + 1 or -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = _ENDS.get(tag)
        if ends:
            last = None
            for depth in range(len(self._open) - 1, -1, -1):
                name = self._open[depth][0]
                if name in _HOLDS:
                    break
                if name in ends:
                    last = depth
            if last is not None:
                self._end(last)
        if tag not in _INLINE:
            self.pieces.append(" ")
        element, named = None, {}
        for name, value in attrs:
            named.setdefault(name, value or "")
        if self.wanted(tag, named):
            element = Element(tag, named, self._around[-1] if self._around else -1, len(self.pieces))
            if tag in _VOID:
                element.end = element.start
            else:
                self._around.append(len(self.found))
            self.found.append(element)
        if tag not in _VOID:
            self._open.append((tag, element))
            self._hidden += tag in _HIDDEN

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            name = self._open[depth][0]
            if name == tag:
                self._end(depth)
                break
            if name == "table" and tag not in ("body", "html"):  # a cell's stray end tag leaves the page around its table open
                break
        if tag not in _INLINE:
            self.pieces.append(" ")

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self.pieces.append(data)

    def _end(self, depth: int) -> None:
        for name, element in self._open[depth:]:
            self._hidden -= name in _HIDDEN
            if element is not None:
                element.end = len(self.pieces)
                self._around.pop()
        del self._open[depth:]

    def text(self, element: Element) -> str:
        return " ".join("".join(self.pieces[element.start : element.end]).split())


def _tables(source: str) -> list[tuple[int, int, str, str]]:
    """(table, row, field, value); fields are named by the table's first row."""
    scan = Scan(source, lambda tag, _: tag in ("table", "tr", "td", "th"))
    cells: dict[int, list[str]] = {}
    rows: dict[int, list[int]] = {}
    for place, element in enumerate(scan.found):
        if element.tag == "tr":
            rows.setdefault(element.up, []).append(place)
            cells[place] = []
        elif element.tag != "table" and element.up in cells:
            cells[element.up].append(scan.text(element))
    out = []
    for table, below in enumerate(rows.values()):
        header, *body = (cells[r] for r in below)
        for row, values in enumerate(body):
            out += [(table, row, name, values[k] if k < len(values) else "") for k, name in enumerate(header)]
    return out


def _blocks(source: str, classes: tuple[str, ...], block_tags: frozenset[str], fields: dict[str, tuple[str, ...]]) -> list[tuple[int, str, str, str, dict[str, str]]]:
    """(pos, class, text, href, fields) of the blocks of the first class that the page has."""
    kinds: dict[str, list[str]] = {}
    for name, selectors in fields.items():
        for selector in selectors:
            kinds.setdefault(selector, []).append(name)

    def kind_of(tag: str, own: set[str]) -> str | None:
        return next((c for c in classes if c in own), None) if tag in block_tags else None

    def wanted(tag: str, attributes: dict[str, str]) -> bool:
        own = attributes.get("class", "").split()
        return tag == "a" or tag in kinds or any("." + c in kinds for c in own) or kind_of(tag, set(own)) is not None or "data-lat" in attributes or "data-lng" in attributes

    scan = Scan(source, wanted)
    present = {k for e in scan.found if (k := kind_of(e.tag, e.classes))}
    chosen = next((c for c in classes if c in present), None)
    if chosen is None:
        return []
    # From the last element to the first, each hands its fields up, so an element around gets those of its first one.
    for place in range(len(scan.found) - 1, -1, -1):
        element = scan.found[place]
        own = element.first | {f"@{k}": element.attributes[f"data-{k}"] for k in ("lat", "lng") if f"data-{k}" in element.attributes}
        own_kinds = [n for s in (element.tag, *("." + c for c in element.classes)) for n in kinds.get(s, ())]
        if own_kinds:
            text = scan.text(element)
            own |= dict.fromkeys(own_kinds, text)
        if element.tag == "a" and element.attributes.get("href", "").startswith("http"):
            own["@href"] = element.attributes["href"]
        if element.up >= 0:
            scan.found[element.up].first |= own
        if kind_of(element.tag, element.classes) != chosen:
            element.first = {}
        else:
            element.first |= {k: v for k, v in own.items() if k in ("@lat", "@lng")}
    found = [e for e in scan.found if kind_of(e.tag, e.classes) == chosen]
    return [(pos, chosen, scan.text(e), e.first.get("@href", ""), {k: v for k, v in e.first.items() if k != "@href"}) for pos, e in enumerate(found)]


def _items(source: str, tag: str) -> list[tuple[int, int, str, dict[str, str]]]:
    scan = Scan(source, lambda name, _: name == tag)
    return [(pos, e.up, scan.text(e), e.attributes) for pos, e in enumerate(scan.found)]


def _scanned(pages: DataFrame, html_col: str, keys: list[str], made: str, scan: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows that scan gives of each page, with the page's keys; a page that is null or has none gives no row."""
    ship(pages.sparkSession)
    added = T._parse_datatype_string(made)
    names, types = [f.name for f in added], [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
    arrow = [types[{"bigint": 0, "string": 1}.get(f.dataType.simpleString(), 2)] for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                taken, rows = [], []
                for k, source in enumerate(part.column(len(keys)).to_pylist()):
                    found = scan(source or "")
                    rows += found
                    taken += [k] * len(found)
                columns = [part.column(i).take(pa.array(taken, pa.int64())) for i in range(len(keys))]
                columns += [pa.array([list(r[i].items()) if isinstance(r[i], dict) else r[i] for r in rows], t) for i, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *names])

    chosen = pages.select(*keys, F.col(html_col).cast("string").alias("__source"))
    return chosen.mapInArrow(run, T.StructType([*[chosen.schema[k] for k in keys], *added.fields]))


def tables(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """(key, table, row, field, value) of all tables, each with its own header row; a table in a cell is one more table.

    Cells that a row lacks are '', those beyond the header are left out, a table of one row has none.
    """
    return _scanned(pages, html_col, [key], "table bigint, row bigint, field string, value string", _tables)


def blocks(pages: DataFrame, classes: tuple[str, ...], fields: dict[str, tuple[str, ...]], html_col: str = "html", key: str = "page_id", tags: tuple[str, ...] = ("div", "li", "tr", "section", "article")) -> DataFrame:
    """(key, pos, kind, text, href, fields) of the blocks of the first of the classes that a page has.

    A field is the text of the first element inside that has one of the field's tags or .classes; href is the first
    absolute link; @lat and @lng are of data attributes. A block inside a block is one more block, and part of the outer.
    """
    names, held = tuple(classes), frozenset(tags)
    return _scanned(pages, html_col, [key], "pos bigint, kind string, text string, href string, fields map<string,string>", lambda source: _blocks(source, names, held, fields))


def elements(pages: DataFrame, tag: str, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, up, text, attributes) of all elements of a tag in page order; up is the nearest one around it, or -1."""
    return _scanned(pages, html_col, [key], "pos bigint, up bigint, text string, attributes map<string,string>", lambda source: _items(source, tag))
