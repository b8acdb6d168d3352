"""Main text of web pages by removal of site templates.

Each element of a page is hashed twice from its leaves up: by content (tags and text) and by shape (tags and classes, runs
of like children taken as one), so that a menu, footer or advert whose words change is still the same shape. Spark counts,
for each host, the distinct main texts beside which a container occurs; containers that recur beside many, and beside a
share of all of the host, are deleted, first of all from the page's root down: by content wherever they are, by shape only
outside the element that holds the main text. The tags and classes of containers outside it are counted alike: where they
recur, counting has judged them, and what it leaves of them stays. Rules (tags, roles and classes that say that they are no
article, and lying outside the articles or the main element) are for the rest: hosts with few pages, chrome that is rare at
its host, and what is inside an article.

Counting main texts instead of pages keeps copies of one page from making its content a template; the share keeps what a
few articles of a large host quote. Lists, tables and figures inside an article are its text like paragraphs, and never
deleted for recurring.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_arrow, slices, staged

#: A subtree is a template's if it occurs beside so many main texts of its host.
RECURS = 5
#: ... and beside this share of the host's distinct main texts.
SHARE = 0.2
#: Template hashes up to this number (8 bytes each) are broadcast; beyond it they are joined to the pages by a shuffle.
FEW_HASHES = 250_000
_SALTS = 32

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.DOTALL)
_OPEN_END = re.compile(r"<[a-zA-Z/!?][^>]*$")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = set("nav header footer aside form script style noscript template iframe textarea title head svg button select dialog menu object canvas".split())
_COUNTED = set("nav ul ol dl div section header footer aside form table script style figure".split())
_NO_TEXT = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "head", "svg", "button", "select", "xmp"}
_PASSAGES = {"ul", "ol", "dl", "table", "figure"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "blockquote", "aside", "nav"}
_CHROME = re.compile(
    r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|widgets?|nav\w*|menus?|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal"
    r"|newsletter|subscribe|share|sharing|social|related|recommended|comments?|respond|reply|replies|disqus|pagination|pager|toolbar|search|login)"
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}


class Node:
    """An element: its children are texts and nodes; form is its tag and classes; content, shape and size (of the text) are
    measured once the tree is whole."""

    __slots__ = ("tag", "form", "dropped", "children", "main", "content", "shape", "size")

    def __init__(self, tag: str, form: str, dropped: bool):
        self.tag, self.form, self.dropped = tag, form, dropped
        self.children: list[Node | str] = []
        self.main = tag in ("article", "main") and not dropped
        self.content = self.shape = self.size = 0


def _form(tag: str, attributes: str) -> str:
    """The tag with its classes in order, without digits, which number posts and the like."""
    if "class" not in attributes.lower():
        return tag
    words = [w for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() == "class" for w in next((v for v in values if v), "").lower().split()]
    return ".".join([tag, *sorted({re.sub(r"\d+", "", w) for w in words})])


def _chrome(tag: str, attributes: str) -> bool:
    if tag in _DROP:
        return True
    if "=" not in attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            if value in _ROLES:
                return True
        elif any(_CHROME.fullmatch(part) for word in value.split() for part in (word, *re.split(r"[-_]+", word))):
            return True
    return False


def parse(source: str) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers take the common cases."""
    root = Node("#root", "#root", False)
    stack, at = [root], 0

    def close(depth: int) -> None:
        for k in range(len(stack) - 1, depth - 1, -1):
            stack[k - 1].main = stack[k - 1].main or stack[k].main
        del stack[depth:]

    position, end_of, last = 0, len(source), source.rfind(">")
    while position < end_of:
        m = _TAG.search(source, position) if position <= last or source.find("<!--", position) >= 0 else None
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = position = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in _BLOCK or tag == "option":
            ends = _CLOSES.get(tag, set())
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth].tag
                if name == "p" and tag in _BLOCK or name in ends:
                    close(depth)
                    if name == "p" and ends:
                        continue
                    break
                if name in _HOLDS or name in ("td", "th", "li") and tag not in _CLOSES:
                    break
        node = Node(tag, _form(tag, attributes), _chrome(tag, attributes))
        stack[-1].children.append(node)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
            inner = stop.start() if stop else end_of
            finish = source.find(">", inner) + 1 if stop else end_of
            at = position = finish or end_of
        else:
            stack.append(node)
    rest = _OPEN_END.sub("", source[at:])
    if rest:
        stack[-1].children.append(rest)
    close(1)
    _measure(root)
    return root


def _walk(node: Node) -> Iterator[Node]:
    """All nodes below, in no order; like the walks below without recursion, as pages nest as deep as they like."""
    waiting = [node]
    while waiting:
        for child in waiting.pop().children:
            if isinstance(child, Node):
                yield child
                waiting.append(child)


def _measure(root: Node) -> None:
    """Content, shape and size of every node, each from those of its children, so in time linear in the page."""
    for node in reversed([root, *_walk(root)]):  # children before their parents
        content, shape, size = [node.tag], [node.form], 0
        for child in node.children:
            if isinstance(child, str):
                words = child.split()
                if not words:
                    continue
                content.append(" ".join(words))
                size += sum(map(len, words))
                mark = "#"
            elif child.tag in _NO_TEXT:
                continue
            else:
                content.append(f"{child.content:x}")
                size += child.size
                mark = f"{child.shape:x}" if child.tag in _BLOCK or child.tag == "a" else "#" if child.size else ""
            if mark and shape[-1] != mark:
                shape.append(mark)
        node.content = xxhash.xxh64_intdigest("\0".join(content).encode("utf-8", "surrogatepass"))
        node.shape = xxhash.xxh64_intdigest("\0".join(shape).encode("utf-8", "surrogatepass"), seed=2)
        node.size = size


def _mains(node: Node) -> list[Node]:
    """The outermost articles, else main elements."""
    found: dict[str, list[Node]] = {"article": [], "main": []}

    waiting = node.children[::-1]
    while waiting:
        child = waiting.pop()
        if isinstance(child, Node) and not (child.dropped and not child.main):
            if child.tag == "article" and not child.dropped:
                found["article"].append(child)
            else:
                if child.tag == "main":
                    found["main"].append(child)
                waiting += reversed(child.children)
    return found["article"] or found["main"]


def _holders(root: Node) -> list[Node]:
    """What holds the main text: articles or main elements, else the smallest element with half of the page's text or more."""
    found = _mains(root)
    if found:
        return found
    at = root
    while True:
        inner = next((c for c in at.children if isinstance(c, Node) and c.size * 2 >= root.size > 0 and not c.dropped), None)
        if inner is None:
            return [at]
        at = inner


def _outside(root: Node, holders: list[Node]) -> set[int]:
    """Containers (by id) that neither hold nor are in the main text: those that may go for their shape."""
    above, waiting, order = {id(h) for h in holders}, [root], []
    within = set(above)
    while waiting:
        node = waiting.pop()
        if id(node) not in within:
            order.append(node)
            waiting += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        if any(isinstance(c, Node) and id(c) in above for c in node.children):
            above.add(id(node))
    return {id(node) for node in order if id(node) not in above and node.tag in _COUNTED}


def _recurs(node: Node, inside: bool, outside: set[int], templates: set[int] | frozenset[int], salt: int) -> bool:
    """Whether a container is a template's; inside an article its lists, tables and figures are not."""
    if node.tag not in _COUNTED or node.main or not templates:
        return False
    return not (inside and node.tag in _PASSAGES) and node.content ^ salt in templates or id(node) in outside and node.shape ^ salt in templates


def _form_hash(node: Node) -> int:
    return xxhash.xxh64_intdigest(node.form.encode("utf-8", "surrogatepass"), seed=3)


def main_text(root: Node, templates: set[int] | frozenset[int], salt: int = 0) -> str:
    """The page's blocks joined by empty lines, in one walk from its root.

    Template subtrees go first. Of what is left, containers outside the main text whose form recurs at the host stay, as
    counting has judged them; others go if they lie outside the articles or if their tag, role or class tells.
    """
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(text)

    mains = {id(m) for m in _mains(root)}
    outside = _outside(root, _holders(root)) if templates else set()
    waiting: list[tuple[Node | str | None, bool, bool]] = [(c, False, not mains) for c in reversed(root.children)]  # None: a block ends
    while waiting:
        child, inside, kept = waiting.pop()
        if child is None:
            flush()
            continue
        if isinstance(child, str):
            if kept:
                parts.append(child)
            continue
        judged = id(child) in outside and _form_hash(child) ^ salt in templates
        told = child.dropped and not child.main and (child.tag in _NO_TEXT or not judged)
        if _recurs(child, inside, outside, templates, salt) or told or child.tag == "br":
            parts.append(" ") if child.tag not in _BLOCK else flush()
            continue
        if child.tag in _BLOCK:
            flush()
            waiting.append((None, inside, kept))
        inside, kept = inside or id(child) in mains, kept or judged or id(child) in mains
        waiting += [(c, inside, kept) for c in reversed(child.children)]
    flush()
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    """The host of a URL in lower case without port and user; empty if there is none."""
    m = re.match(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _host_hash(url: str | None) -> int:
    return xxhash.xxh64_intdigest(host_of(url), seed=1)


def _subtrees(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(page, host, subtree, main) hashes of content and shape, each once a page; a subtree's hash is tied to its host's.

    The page itself is counted as a subtree with the host's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            rows: list[tuple[int, int, int, int]] = []
            for url, source in zip(batch.column(batch.schema.get_field_index(url_col)).to_pylist(), batch.column(batch.schema.get_field_index(html_col)).to_pylist(), strict=True):
                source = source or ""
                root, salt = parse(source), _host_hash(url)
                main = xxhash.xxh64_intdigest(main_text(root, frozenset()))
                page = xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass"), seed=salt)
                outside = _outside(root, _holders(root))
                found = {node.content ^ salt for node in _walk(root) if node.tag in _COUNTED and not node.main} | {x ^ salt for node in _walk(root) if id(node) in outside for x in (node.shape, _form_hash(node))}
                rows += [(page, salt, x, main) for x in found | {salt}]
            table = np.array(rows, np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(4)], ["page", "host", "subtree", "main"])

    return map_arrow(df.select(url_col, html_col), run, "page long, host long, subtree long, main long")


def _template_hashes(subtrees: DataFrame, recurs: int, share: float) -> DataFrame:
    """Subtrees beside at least recurs distinct main texts and a share of those of their host."""
    each = subtrees.groupBy("host", "subtree", "main").count().groupBy("host", "subtree").count()
    counts = staged(each.filter((F.col("count") >= recurs) | (F.col("subtree") == F.col("host"))), "recurring")
    hosts = counts.filter("subtree = host").select("host", F.col("count").alias("mains"))
    found = counts.filter(F.col("subtree") != F.col("host")).join(hosts, "host")
    return found.filter((F.col("count") >= recurs) & (F.col("count") >= share * F.col("mains"))).select("subtree")


def main_texts(df: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "main_text", recurs: int = RECURS, few: int = FEW_HASHES, share: float = SHARE) -> DataFrame:
    """df without its html, with out_col (a column of that name gives way): the page's main text, empty for a null or empty page or one without an article.

    Blocks keep the page's order and are joined by two line feeds; white space in a block becomes one space. A null url
    counts as a host of its own. Pages without article or main element give what their body holds besides templates.
    """
    df = df.drop(out_col) if out_col != html_col else df
    kept = [f for f in df.schema.fields if f.name != html_col]
    own_col, page_col = fresh(df, "templates"), fresh(df, "page")
    names = [f.name for f in kept]
    hashes = staged(_template_hashes(_subtrees(df, url_col, html_col), recurs, share), "templates")
    spark, small = df.sparkSession, hashes.limit(few + 1).count() <= few
    held = spark.sparkContext.broadcast(frozenset(r[0] & (1 << 64) - 1 for r in hashes.toLocalIterator())) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            own = [None] * batch.num_rows if held is not None else get(own_col)
            texts = []
            for url, source, mine in zip(get(url_col), get(html_col), own, strict=True):
                templates = held.value if held is not None else frozenset(x & (1 << 64) - 1 for x in mine or ())
                texts.append(main_text(parse(source or ""), templates, _host_hash(url)))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array(texts, pa.string())], [*names, out_col])

    schema = T.StructType([*kept, T.StructField(out_col, T.StringType())])
    if small:
        return map_arrow(df, run, schema)
    # A subtree of a large host may be on a third of all pages: the hashes are repeated so that its rows spread out.
    salted = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    found = _subtrees(df, url_col, html_col).drop("host").withColumn("salt", F.pmod("page", F.lit(_SALTS)).cast("int")).join(salted, ["subtree", "salt"])
    per_page = found.groupBy("page").agg(F.collect_set("subtree").alias(own_col)).withColumnRenamed("page", page_col)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            pages = [xxhash.xxh64_intdigest((s or "").encode("utf-8", "surrogatepass"), seed=_host_hash(u)) for u, s in zip(get(url_col), get(html_col), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(pages, np.uint64).view(np.int64))], [*batch.schema.names, page_col])

    keyed = map_arrow(df, key, T.StructType([*df.schema.fields, T.StructField(page_col, T.LongType())]))
    return map_arrow(keyed.join(per_page, page_col, "left"), run, schema)
