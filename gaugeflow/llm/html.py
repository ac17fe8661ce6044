"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: a node is a path of elements with their first class, and holds
how often each presentation (row of child elements) and each content (text below) occurs. Its importance is the
larger of the two entropies, to the base of its pages: 0 for what is the same everywhere, 1 for what is always new.
Elements and whole class names that say outright that they are noise (menus, footers, forms, comments and the like) go
without it. What else they say is a prior on importance: a node is removed below ``LEAST_IMPORTANCE``, inside an article
only below half of it, and with a name that hints at noise already below ``LEAST_DOUBTED``. An element that holds the page's
articles is never removed. As all paragraphs of a place share a path, single blocks are judged too: the importance of a
block's text is the share of the path's pages that do without it.

Without evidence nothing goes. The tree counts pages of different text only, so copies of a page, whatever differs in their markup,
don't make its text unimportant. Where less than ``LEAST_LEFT`` of a page's characters would be left, the host's pages are near copies of
each other, and the page keeps everything. Pages are parsed once for the tree, whose counts are aggregates over the stored nodes, and
once for the text; a page gets only those less important nodes that it has.

Markup is read by one expression per token, with the usual implied ends of paragraphs and list items; a page
without an end of an element is read as if it ended there.

Edge cases: a null or empty page, or one without main text, gives an empty text; a missing address counts as a
host of its own; a host with fewer than ``LEAST_PAGES`` pages of a node keeps it; repeated rows give repeated rows;
a column named like a result column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField

from gaugeflow.functions.sizes import broadcast_if_few
from gaugeflow.llm.common import append_columns, sliced, stored, texts

LEAST_IMPORTANCE = 0.2
LEAST_DOUBTED = 0.5
LEAST_PAGES = 4
#: Share of a page's characters that has to be left.
LEAST_LEFT = 0.2
LONGEST_PATH = 200  # characters; a longer path goes by its hash

# Element names by their meaning.
UNSEEN = frozenset("head script style noscript template iframe svg math object canvas audio video select textarea button".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
NOISE = frozenset("nav footer aside form menu dialog".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTENT = frozenset(("article", "main"))
# Class names and ids that mark noise; the outer ones only outside an article.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar related recommended share sharing social newsletter subscribe subscription signup login comment comments reply replies disqus respond pagination pager widget toolbar".split()
)
OUTER_NOISE_NAMES = frozenset("header masthead topbar".split())
#: What may stand beside these names without another meaning: `ad-slot-2`, `share-buttons`.
NEUTRAL_NAMES = frozenset(
    "area articles bar block box button buttons card cards container content group inner items left links list outer panel posts right row section slot stories top bottom unit wrap wrapper".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr dt dd".split()
)
# A start of an element ends an open one of these, up to the element that holds it.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[A-Za-z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.DOTALL
)
_NAMES = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.IGNORECASE)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Node:
    """An open element: its path, whether it is noise (by its element, or by name only), and what it and blocks in it are."""

    __slots__ = ("name", "path", "noise", "named", "content", "doubtful", "hints", "children", "pieces")

    def __init__(self, name: str, path: str, noise: bool = False, named: bool = False, content: bool = False, doubtful: bool = False, hints: bool = False):
        self.name, self.path, self.noise, self.named, self.content, self.doubtful, self.hints = name, path, noise, named, content, doubtful, hints
        self.children: list[str] = []
        self.pieces: list[str] = []


def _named(attributes: str) -> tuple[str, list[str], bool]:
    """First class, all classes, ids and roles, and whether the element is hidden."""
    first, names, hidden = "", [], False
    for key, *values in _NAMES.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if key.lower() == "hidden":
            hidden = True
        elif key.lower() == "class":
            first = first or (value.split() or [""])[0]
        if key.lower() in ("class", "id", "role"):
            names.extend(value.split())
    return first, names, hidden


@lru_cache(maxsize=65_536)
def _means_noise(name: str, outside: bool) -> bool:
    """Whether a whole name says noise: nothing in it has another meaning."""
    noise = NOISE_NAMES | OUTER_NOISE_NAMES if outside else NOISE_NAMES
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()]
    return any(x in noise for x in parts) and all(x in noise or x in NEUTRAL_NAMES for x in parts)


@lru_cache(maxsize=65_536)
def _hints_noise(name: str) -> bool:
    return not NOISE_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", name))


class Page:
    """Blocks of a page: ``(text, open elements, inside an article, doubtful)``, noise left out; and its nodes.

    A name alone doesn't remove an article: one inside an element with a noisy name is doubtful.
    """

    def __init__(self, text: str):
        self.blocks: list[tuple[str, tuple[Node, ...], bool, bool]] = []
        self.nodes: dict[str, list] = {}
        self.holders: set[str] = set()  # paths of articles and of what they are in
        self.stack: list[Node] = [Node("", "")]
        self.buffer: list[str] = []
        at = 0
        while at < len(text):
            token = _TOKEN.search(text, at)
            if not token:
                self.add(text[at:])
                break
            self.add(text[at : token.start()])
            at = token.end()
            name = (token["name"] or "").lower()
            if not name:
                continue
            if token["end"]:
                self.close(name)
            else:
                raw = name in RAW and re.compile(rf"</{name}\s*[^>]*>", re.IGNORECASE).search(text, at)
                if name in RAW:
                    at = raw.end() if raw else len(text)
                else:
                    self.open(name, token["attributes"] or "")
        while len(self.stack) > 1:
            self.pop()
        self.flush()

    def add(self, text: str) -> None:
        if text and not (self.stack[-1].noise or self.stack[-1].named):
            self.buffer.append(text)

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join(entities.unescape("".join(self.buffer)).split())
        self.buffer = []
        if text:
            self.blocks.append((text, tuple(n for n in self.stack[1:] if n.name not in INLINE), self.stack[-1].content, self.stack[-1].doubtful))
            for node in self.stack[1:]:
                node.pieces.append(text)

    def pop(self) -> None:
        self.flush()
        node = self.stack.pop()
        if node.name not in INLINE and not (node.noise or node.named):
            own = self.nodes.setdefault(node.path, [[], []])
            own[0].append(",".join(node.children))
            own[1].append("\n".join(node.pieces))

    def open(self, name: str, attributes: str) -> None:
        if name in ("br", "hr", "wbr"):
            self.add(" " if name != "wbr" else "")
            if name == "hr":
                self.flush()
            return
        if name in EMPTY:
            return
        if name in INLINE:  # inline elements stay in their block; only hidden or noisy ones matter
            _, names, hidden = _named(attributes) if attributes.strip() else ("", [], False)
            top = self.stack[-1]
            named = top.named or any(_means_noise(x, False) for x in names)
            self.stack.append(Node(name, top.path, top.noise or hidden, named, top.content, top.doubtful))
            return
        self.flush()
        if name in ENDS_PARAGRAPH:
            self.end_open({"p"}, ENDS_PARAGRAPH - {"p"})
        if name in IMPLIED:
            self.end_open(*IMPLIED[name])
        top = self.stack[-1]
        while top.name in INLINE:  # a block is no part of an element that was left open
            self.pop()
            top = self.stack[-1]
        first, names, hidden = _named(attributes) if attributes.strip() else ("", [], False)
        content = top.content or name in CONTENT
        noise = top.noise or hidden or name in UNSEEN or name in NOISE or (not content and name == "header")
        named, doubtful = top.named, top.doubtful
        if name in CONTENT:
            named, doubtful = False, doubtful or named
        elif name not in ("html", "body"):
            named = named or any(_means_noise(x, not content) for x in names)
        label = f"{name}.{first}" if first else name
        path = f"{top.path}>{label}"
        if len(path) > LONGEST_PATH:
            path = f"#{xxhash.xxh64_hexdigest(path)}"
        top.children.append(label)
        self.stack.append(Node(name, path, noise, named, content, doubtful, any(map(_hints_noise, names))))
        if name in CONTENT and not (noise or top.content and top.named):
            self.holders.update(n.path for n in self.stack)

    def end_open(self, names: set[str], holders) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in names:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].name in holders:
                return

    def close(self, name: str) -> None:
        if name == "br":
            self.add(" ")
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                if name in INLINE:
                    self.stack.pop(i)
                else:
                    while len(self.stack) > i:
                        self.pop()
                return
            if name in INLINE and self.stack[i].name not in INLINE:
                return

    def main_blocks(self) -> list[tuple[str, tuple[Node, ...]]]:
        """Blocks of the articles, doubtful ones if there are no others, of the whole page if there are none."""
        article = any(content for _, _, content, _ in self.blocks)
        sure = any(content and not doubtful for _, _, content, doubtful in self.blocks)
        return [(text, nodes) for text, nodes, content, doubtful in self.blocks if (content or not article) and not (doubtful and sure)]

    def main_text(self, importance: Mapping[tuple[str, int | None], float] = {}, least: float = LEAST_IMPORTANCE) -> str:
        """The main blocks without the unimportant branches, or all of them if hardly anything would be left.

        ``importance`` by path, and by path and hash of a block's text; what isn't there is important.
        """
        blocks = self.main_blocks()
        if not importance:
            return "\n".join(text for text, _ in blocks)

        def too_low(found: float | None, node: Node) -> bool:
            return found is not None and found < (max(LEAST_DOUBTED, least) if node.hints else least / 2 if node.content else least)

        def unimportant(text: str, nodes: tuple[Node, ...]) -> bool:
            if any(too_low(importance.get((n.path, None)), n) for n in nodes if n.path not in self.holders):
                return True
            return bool(nodes) and too_low(importance.get((nodes[-1].path, _hash([text]))), nodes[-1])

        kept = [text for text, nodes in blocks if not unimportant(text, nodes)]
        if sum(map(len, kept)) < LEAST_LEFT * sum(len(text) for text, _ in blocks):
            kept = [text for text, _ in blocks]
        return "\n".join(kept)


def _hash(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


#: Kinds of rows: what a node shows, what it holds, and the text of one block in it.
PRESENTATION, CONTENT_OF, BLOCK_OF = range(3)


def page_nodes(pages: DataFrame) -> DataFrame:
    """``(host, path, kind, value, page, copy)`` of all pages (url, html, copy: their hash); pages of one main text have one ``page``."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            rows = []
            for url, text, copy in zip(batch.column("url").to_pylist(), texts(batch, "html"), batch.column("copy").to_pylist()):
                page, host = Page(text), host_of(url)
                own = _hash([page.main_text()])
                rows += [(host, path, kind, _hash(parts), own, copy) for path, two in page.nodes.items() for kind, parts in enumerate(two)]
                rows += [(host, path, BLOCK_OF, value, own, copy) for path, value in {(n[-1].path, _hash([x])) for x, n in page.main_blocks() if n}]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "path", "kind", "value", "page", "copy"])

    return pages.mapInArrow(nodes, "host string, path string, kind int, value long, page long, copy long")


def style_tree(nodes: DataFrame) -> DataFrame:
    """``(host, path, value, pages, presentation, content)``: nodes of all hosts with both entropies (value null), and single blocks with their importance as ``content``."""
    each = nodes.select("host", "path", "kind", "value", "page").distinct()
    variants = each.groupBy("host", "path", "kind", "value").agg(F.count("*").cast("double").alias("n"))
    whole = F.col("kind") != BLOCK_OF
    sums = variants.filter(whole).groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    # entropy to the base of the pages: log m - sum(n log n) / m, over log m
    entropy = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    tree = sums.groupBy("host", "path").agg(
        F.max("m").alias("pages"), F.max(F.when(F.col("kind") == PRESENTATION, entropy)).alias("presentation"), F.max(F.when(F.col("kind") == CONTENT_OF, entropy)).alias("content")
    )
    blocks = variants.filter(~whole & (F.col("n") > 1)).join(tree.select("host", "path", "pages"), ["host", "path"])
    single = blocks.select("host", "path", "value", "pages", F.lit(0.0).alias("presentation"), (1 - F.col("n") / F.col("pages")).alias("content"))
    return tree.select("host", "path", F.lit(None).cast("long").alias("value"), "pages", "presentation", "content").unionByName(single)


def extract_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, least_importance: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """The rows of ``pages`` with ``text`` and ``n_chars``; ``keep`` names the columns to return besides (all but the markup)."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars") and (keep is not None or c != html_col)]
    plain = pages.select(F.struct(*kept).alias("row"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(url_col, html_col).alias("copy"))
    nodes = stored(page_nodes(plain.select("url", "html", "copy")), "page-nodes")
    importance = F.greatest("presentation", "content")
    low = style_tree(nodes).filter((F.col("pages") >= least_pages) & (importance < max(LEAST_DOUBTED, least_importance)))
    low = broadcast_if_few(stored(low.select("host", "path", "value", importance.alias("importance")), "page-low"))
    whole = nodes.filter(F.col("kind") == CONTENT_OF).join(low.filter("value IS NULL").drop("value"), ["host", "path"]).select("copy", "path", F.lit(None).cast("long").alias("value"), "importance")
    single = nodes.filter(F.col("kind") == BLOCK_OF).join(low, ["host", "path", "value"]).select("copy", "path", "value", "importance")
    removed = whole.unionByName(single).groupBy("copy").agg(F.collect_set(F.struct("path", "value", "importance")).alias("removed"))
    joined = plain.join(broadcast_if_few(stored(removed, "page-removed")), "copy", "left")

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            known = ({(x["path"], x["value"]): x["importance"] for x in found or ()} for found in batch.column("removed").to_pylist())
            out = [Page(text).main_text(low, least_importance) for text, low in zip(texts(batch, "html"), known)]
            return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

        return compute

    found = append_columns(joined.select("row", "html", "removed"), make, [StructField("text", StringType()), StructField("n_chars", LongType())], ["row"])
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "text", "n_chars")
