"""Main text of web pages by the paths that a host's pages agree on."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, prepared
from weftgraph.session import small_enough

#: Hosts whose paths are broadcast at most; of more, they are joined by shuffle.
BROADCAST_HOSTS = 100_000
#: Share of a page's own text that a form's prose must hold for the form to be kept.
FORM_SHARE = 0.5
#: Share of a page's own text that its main or article element must hold, and of its articles' text that one must hold which stands for all.
NAMED_SHARE, ONE_SHARE = 0.3, 0.6

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^<>\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())
# Fixed values of HTML: what has no content, what isn't text, and what begins a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio canvas svg".split()
)
_CONTAINERS = frozenset("article body center div main section table tbody td tr blockquote".split())
_ENDS_P = _BLOCKS - {"br", "button", "svg", "video", "audio", "canvas", "option", "caption", "legend"}
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
_DROPPED = frozenset("nav footer aside button select option menu dialog svg canvas video audio head object applet".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_DROPPED_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|topbar|footer|bottom-?bar|side-?bar|aside|rail|widgets?|ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed|s)?|promos?|promoted|promotion|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|comments?|commentlist|respond|replies|reply|disqus|discussion|related|recommended|recommendations|share|sharing|social|pagination|pager|login|search|toolbar|copyright|legal|disclaimer|skip-link|hidden|sr-only|toc)(?:$|[\s_-]|\d)",
    re.I,
)
# An open element that another one's start tag ends, unless one of the bounds (none: any block) stands between.
_SCOPES = {"p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "td": ("tr", "table"), "tr": ("table",), "option": ("select",), "a": ("table", "div", "article")}
_SCOPE_NAMES = [*_SCOPES]
_SCOPE_OF = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "option": 5, "a": 6}
_NO_SCOPES = (-1,) * len(_SCOPES)
_BOUND_OF = {tag: [i for i, name in enumerate(_SCOPE_NAMES) if tag in (_SCOPES[name] or _BLOCKS)] for tag in _BLOCKS}
_KEPT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|story|entry|content|main|body|text)(?:$|[\s_-])", re.I)


class Node:
    """An element: where it and what is in it stand among the page's elements and pieces of text, and a hash of its generalised path."""

    __slots__ = ("tag", "path", "above", "dropped", "inside", "prose", "scopes", "barrier", "first", "last", "at", "end")

    def __init__(self, tag: str, path: int, above: Node | None, dropped: bool, inside: bool, prose: bool, scopes: tuple, barrier: int, first: int, at: int):
        self.tag, self.path, self.above, self.dropped, self.inside, self.prose, self.scopes, self.barrier = tag, path, above, dropped, inside, prose, scopes, barrier
        self.first, self.last, self.at, self.end = first, first, at, at


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw) if m[1].lower() in _ATTRIBUTES}


def _name(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes, without the numbers that tell one page's elements from another's."""
    kinds = sorted({re.sub(r"\d+", "", c) for c in attributes.get("class", "").lower().split()} - {""})
    return ".".join([tag, *kinds])


def _is_dropped(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in _DROPPED or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in _DROPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if tag in ("body", "html", "main", "article"):
        return False
    said = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
    return bool(said and _DROPPED_WORDS.search(said) and not (inside and re.fullmatch(r"h[1-6]|p", tag)) and not (_KEPT_WORDS.search(said) and not re.search(r"comment|sidebar|footer|menu|nav|\bads?\b|advert|cookie|related|share", said, re.I)))


def _described(tag: str, raw: str) -> tuple[bytes, bool, bool]:
    """Of a start tag: its name for the path, and whether it is dropped, outside and inside an article."""
    attributes = _attributes(raw) if raw else {}
    return _name(tag, attributes).encode("utf-8", "surrogatepass"), _is_dropped(tag, attributes, False), _is_dropped(tag, attributes, True)


_known = lru_cache(maxsize=8192)(_described)


class Page:
    """Pieces of text in page order with the element each stands in, and the elements, parents before children.

    Time is in proportion to the source: each element carries what the ones
    around it say, so that nothing is looked up along the open elements.
    """

    def __init__(self, source: str):
        self.nodes: list[Node] = [Node("", 0, None, False, False, False, _NO_SCOPES, 0, 0, 0)]
        #: (block number, text, element, whether within a link)
        self.pieces: list[tuple[int, str, Node, bool]] = []
        self.stack = [self.nodes[0]]
        #: Places in the stack of the open elements of each tag.
        self.open: dict[str, list[int]] = {}
        self.block = self.links = 0
        self.forms: list[Node] = []
        at = 0
        while m := _MARKUP.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in _RAW and not m[3].endswith("/"):
                until = re.compile(rf"</{tag}\s*+>", re.I).search(source, at)
                at = until.end() if until else len(source)
                self._close(tag)
        self._text(source[at:])
        self._pop_to(1)
        self.nodes[0].last, self.nodes[0].end = len(self.pieces), len(self.nodes) - 1
        self.total = self._own()
        if self.forms:
            self._judge_forms()

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self.block, raw, self.stack[-1], self.links > 0))

    def _pop_to(self, size: int) -> None:
        """End open elements until so many are left."""
        while len(self.stack) > size:
            node = self.stack.pop()
            self.open[node.tag].pop()
            node.last, node.end = len(self.pieces), len(self.nodes) - 1
            self.links -= node.tag == "a"
            self.block += node.tag in _BLOCKS

    def _open(self, tag: str, raw: str) -> None:
        for scope in ((0,) if tag in _ENDS_P else ()) + ((_SCOPE_OF[tag],) if tag in _SCOPE_OF and tag != "p" else ()):
            if (place := self.stack[-1].scopes[scope]) > 0:
                self._pop_to(place)
        self.block += tag in _BLOCKS
        if tag in _VOID or raw.endswith("/") and tag not in _BLOCKS:
            return
        above = self.stack[-1]
        name, *drops = (_known if len(raw) < 200 else _described)(tag, raw)
        inside = above.inside or above.tag in ("article", "main")
        scopes, place = above.scopes, len(self.stack)
        if tag in _SCOPE_OF or tag in _BOUND_OF and scopes != _NO_SCOPES:
            now = list(scopes)
            for i in _BOUND_OF.get(tag, ()):
                now[i] = -1
            if tag in _SCOPE_OF:
                now[_SCOPE_OF[tag]] = place
            scopes = tuple(now)
        path = xxhash.xxh3_64_intdigest(name, seed=above.path)
        dropped = above.dropped or tag in _RAW or drops[inside]
        node = Node(tag, path, above, dropped, inside, above.prose or tag in _PROSE, scopes, place if tag in _CONTAINERS else above.barrier, len(self.pieces), len(self.nodes))
        self.nodes.append(node)
        self.stack.append(node)
        self.open.setdefault(tag, []).append(place)
        self.links += tag == "a"
        if tag == "form" and not dropped:
            self.forms.append(node)

    def _close(self, tag: str) -> None:
        """End the innermost open element of that tag; an inline element's end doesn't close what it stands in."""
        if (places := self.open.get(tag)) and (tag in _BLOCKS or places[-1] >= self.stack[-1].barrier):
            self._pop_to(places[-1])
        elif not places:
            self.block += tag in ("p", "br")

    def _own(self) -> list[int]:
        """Characters of each element's text (with what is below) that aren't dropped.

        Links count where they are part of prose: in a block with other text, or in a paragraph or heading.
        """
        mixed = {block for block, text, node, linked in self.pieces if not linked and not node.dropped and not text.isspace()}
        total = [0] * len(self.nodes)
        for block, text, node, linked in self.pieces:
            if not node.dropped and (not linked or block in mixed or node.prose):
                total[node.at] += len(text.strip())
        for node in reversed(self.nodes[1:]):
            total[node.above.at] += total[node.at]
        return total

    def _judge_forms(self) -> None:
        """A form is dropped, unless its prose is most of the page's own text: some pages stand in one as a whole."""
        ended, changed = -1, False
        for form in self.forms:
            if form.at <= ended:
                continue
            prose = sum(len(text.strip()) for _, text, node, _ in self.pieces[form.first : form.last] if not node.dropped and (node.prose or node.inside))
            if prose < FORM_SHARE * self.total[0] or not prose:
                ended, changed = form.end, True
                for node in self.nodes[form.at : form.end + 1]:
                    node.dropped = True
        if changed:
            self.total = self._own()

    def best(self) -> Node:
        """The innermost container outside which all text is dropped; a main element, or an article, with enough of the page goes before others.

        Of several articles without a main the one is taken that holds most of
        their text, or else the element around all of them.
        """
        total, top = self.total, self.nodes[0]
        for tag in ("main", "article"):
            named: list[Node] = []
            for n in self.nodes:
                if n.tag == tag and not n.dropped and total[n.at] and not (named and n.at <= named[-1].end):
                    named.append(n)
            if named and sum(total[n.at] for n in named) >= NAMED_SHARE * total[0]:
                top = max(named, key=lambda n: (total[n.at], -n.at))
                if total[top.at] < ONE_SHARE * sum(total[n.at] for n in named):
                    while not top.at <= named[0].at <= named[-1].at <= top.end:
                        top = top.above
                break
        found = top
        for node in self.nodes[top.at + 1 : top.end + 1]:
            if node.tag in _CONTAINERS and not node.dropped and total[node.at] == total[top.at] > 0:
                found = node
        return found

    def text(self, roots: list[Node]) -> str:
        """Text of the elements' blocks, white space within a block as one space, blocks joined by one."""
        blocks: dict[int, list[str]] = {}
        for root in roots:
            for block, text, node, _ in self.pieces[root.first : root.last]:
                if not node.dropped or root.dropped:
                    blocks.setdefault(block, []).append(text)
        done = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
        return " ".join(t for t in done if t)

    def at_path(self, path: int) -> list[Node]:
        """Elements at a path, in page order, that have text of their own; at one path none stands within another."""
        return [node for node in self.nodes[1:] if node.path == path and not node.dropped and self.total[node.at]]


def host(url: str) -> str:
    """SQL for the host of a URL: lower case, without user, port and www; empty if it has none."""
    return f"lower(regexp_replace(regexp_replace(regexp_extract({url}, '^[^/?#]*//([^/?#]*)', 1), '^.*@|:[0-9]*$', ''), '^(?i)www[.]', ''))"


def vote(source: str) -> int:
    """Hash of the path of a page's own container; 0 is the page itself."""
    return Page(source).best().path


def extract(source: str, path: int | None) -> str:
    """Main text of a page: of the elements at its host's path, or of its own best container where they hold less of the page's own text."""
    page = Page(source)
    roots, best = page.at_path(path) if path else [], page.best()
    if not roots or sum(page.total[n.at] for n in roots) < page.total[best.at]:
        roots = [best]
    return page.text(roots)


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Each page votes for the generalised path (tags and classes, without their
    numbers) of the container that holds its own text; a host's path is the one
    with most votes, the one of smallest hash of equals. A page on which that
    path holds less than its own container does gives the text of the latter.
    Pages without a host (null or odd URL) share one, the empty one, and so their
    path. Null and empty html give empty text; very long, deep or broken pages
    take time in proportion to their length. Rows that repeat vote and are
    answered each; other columns are dropped, whatever their names; an empty
    table gives an empty table.
    """
    spark = prepared(pages.sparkSession)
    scratch = Scratch(spark, "html")
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    hosted = rows.withColumn("host", F.expr(f"coalesce({host('url')}, '')"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vote(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v - (1 << 64) if v >> 63 else v for v in found], pa.int64())], ["host", "path"])

    counted = hosted.select("host", "html").where("html <> ''").mapInArrow(votes, "host string, path long").groupBy("host", "path").count()
    won = scratch.stored(counted.groupBy("host").agg(F.min_by("path", F.struct(F.col("path") == 0, -F.col("count"), "path")).alias("path")))
    if small_enough(won, BROADCAST_HOSTS):
        joined = hosted.join(F.broadcast(won), "host", "left")
    else:  # Spark splits a host's pages in this join
        joined = hosted.join(won, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x, None if path is None else path & 0xFFFFFFFFFFFFFFFF) for x, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long"), "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
