"""Main text of web pages by tree scoring.

A page is read into a tree. Every paragraph gives points for its length and its commas to its
parent, and half of them to its grandparent; a container's points are discounted by the share
of its text that stands in links. The container with most points is kept, with those of its
siblings that score near it or are paragraphs of prose themselves; so are, level by level
above it, containers with a fair share of the article's paragraphs. The points, the discount
and the joining of siblings follow a widely known public readability method. Elements that hold
no article text (menus, headers, forms, scripts, ...) are left out by tag, role, class or id;
names that also occur on paragraphs count only where links or brevity agree.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, lean, table
from .tokens import small_batches

#: A tag written as it should be; anything else is read attribute by attribute. Possessive, so no text is tried twice.
_TAG = re.compile(r"<(/?+)([a-zA-Z][^\s/><\"'=]*+)((?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=<>`]++))?+)*+)\s*+(/?+)>")
_NAME = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)")
_PART = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)?+))?+)")
#: Elements whose content isn't markup, up to their end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style iframe textarea title xmp noembed noframes".split()}
_ATTR = re.compile(r"([^\s=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes when it stands open, and where the search for it ends.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_DROP_TAGS = frozenset("nav header footer aside form button menu dialog search head fieldset label noscript template svg select object canvas math audio video".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of what holds no article text, whatever stands in it.
_DROP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|banner|sponsor(?:ed)?|promo(?:tions?)?|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|masthead|footer|"
    r"comments?|commentlist|disqus|replies|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|"
    r"related|recommended|recommendations|skip-link|pagination|pager)(?:$|[\s_-])",
    re.I,
)
#: Names that may also stand on an article's own paragraphs: left out only where links or brevity speak against them.
_WEAK_NAMES = re.compile(r"(?:^|[\s_-])(?:header|foot|reply|respond|alert|widget|toolbar|skip|copyright|legal|disclaimer|search|tags|hidden)(?:$|[\s_-])", re.I)
_NAMED_DROP = re.compile(r"^(?:sidebar|comment|cookie|advert|breadcrumb|newsletter|navbar|footer)", re.I)
_KEEP_NAMES = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
#: Blocks of prose: a name of a whole region on one of them says little.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody caption figcaption".split())
_NOT_PROSE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tions?)?|cookies?|consent|notices?|newsletter|breadcrumbs?|pagination|share)(?:$|[\s_-])", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "weak", "score", "total", "text_n", "link_n")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False):
        self.tag, self.parent, self.kids, self.drop = tag, parent, [], drop
        self.weak, self.score, self.total, self.text_n, self.link_n = False, 0.0, 0.0, 0, 0


def _named(node: Node, attrs: str, inside_article: bool) -> None:
    """Sets node.drop and node.weak by tag, role, class, id and style."""
    tag = node.tag
    if tag in _DROP_TAGS and not (tag == "header" and inside_article):
        node.drop = True
    elif attrs and tag not in ("body", "html", "main", "article"):
        names = _PROSE if tag in _PROSE else ()
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key == "role" and value.strip().lower() in _DROP_ROLES or key == "aria-hidden" and value.strip().lower() == "true":
                node.drop = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                node.drop = True
            elif key in ("class", "id") and not _KEEP_NAMES.search(value):
                if names:
                    node.drop = node.drop or bool(_NOT_PROSE.search(value))
                elif _DROP_NAMES.search(value) or any(map(_NAMED_DROP.match, value.split())):
                    node.drop = True
                else:
                    node.weak = node.weak or bool(_WEAK_NAMES.search(value))
        if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs, re.I):
            node.drop = True


def tokens(source: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, "", "", "") and ("", slash, tag name, attributes) in page order, in time linear in the page.

    Comments, declarations and the content of scripts and the like are passed over. As in
    browsers, a tag goes on to the `>` outside quotes that follow a `=`, and what stands in a
    tag, comment or script that never ends is no text.
    """
    at, n = 0, len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0:
            yield source[at:], "", "", ""
            return
        if start > at:
            yield source[at:start], "", "", ""
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(source, start)
        if m:
            slash, name, attrs, at = m[1], m[2].lower(), m[3], m.end()
        else:
            m = _NAME.match(source, start)
            if not m:
                if source[start + 1 : start + 2] in ("!", "?", "/"):
                    end = source.find(">", start + 2)
                    at = n if end < 0 else end + 1
                else:
                    yield "<", "", "", ""
                    at = start + 1
                continue
            slash, name, at, parts = m[1], m[2].lower(), m.end(), []
            while True:
                part = _PART.match(source, at)
                if not part or part.end() >= n and not part[1]:
                    return
                at = part.end()
                if part[1]:
                    break
                value = next((v for v in part.groups()[2:] if v is not None), None)
                parts.append(part[2] if value is None else f"{part[2]}='{value}'" if "'" not in value else f'{part[2]}="{value}"')
            attrs = " ".join(parts)
        if name in _RAW and not slash:
            end = _RAW[name].search(source, at)
            close = source.find(">", end.end()) if end else -1
            if close < 0:
                return
            at = close + 1
        else:
            yield "", slash or " ", name, attrs


def read_tree(source: str) -> Node:
    """The page's tree; texts are strings among `kids`. Unclosed and stray tags are tolerated.

    No tag looks through the open elements: their depths are kept by tag, so time is linear in
    the page but for the depths searched by bisection.
    """
    root = Node("html", None)
    path = [root]  # the open elements
    open_at: dict[str, list[int]] = {}  # depths at which elements of a tag stand open
    block_at = [0]  # those of blocks, and of the root

    def leave(depth: int) -> None:
        while len(path) > depth + 1:
            gone = path.pop().tag
            open_at[gone].pop()
            if gone in _BLOCK:
                block_at.pop()

    for text, slash, tag, attrs in tokens(source):
        if not tag:
            path[-1].kids.append(html.unescape(text))
            continue
        if tag in ("html", "body") and slash != "/":
            if attrs:
                mark = Node("div", None)
                _named(mark, attrs, False)
                path[-1].drop = path[-1].drop or mark.drop and "hidden" not in attrs
            continue
        if slash == "/":
            # An inline end tag doesn't close blocks.
            if open_at.get(tag) and (tag in _BLOCK or open_at[tag][-1] > block_at[-1]):
                leave(open_at[tag][-1] - 1)
            continue
        if tag in _BLOCK:  # ends inline elements and an open paragraph
            leave(block_at[-1] - (path[block_at[-1]].tag == "p"))
        if tag in _CLOSES:
            own, stop = _CLOSES[tag]
            least = max((open_at[t][-1] for t in stop if open_at.get(t)), default=0)
            hits = [open_at[t][bisect_right(open_at[t], least)] for t in own if open_at.get(t) and open_at[t][-1] > least]
            if hits:
                leave(min(hits) - 1)
        new = Node(tag, path[-1])
        path[-1].kids.append(new)
        if tag in _VOID:
            continue
        _named(new, attrs, tag == "header" and bool(open_at.get("article")))
        if not (attrs.endswith("/") and tag not in _BLOCK):
            open_at.setdefault(tag, []).append(len(path))
            if tag in _BLOCK:
                block_at.append(len(path))
            path.append(new)
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes in page order without what is dropped; no recursion, so depth has no bound."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.drop]
    return out


def _measure(root: Node) -> list[Node]:
    nodes = _walk(root)
    for n in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", k)) for k in n.kids if isinstance(k, str) and not k.isspace())
        kids = [k for k in n.kids if isinstance(k, Node) and not k.drop]
        n.text_n = own + sum(k.text_n for k in kids)
        n.link_n = n.text_n if n.tag == "a" else sum(k.link_n for k in kids)
        # A weak name counts where the element is short or mostly links.
        if n.weak and (n.text_n < 120 or 3 * n.link_n > n.text_n):
            n.drop, n.text_n, n.link_n = True, 0, 0
    return [n for n in nodes if not n.drop] if any(n.drop for n in nodes[1:]) else nodes


def _own_text(n: Node) -> str:
    """Text that stands in the node with its inline elements, without that of blocks within it."""
    parts, stack = [], list(reversed(n.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            parts.append(k)
        elif not k.drop and k.tag not in _BLOCK:
            stack += reversed(k.kids)
    return _SPACE.sub(" ", "".join(parts)).strip()


def main_nodes(root: Node) -> list[Node]:
    """The best container and its kept siblings, in page order."""
    _measure(root)
    nodes = _walk(root)
    for n in nodes:
        if n.tag in ("p", "pre", "td", "blockquote", "div", "section", "article", "li", "dd") and n.parent is not None:
            text = _own_text(n)
            if len(text) < 15:
                continue
            points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 30)
            n.total += points
            n.parent.score += points
            if n.parent.parent is not None:
                n.parent.parent.score += points / 2
            if n.tag in ("div", "section", "article"):
                n.score += points
    best = None
    for n in reversed(nodes):
        share = 1 - n.link_n / n.text_n if n.text_n else 0.0
        n.total *= share
        if n.parent is not None:
            n.parent.total += n.total
    for n in nodes:
        if n.tag == "article" or n.tag == "main":
            n.score *= 1.25
        n.score *= 1 - n.link_n / n.text_n if n.text_n else 0
        if n.score > 0 and n.tag in _BLOCK | {"html"} and (best is None or n.score > best.score):
            best = n
    if best is None:
        texts = [n for n in nodes if n.tag in _BLOCK | {"html"} and _own_text(n) and n.link_n <= n.text_n / 2]
        return texts[:1] if not texts else [root]
    return _with_siblings(best)


def _with_siblings(best: Node) -> list[Node]:
    """The container and, level by level up to the root, what stands beside it and belongs to the article.

    Beside the container itself: paragraphs of prose, headings without links and containers that
    score a fifth as much. Further up: containers whose paragraphs are worth a fifth of what is
    kept so far, and a first heading above it.
    """
    kept, node, worth = [best], best, best.total
    while node.parent is not None:
        before, after, seen = [], [], False
        for s in node.parent.kids:
            if s is node:
                seen = True
            elif isinstance(s, Node) and not s.drop and s.tag in _BLOCK and s.text_n and 2 * s.link_n <= s.text_n:
                links = s.link_n / s.text_n
                if node is best:
                    prose = s.tag == "p" and (s.text_n > 80 and links < 0.25 or s.text_n <= 80 and s.link_n == 0)
                    joins = prose or s.score >= max(10.0, best.score * 0.2) or re.fullmatch("h[1-6]", s.tag) and links == 0
                else:
                    joins = s.total >= max(2.0, worth * 0.2) or s.tag in ("h1", "header", "hgroup") and links == 0 and not seen
                if joins:
                    (after if seen else before).append(s)
                    worth += s.total
        kept = before + kept + after
        node = node.parent
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under `nodes`, white space run together; nothing is cut or capped."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(text)
        parts.clear()

    for top in nodes:
        end()
        stack: list[object] = [top]
        while stack:
            k = stack.pop()
            if k is None:
                end()
            elif isinstance(k, str):
                parts.append(k)
            elif not k.drop:
                if k.tag == "br":
                    parts.append(" ")
                elif k.tag in _BLOCK:
                    end()
                    stack.append(None)
                stack += reversed(k.kids)
        end()
    return out


def main_text(source: str | None) -> str:
    return "\n".join(blocks(main_nodes(read_tree(source)))) if source else ""


def extract(df: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """df with column `into`: the main text of each page, empty where there is none.

    Null or empty html gives an empty text; repeated rows stay; nulls in other columns stay.
    A column of df named like `into` is replaced. An empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != into]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias(f"{into}_"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(x.as_py()) for x in batch.column(len(keep))), pa.string())
            yield pa.record_batch([*batch.columns[:-1], texts], names=[*keep, into])

    return source.mapInArrow(lean(run), schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text and 0; repeated rows stay, null ids and urls stay null, and an
    empty table gives no rows.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


by_value(__name__)
