"""Main text of HTML pages by a consensus of the pages of a host.

Each page is parsed once, and what its text may need is written: containers and blocks of text. It votes
for the generalised tag-class path of the smallest container that covers its text without menus, link
lists and the like. Spark adds the votes up by host and path. Then every page's text is taken from the
container on a winning path of its host, so that one page with an odd sidebar is read as its neighbours are.

Neither pages nor texts are shuffled: the winners of the hosts that a chunk of pages has are written
to files that a task reads for its own chunks only. Paths go by 64 bits of a hash, however long they are.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_batches, file_system, new_dir, staged
from .urls import url_host

#: A path needs this share of its host's votes to win, so a host has ten winners at most.
LEAST_SHARE = 0.1
#: A page's own container needs this share of the most voted path's votes to be taken first.
OWN_SHARE = 0.25
#: Single words of so many characters at most may be left beside the container right below the page's root.
LOOSE_CHARS = 25

# Kinds of HTML elements.
RAW = ("script", "style", "textarea", "noscript", "template", "title", "iframe", "svg", "xmp", "noembed", "noframes")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WHOLE_PAGE = {"", "html", "body"}
LEAF_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "dt", "dd", "blockquote", "figcaption", "caption", "td", "th", "address", "summary", "legend"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "center", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "figure", "details", "fieldset", "header", "hgroup", "nav", "footer", "aside", "form", "head", "dialog", "menu", "search"}
DROPPED_TAGS = {"nav", "footer", "aside", "form", "head", "dialog", "menu", "search", "button", "select", "option", "object", "canvas", "audio", "video", "fieldset"}
DROPPED_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay comment comments discussion replies reply respond disqus"
    " form newsletter subscribe signup login search share sharing social related recommended promo promotion breadcrumb breadcrumbs"
    " pagination pager widget toolbar skip hidden".split()
)
#: Words that say what a text is, however long it is; the others may also name a frame of the page.
CONTENT_WORDS = set(
    "footer ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments discussion replies reply respond disqus"
    " related recommended promo promotion".split()
)
#: Names that mark an article as none of the page's own.
ARTICLE_WORDS = {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"}
#: A head of the page or of the article; it is dropped outside articles and main.
HEADER_WORDS = {"header", "masthead"}
#: Parts that say of another element that it is there or not.
TOLD_OF = set("has have no not with without is show hide".split())
#: Parts that don't change what a name says.
PLAIN_PARTS = set("site page posts articles stories global main top bottom left right primary secondary box block list slot container wrapper wrap inner bar item items link links section area unit buttons icons js".split())
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

# A tag's attributes: quotes count after an equals sign only, and one that never closes is a plain
# character. Possessive, so a tag is read once; no second try can start inside it.
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)


@dataclass
class Node:
    """A container: its label (tag and classes), its parent's number, if it is dropped, and its path's number."""

    label: str
    parent: int
    dropped: bool
    tag: str = ""
    mark: int = -1
    score: float = 0.0
    path: int = 0


@dataclass
class BlockText:
    text: str
    node: int
    link: int
    dropped: bool
    heading: bool = False
    mark: int = -1
    in_article: bool = False

    @property
    def worth(self) -> float:
        return 0.0 if self.dropped else max(0.0, len(self.text) - 2.0 * self.link)


@dataclass
class Mark:
    """An element that its names speak against, the marked one around it, if it may be a frame of the page, and if it or one around it may not."""

    parent: int
    frame: bool
    named: bool = False
    chars: float = 0.0
    article_chars: float = 0.0
    dropped: bool = True


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1, False)])
    blocks: list[BlockText] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=list)
    #: Paths by number of the path around and label: a deep page has no long names.
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def path_of(self, k: int) -> str:
        """The generalised path of a container, from the outside in, like ``>body>div.story``."""
        labels = []
        while k > 0:
            labels.append(self.nodes[k].label)
            k = self.nodes[k].parent
        return "".join(">" + x for x in reversed(labels))

    def path_number(self, path: str) -> int:
        """The number of a path on this page, or -1."""
        at = 0
        for label in path.split(">")[1:]:
            at = self.paths.get((at, label), -1)
            if at < 0:
                return -1
        return at


def _attributes(rest: str) -> tuple[list[str], set[str], bool]:
    """Class tokens, what its names say, and if the element is hidden or has a role that is no text.

    A name says a dropped word if its other parts are such words or plain ones, or if it
    ends with it: ``site-footer`` says footer, ``has-sidebar`` and ``notice-text`` nothing,
    nor does ``post-header``, as a post's header is text.
    """
    classes, words, off = [], set(), False
    for m in _ATTR.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for one_name in value.split():
                parts = [w for w in re.split(r"[^a-z]+", one_name) if w]
                said = [w for w in parts if w in DROPPED_WORDS]
                if said and all(w in DROPPED_WORDS or w in PLAIN_PARTS for w in parts):
                    words.update(said)
                elif said and parts[-1] in DROPPED_WORDS - HEADER_WORDS and TOLD_OF.isdisjoint(parts):
                    words.add(parts[-1])
            if name == "class":
                classes = sorted({re.sub(r"\d+", "N", c) for c in value.split()})
        elif name == "role":
            off = off or value in DROPPED_ROLES
        elif name == "hidden":
            off = True
        else:
            off = off or value == "true"
    return classes, words, off


def tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, is an end tag, attributes) of markup in page order; tag is None for what
    has no content: comments, declarations and elements of raw text with all that is in them.

    The scan only moves forward. Markup that doesn't end reaches to the end of the page.
    """
    at, end = 0, len(html)
    while (at := html.find("<", at)) >= 0:
        c = html[at + 1 : at + 2]
        if c == "!" or c == "?":
            if html.startswith("<!--", at):
                short = next((n for n in ("<!-->", "<!--->") if html.startswith(n, at)), None)
                m = None if short else _COMMENT_END.search(html, at + 4)
                stop = at + len(short) if short else m.end() if m else end
            elif html.startswith("<![CDATA[", at):
                stop = html.find("]]>", at) + 3
            else:
                stop = html.find(">", at) + 1
            stop = stop if stop > at else end
            yield at, stop, None, False, ""
            at = stop
            continue
        closes = c == "/"
        name = _NAME.match(html, at + 1 + closes)
        if name is None:
            if closes:
                stop = html.find(">", at) + 1 or end
                yield at, stop, None, False, ""
                at = stop
            else:
                at += 1
            continue
        rest = _REST.match(html, name.end())
        stop, tag = min(rest.end() + 1, end), name.group().lower()
        if rest.end() == end:
            yield at, end, None, False, ""
        elif not closes and tag in _RAW_END:
            m = _RAW_END[tag].search(html, stop)
            stop = (html.find(">", m.end()) + 1 or end) if m else end
            yield at, stop, None, False, ""
        else:
            yield at, stop, tag, closes, rest.group()
        at = stop


def parse(html: str | None) -> Page:
    """Containers and blocks of text of a whole page, in page order.

    The work grows with the length of the page, whatever is in it: where an element of a kind is
    open is looked up, not searched for.
    """
    page, html = Page(), html or ""
    # Of an element: if it is dropped for certain, the innermost mark, and that of the innermost article or main.
    outside: tuple[bool, int, int | None] = (False, -1, None)
    # Open elements: (tag, container number or -1, state). Where each tag and where containers are open.
    stack: list[tuple[str, int, tuple[bool, int, int | None]]] = []
    places: dict[str, list[int]] = {}
    containers: list[int] = []
    node, state, headings = 0, outside, 0
    piece: list[str] = []
    link_chars = 0
    # What a block has so far while an element inside its line is set aside: (the element's place, pieces, link characters).
    held: list[tuple[int, list[str], int]] = []

    def last(tag: str) -> int:
        """Where the innermost open element of a tag is; -1 if nowhere."""
        where = places.get(tag)
        return where[-1] if where else -1

    def flush() -> None:
        nonlocal piece, link_chars
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                page.blocks.append(BlockText(text, node, link_chars, state[0], headings > 0, state[1], state[2] == state[1]))
            piece, link_chars = [], 0

    def close(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal node, state, headings, piece, link_chars
        while held and held[-1][0] >= k:
            # An element inside a line ends: its text is one of its own, and the line goes on.
            flush()
            place, piece, link_chars = held.pop()
            state = stack[place - 1][2] if place else outside
            node = next((stack[c][1] for c in reversed(containers) if c < place), 0)
        gone, around = stack[k:], stack[k - 1][2] if k else outside
        if any(t in LEAF_BLOCKS or n >= 0 for t, n, _ in gone):
            flush()
        del stack[k:]
        outer = -1
        for t, n, _ in gone:
            places[t].pop()
            headings -= t in HEADINGS
            if n >= 0:
                containers.pop()
                outer = n if outer < 0 else outer
        if outer >= 0:
            node = page.nodes[outer].parent
        state = around

    at = 0
    for start, stop, tag, closes, rest in tokens(html):
        if start > at:
            text = html[at:start]
            piece.append(_html.unescape(text) if "&" in text else text)
            if places.get("a"):
                link_chars += len(text)
        at = stop
        if tag is None:
            continue
        around = containers[-1] if containers else -1
        if closes:
            k = last(tag)
            inline = tag not in CONTAINERS and tag not in LEAF_BLOCKS
            if k >= 0 and not (inline and around > k):
                close(k)
            elif not inline:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                piece.append(" ")
            continue
        if tag in ("html", "body") and last(tag) >= 0:
            continue
        block = tag in LEAF_BLOCKS or tag in CONTAINERS
        if block:
            flush()
            # A block ends an open paragraph; items and cells end their like.
            if (k := last("p")) > max(around, last("button"), last("object")):
                close(k)
            if tag in _CLOSED_BY:
                k = max(map(last, _CLOSED_BY[tag]))
                if k > max(map(last, _SCOPES[tag])):
                    close(k)
        elif tag == "a" and (k := last("a")) > around:
            close(k)
        if rest.endswith("/") and not block:
            continue
        classes, words, off = _attributes(rest) if rest.strip("/ \n\t") else ([], set(), False)
        dropped, mark, article = state
        off = off or tag in DROPPED_TAGS and tag != "form"
        if tag == "header" and not places.get("article") and not places.get("main"):
            off = True
        if tag == "article":
            words &= ARTICLE_WORDS
        elif tag in ("html", "body", "main") or not block and tag not in ("span", "a", "strong"):
            words = set()
        elif tag in LEAF_BLOCKS or article is not None:
            words -= HEADER_WORDS
        if (off or words) and not block and not dropped:
            held.append((len(stack), piece, link_chars))
            piece, link_chars = [], 0
        if (words or tag == "form") and not off and not dropped:
            frame = tag != "form" and words.isdisjoint(CONTENT_WORDS)
            page.marks.append(Mark(mark, frame, not frame or mark >= 0 and page.marks[mark].named))
            mark = len(page.marks) - 1
        if tag == "main" or tag == "article" and not words:
            article = mark
        state = (dropped or off, mark, article)
        number = -1
        places.setdefault(tag, []).append(len(stack))
        headings += tag in HEADINGS
        if tag in CONTAINERS:
            number, label = len(page.nodes), (tag + "".join("." + c for c in classes)).replace(">", "%3E")
            path = page.paths.setdefault((page.nodes[node].path, label), len(page.paths) + 1)
            page.nodes.append(Node(label, node, state[0], tag, mark, path=path))
            containers.append(len(stack))
            node = number
        stack.append((tag, number, state))
    if at < len(html):
        piece.append(_html.unescape(html[at:]))
    if held:
        close(held[0][0])
    flush()
    settle(page)
    return page


def settle(page: Page) -> None:
    """Drop the marked elements, but not one around the page's article or main, nor a frame of most of the text.

    One around an article that is named after its content must hold half of the text too.
    """
    if not page.marks:
        return
    every = own = free = 0.0
    for b in page.blocks:
        worth = b.worth
        every += worth
        free += worth if b.in_article and b.mark < 0 else 0.0
        if b.mark >= 0:
            page.marks[b.mark].chars += worth
            page.marks[b.mark].article_chars += worth if b.in_article else 0.0
        own += 0.0 if b.mark >= 0 and page.marks[b.mark].named else worth
    # Those around others come before them.
    for m in reversed(page.marks):
        if m.parent >= 0:
            page.marks[m.parent].chars += m.chars
            page.marks[m.parent].article_chars += m.article_chars
    direct = [0.0] * len(page.marks)
    for b in page.blocks:
        if b.in_article and b.mark >= 0:
            direct[b.mark] += b.worth
    for k in sorted(range(len(page.marks)), key=lambda k: (-page.marks[k].chars, k)):
        m = page.marks[k]
        if m.parent < 0 or not page.marks[m.parent].dropped:
            around = m.article_chars > free and (m.frame or 2 * m.chars >= every)
            if around or m.frame and not free and 2 * m.chars > own:
                m.dropped = False
                free += direct[k]
    for x in (*page.nodes, *page.blocks):
        x.dropped = x.dropped or x.mark >= 0 and page.marks[x.mark].dropped


def score_containers(page: Page, blocks: list[BlockText]) -> None:
    """A block counts fully for its container and all around, less its links; where there are but links, all count alike."""
    for n in page.nodes:
        n.score = 0.0
    linked = not any(b.worth for b in blocks)
    for b in blocks:
        page.nodes[b.node].score += float(not b.dropped) if linked else b.worth
    for n in reversed(page.nodes[1:]):
        page.nodes[n.parent].score += n.score


def inside_of(page: Page, chosen: set[int]) -> list[bool]:
    """For every container, if it is a chosen one or within one."""
    inside: list[bool] = []
    for k, n in enumerate(page.nodes):
        inside.append(k in chosen or n.parent >= 0 and inside[n.parent])
    return inside


def best_container(page: Page) -> int:
    """The smallest container that covers the text. -1 where no text is left.

    Where main elements, or else articles, hold half of the text or more, only theirs counts.
    An article isn't divided. Right below the page's root, single words may stay outside.
    """
    score_containers(page, page.blocks)
    total = page.nodes[0].score
    if not total:
        return -1
    for tag in ("main", "article"):
        inside = inside_of(page, {k for k, n in enumerate(page.nodes) if n.tag == tag and n.score})
        held = [b for b in page.blocks if inside[b.node]]
        if held and 2 * sum(b.worth for b in held) >= total:
            score_containers(page, held)
            break
    else:
        held = page.blocks
    largest: dict[int, int] = {}
    for k, n in enumerate(page.nodes):
        if n.parent >= 0 and n.score > page.nodes[largest.get(n.parent, k)].score or n.parent not in largest:
            largest[n.parent] = k
    at = 0
    while page.nodes[at].tag != "article" and at in largest:
        n, k = page.nodes[at], largest[at]
        if page.nodes[k].score < n.score:
            if n.tag not in WHOLE_PAGE or page.nodes[k].score < 0.9 * n.score:
                break
            inside = inside_of(page, {k})
            if any(b.heading or " " in b.text or len(b.text) > LOOSE_CHARS for b in held if b.worth and not inside[b.node]):
                break
        at = k
    return at


def path_hash(path: str) -> int:
    """The number that a path, such as ``>body>div.story``, goes by."""
    at = 0
    for label in path.split(">")[1:]:
        at = xxhash.xxh64_intdigest(label.encode(), at)
    return at - (1 << 64) * (at >> 63)


@dataclass
class Parsed:
    """What a page's text may need: of each container its parent, the hash of its path and if it is dropped (1)
    or is a main or article (2); of each block that isn't dropped its container, worth and text; its own container."""

    own: int
    parents: list[int]
    paths: list[int]
    flags: list[int]
    places: list[int]
    worth: list[float]
    texts: list[str]


def parsed(html: str | None) -> Parsed:
    page = parse(html)
    own = best_container(page)
    if own < 0:
        return Parsed(-1, [], [], [], [], [], [])
    hashes = [0] * (len(page.paths) + 1)
    for (around, label), number in page.paths.items():
        hashes[number] = xxhash.xxh64_intdigest(label.encode(), hashes[around])
    signed = [h - (1 << 64) * (h >> 63) for h in hashes]
    kept = [b for b in page.blocks if not b.dropped]
    flags = [int(x.dropped) + 2 * (x.tag in ("main", "article")) for x in page.nodes]
    return Parsed(own, [x.parent for x in page.nodes], [signed[x.path] for x in page.nodes], flags, [b.node for b in kept], [b.worth for b in kept], [b.text for b in kept])


def chosen_text(p: Parsed, votes: dict[int, int]) -> str:
    """The text on that of the paths in ``votes`` whose votes times its text on the page are most.

    The page's own best container comes first if its path has OWN_SHARE of the most votes, if
    it stands in a main or article around the winner, or if the page has text on no path.
    """
    if p.own < 0:
        return ""
    won = {p.own}
    if votes.get(p.paths[p.own], 0) < OWN_SHARE * max(votes.values(), default=0):
        worth, held = [0.0] * len(p.parents), [False] * len(p.parents)
        for k, w in zip(p.places, p.worth, strict=True):
            worth[k] += w
            held[k] = True
        for k in range(len(p.parents) - 1, 0, -1):
            worth[p.parents[k]] += worth[k]
            held[p.parents[k]] |= held[k]
        on: dict[int, list[int]] = {}
        for k, path in enumerate(p.paths):
            if path in votes and not p.flags[k] & 1:
                on.setdefault(path, []).append(k)
        most = 0.0
        for path, n in votes.items():
            value = n * (sum(worth[k] for k in on.get(path, ())) + any(held[k] for k in on.get(path, ())))
            if value > most:
                most, won = value, set(on[path])
    around, k = _inside(p.parents, {p.own}), p.own
    while k >= 0 and not p.flags[k] & 2:
        k = p.parents[k]
    inside = around if k >= 0 and all(around[x] for x in won) else _inside(p.parents, won)
    return "\n".join(t for t, x in zip(p.texts, p.places, strict=True) if inside[x])


def _inside(parents: list[int], chosen: set[int]) -> list[bool]:
    """For every container, if it is a chosen one or within one."""
    inside: list[bool] = []
    for k, parent in enumerate(parents):
        inside.append(k in chosen or parent >= 0 and inside[parent])
    return inside


def extract(html: str | None, paths: list[str], votes: list[int] | None = None) -> str:
    """The text of one page, by winning paths and their votes: see :func:`chosen_text`."""
    return chosen_text(parsed(html), dict(zip(map(path_hash, paths), votes or [1] * len(paths), strict=True)))


_PARSED = "own int, own_path long, parents array<int>, paths array<long>, flags array<byte>, places array<int>, worth array<double>, texts array<string>"
#: Chunks (the pages of a task) whose hosts' winners are in one file.
FILE_CHUNKS = 16


def parse_pages(named: DataFrame) -> DataFrame:
    """``row``, ``host`` and what is parsed of the ``html`` of every row, with the number of the task."""
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.string())]
    names = [c.split()[0] for c in _PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        for b in batches:
            found = [parsed(html) for html in b["html"].to_pylist()]
            rows = [(p.own, p.paths[p.own] if p.own >= 0 else None, p.parents, p.paths, p.flags, p.places, p.worth, p.texts) for p in found]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b["row"], b["host"], pa.array([chunk] * len(rows), pa.int64()), *columns], ["row", "host", "chunk", *names])

    return named.select("row", "host", "html").mapInArrow(run, StructType([named.schema["row"], *StructType.fromDDL(f"host string, chunk long, {_PARSED}")]))


def winning_paths(voted: DataFrame) -> DataFrame:
    """host, its winning paths (most votes first, ties by the paths' hash) and their votes."""
    total = voted.groupBy("host").agg(F.sum("n").alias("total"))
    best = voted.join(total, "host").where(F.col("n") >= LEAST_SHARE * F.col("total"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return best.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"), F.transform(ordered, lambda x: -x["n"]).alias("votes"))


def winners_of(out: str, file: int) -> dict[tuple[int, str], dict[int, int]]:
    """The winners of the hosts of a file's chunks, by chunk and host."""
    store, at = file_system(f"{out}/file={file}")
    found: dict[tuple[int, str], dict[int, int]] = {}
    for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                for r in pq.read_table(f).to_pylist():
                    found[r["chunk"], r["host"]] = dict(zip(r["paths"], r["votes"], strict=True))
    return found


def extract_text(pages: DataFrame, keep_html: bool = True) -> DataFrame:
    """Add the main text of every row of ``pages`` (url, html) as column text.

    Other columns stay, html only if asked for; one of that name is replaced. A null or empty html, or
    one without text outside menus, forms and the like, gives an empty text. Pages with a null URL, or
    one without host, vote together. Repeated rows vote each and get equal texts. An empty table gives
    no rows.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    # A page's own columns go along as one, so none of them clashes with those of the work.
    own = [F.col(f"`{c}`") for c in pages.columns if c != "text" and (keep_html or c != "html")]
    named = pages.select(F.struct(*own).alias("row"), F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), "html")
    read = staged(parse_pages(named), "parsed")
    voted = staged(read.where("own_path IS NOT NULL").groupBy("host", F.col("own_path").alias("path")).agg(F.count("*").alias("n")), "votes")
    # A host meets its winners once for each chunk that has pages of it.
    wins = read.select("chunk", "host").distinct().join(winning_paths(voted), "host").withColumn("file", F.floor(F.col("chunk") / FILE_CHUNKS))
    out = new_dir(spark, "winners")
    wins.repartition("file").write.partitionBy("file").parquet(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        fields = [c.split()[0] for c in _PARSED.split(", ") if not c.startswith("own_path")]
        for b in batches:
            texts = []
            for chunk, host, *rest in zip(*(b[c].to_pylist() for c in ("chunk", "host", *fields)), strict=True):
                if chunk // FILE_CHUNKS not in held:
                    if len(held) > 4:
                        held.clear()
                    held[chunk // FILE_CHUNKS] = winners_of(out, chunk // FILE_CHUNKS)
                texts.append(chosen_text(Parsed(*rest), held[chunk // FILE_CHUNKS].get((chunk, host), {})))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.string())], ["row", "text"])

    return read.drop("own_path").mapInArrow(run, StructType([read.schema["row"], StructField("text", StringType())])).select("row.*", "text")
