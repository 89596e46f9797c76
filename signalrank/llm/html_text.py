"""Main text of HTML pages by consensus host paths.

Each page is split into containers, named by the generalised path of tags and classes that leads to them (digits are
taken out of classes). A container scores by the text of its own blocks, less what stands in links. The best
container's path is the page's vote; Spark counts the votes of each host, and the host's winning path names the
containers whose text every page of that host gives. A page without such a container gives its own best one.

The best container is often a part of the whole: the body of an article beside its title, the longest of some sections.
So each page climbs from it: to the enclosing article, else to parents whose other text is mostly not in links. Of a
parent where the climb ends, headings, paragraphs and sections that are mostly not in links are kept too.

Left out everywhere: scripts, styles, comments of the markup, forms, menus, headers outside the article, footers,
sidebars, and elements whose class, id or role as a whole names one of these, notice, advert, reader comment, sharing or related.
Blocks are in page order, joined by a line break; white space in a block is one space; character references are decoded.

Null and empty html give the empty text. A null url is a host of its own; a url may repeat. Markup may be unclosed,
cut off, badly or very deeply nested; a tag whose quote is never closed ends at its bracket. No text is cut at any
length. An empty table gives an empty result. Only id, url and html are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import cut, sized, small_batches, table

#: Votes that a host's path needs to be used on its other pages.
LEAST_VOTES = 2

# Tag names of HTML, and words by which pages name their parts.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "canvas", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"article", "body", "center", "div", "main", "section", "td", "blockquote", "dd", "figure"}
LEFT_OUT = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "fieldset", "head", "option"}
OWN_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A name is a part's when one of these words is in it and all its other words only say where it is or what shape it has.
PARTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsors", "sponsored", "promo", "promos", "promotion", "promotions", "promoted", "banner", "banners",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "popups", "modal", "overlay", "nav", "navs", "navbar", "navigation", "menu", "menus", "menubar", "sidebar", "sidebars", "rail",
    "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "footers", "foot", "masthead", "topbar", "comment", "comments", "commentlist", "disqus", "replies", "respond", "share", "sharing", "social",
    "related", "recommended", "newsletter", "newsletters", "subscribe",
}
HEADS = {"header", "head"}
SHAPES = {
    "site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "upper", "lower", "side", "sticky", "fixed", "floating", "mobile", "desktop", "inner", "outer", "wrap", "wrapper", "container", "box",
    "block", "blocks", "bar", "area", "zone", "region", "section", "sections", "column", "col", "row", "grid", "panel", "widget", "widgets", "module", "component", "slot", "unit", "list", "lists", "item", "items", "link", "links",
    "button", "buttons", "btn", "icon", "icons", "tools", "toolbar", "form", "field", "thread", "post", "posts", "article", "articles", "story", "stories", "entry", "entries", "content", "contents", "title", "body", "text",
    "signup", "sign", "up", "media", "toggle", "drawer", "dropdown", "dialog", "message", "the", "for", "of", "and", "by", "id", "js", "ui", "wp", "el", "x", "s", "m", "l", "xs", "sm", "md", "lg", "xl",
} | HEADS
#: Classes of an article that name its subject, not its part of the page.
SUBJECT = re.compile(r"(?:tags?|category)[_-].+", re.IGNORECASE)
#: Containers that divide a text; a sibling of this kind is part of it.
DIVISIONS = {"section", "blockquote", "figure", "dd"}
HAVING = re.compile(r"\b(?:has|have|with|without|no|is|not)[_-][\w-]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*+)(?:>|\Z)", re.DOTALL)
#: A name and, where it has one, its value: values are read over, so no word in them passes for a name.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
READ = {"class", "id", "role", "hidden", "aria-hidden"}
WORDS = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")


class _Node:
    """An open element: the number of its path, and of the nearest container's; what it inherits from those above."""

    __slots__ = ("tag", "path", "place", "out", "linked", "within_article")

    def __init__(self, tag, path, place, out, linked, within_article):
        self.tag, self.path, self.place, self.out, self.linked, self.within_article = tag, path, place, out, linked, within_article


class Block:
    """One block of text, the number of the container that it stands in, its characters in links."""

    __slots__ = ("text", "place", "linked", "heading")

    def __init__(self, text, place, linked, heading):
        self.text, self.place, self.linked, self.heading = text, place, linked, heading


class Page:
    """The blocks that nothing leaves out, in page order, and the paths of the page. Each path is held once, as a step below another, so depth costs no square."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.above, self.steps, self.tags = [-1], [-1], [""], [""]
        self._numbers: dict[tuple[int, str], int] = {}

    def child(self, parent: int, step: str) -> int:
        """Number of the path that leads one step below `parent`; above: the nearest container over it."""
        number = self._numbers.get((parent, step))
        if number is None:
            number = self._numbers[parent, step] = len(self.steps)
            self.parent.append(parent)
            self.above.append(parent if self.is_container(parent) else self.above[parent])
            self.steps.append(step)
            self.tags.append(step.split(".")[0])
        return number

    def is_container(self, number: int) -> bool:
        return number == 0 or self.tags[number] in CONTAINERS

    def name(self, number: int) -> str:
        """The steps of a path, outermost first, parted by a space, which no class can hold."""
        found = []
        while number > 0:
            found.append(self.steps[number])
            number = self.parent[number]
        return " ".join(reversed(found))

    def find(self, name: str) -> int | None:
        number = 0
        for step in name.split():
            number = self._numbers.get((number, step))
            if number is None:
                return None
        return number


def _names(name: str, parts: set[str]) -> bool:
    """Whether a class or id names one of the parts, as a whole: `related-posts` does, `related-work` does not."""
    words = [w.lower() for w in WORDS.findall(CAMEL.sub("-", name))]
    return any(w in parts for w in words) and all(w in parts or w in SHAPES for w in words)


def _marks(attributes: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        if (name := name.lower()) in READ:
            found.setdefault(name, "".join(values))
    return found


def _step(tag: str, found: dict[str, str]) -> str:
    classes = [c for c in found.get("class", "").split() if tag != "article" or not SUBJECT.fullmatch(c)]
    names = sorted({re.sub(r"\d+", "", c).strip("-_").lower() for c in classes} - {""})
    return tag + "".join(f".{c}" for c in names)


def blocks_of(html: str | None) -> Page:
    page = Page()
    if not html:
        return page
    stack = [_Node("", 0, 0, False, False, False)]  # fragments have no body
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, at, end = 0, 0, len(html)
    heading = False

    def flush() -> None:
        nonlocal linked, heading
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                page.blocks.append(Block(text, stack[-1].place, min(linked, len(text)), heading))
            parts.clear()
        linked, heading = 0, False

    def shut(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    def say(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if text and not top.out:
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if top.linked:
                linked += len(text.strip())

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "br":
                parts.append(" ")
                continue
            if tag in BLOCKS:
                flush()
            if opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        shut(k)
                        break
                    if tag not in BLOCKS and stack[k].tag in BLOCKS:  # an inline end closes nothing outside its block
                        break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*(?:>|\Z)", re.IGNORECASE).search(html, at)
            if not m.group(0).endswith("/>"):
                at = close.end() if close else (at if tag in ("object", "noscript") else end)
            continue
        if tag in ("br", "wbr"):
            if tag == "br" and not stack[-1].out:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block closes an open paragraph or heading; list items and cells close their like
                if stack[k].tag == "p" or stack[k].tag in OWN_CLOSE.get(tag, ()):
                    shut(k)
                    break
                if stack[k].tag in CONTAINERS or stack[k].tag in ("ul", "ol", "table", "dl"):
                    break
            if tag[0] == "h" and tag[1:].isdigit():
                heading = True
        if tag in VOID or m.group(3).rstrip().endswith("/"):
            continue
        marks = _marks(m.group(3)) if m.group(3) else {}
        top = stack[-1]
        names = HAVING.sub("", " ".join(marks.get(k, "") for k in ("class", "id"))).split() if marks else []
        if tag == "article":  # its classes and id may hold words of its subject
            told = any(x.lower() in PARTS for x in names)
        else:
            told = any(_names(x, PARTS) or not top.within_article and _names(x, HEADS) for x in names)
        bad = (
            tag in LEFT_OUT
            or (tag == "header" and not top.within_article)
            or "hidden" in marks
            or marks.get("aria-hidden", "").lower() == "true"
            or marks.get("role", "").lower() in BAD_ROLES
            or (told and tag not in ("html", "body", "main"))
        )
        path = page.child(top.path, _step(tag, marks)) if tag in BLOCKS else top.path
        stack.append(_Node(tag, path, path if tag in CONTAINERS else top.place, top.out or bad, top.linked or tag == "a", top.within_article or tag in ("article", "main")))
        opened[tag] += 1
    flush()
    return page


def _score(block: Block) -> float:
    plain = len(block.text) - block.linked
    return plain * (1.0 if block.text.count(" ") >= 4 or block.heading else 0.2) - 0.5 * block.linked


#: A block counts for this many containers around it; each counts half as much as the one inside it.
NEAR = 64


def best_path(page: Page) -> str | None:
    """Path of the container whose own blocks score best. A block counts for its nearest container, half for the next and so on; links and single words count little."""
    scores: dict[int, float] = {}
    for block in page.blocks:
        score, place = _score(block), block.place
        for _ in range(NEAR):
            scores[place] = scores.get(place, 0.0) + score * (1.5 if page.tags[place] in ("article", "main") else 1.0)
            score *= 0.5
            place = page.above[place]
            if place < 0:
                break
    if not scores:
        return None
    most = max(scores.values())
    return min(page.name(place) for place, score in scores.items() if score == most)


def whole(page: Page, path: str) -> list[Block]:
    """Blocks of the text that the containers of `path` are part of, in page order; none where the page has no such container."""
    at = page.find(path)
    if at is None:
        return []
    chain = []
    while at >= 0:
        chain.append(at)
        at = page.above[at]
    chain.reverse()
    # For each container how far it shares the chain, and its part there: the parent's own text, or a division of it.
    places: dict[int, tuple[int, int | None]] = {q: (k + 1, q) for k, q in enumerate(chain)}

    def place_of(number: int) -> tuple[int, int | None]:
        todo = []
        while number not in places:
            todo.append(number)
            number = page.above[number]
        for q in reversed(todo):
            n, part = places[page.above[q]]
            part = None if part is None or page.tags[q] not in DIVISIONS else q if part == chain[n - 1] else part
            places[q] = n, part
        return places[todo[0] if todo else number]

    found = [(b, *place_of(b.place)) for b in page.blocks]
    if not any(n == len(chain) for _, n, _ in found):
        return []
    article = next((k for k in range(len(chain) - 1, -1, -1) if page.tags[chain[k]] == "article"), None)
    if article is not None:
        return [b for b, n, _ in found if n > article]
    own = [(0, 0.0)] * (len(chain) + 1)  # text and score of the blocks that leave the chain below each of its containers
    parts: dict[tuple[int, int], tuple[int, int]] = {}
    for b, n, part in found:
        own[n] = own[n][0] + len(b.text), own[n][1] + _score(b)
        if part is not None:
            size, linked = parts.get((n, part), (0, 0))
            parts[n, part] = size + len(b.text), linked + b.linked
    at = len(chain) - 1
    for k in range(len(chain) - 1, 0, -1):
        if page.tags[chain[k]] == "main" or page.tags[chain[k - 1]] in ("body", ""):
            break
        size, score = own[k]
        if size and score < 0.5 * size:
            break
        at = k - 1
    low = max((k for k, q in enumerate(chain[: at + 1]) if page.tags[q] == "main"), default=0)
    fits_in = {key for key, (size, linked) in parts.items() if key[0] > low and linked < 0.5 * size}
    return [b for b, n, part in found if n > at or (n, part) in fits_in]


def text_of(page: Page, path: str | None) -> str:
    """Text that the containers of `path` are part of; where the page has none, the same of its own best container."""
    for chosen in (path, best_path(page)):
        if chosen is not None:
            kept = whole(page, chosen)
            if kept:
                return "\n".join(b.text for b in kept)
    return ""


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many pages of a host have their best container there. pages: (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_path(blocks_of(x.as_py())) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    found = pages.select("host", "html").mapInArrow(run, "host string, path string")
    return found.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))


def winners(voted: DataFrame, least: int = LEAST_VOTES) -> DataFrame:
    """(host, path): the path with most votes, ties to the first by name; hosts where no path has `least` votes have none."""
    best = voted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("n"), "path")).alias("best"))
    return best.where(F.col("best.n") <= -least).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast: int | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    # Beyond max_broadcast bytes the winning paths meet the pages in a shuffle join.
    paths = sized(cut(winners(votes(rows)), narrow=True), max_broadcast)
    joined = rows.join(paths, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(blocks_of(x.as_py()), p) for x, p in zip(batch.column("html"), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
