"""Main text of web pages by paths that a host's pages agree on.

First pass: each page is cut into elements, and every block of text scores its length for all
elements around it, less its share of links, less still under elements whose tag, class, id or role
speaks of menus, notices, adverts or comments.  The page votes for the generalised tag-class path of
its best container: the deepest one that still holds most of the page's score, widened to what stands
beside it and belongs to the article (headings and paragraphs, or all of an article element).  Votes
are summed in Spark by (host, path), partial sums first, and every host's strongest path wins.
Second pass: each page's text is taken from the elements on its host's path, or from its own best
container where it has none.

Such words only lower a score when a container is chosen, so no name bars the best container or what
stands around it.  Inside it, an element is left out if its name consists of such words (and neutral
ones), unless that leaves too little of the container, or it is a header with a heading; an element
that only has such a word among others is left out if most of its text is links.

Defined results: null or empty html gives an empty text; unclosed and stray tags are repaired as
browsers do for blocks; a page without a host in its url votes with those of an empty host; equal
votes go to the higher score, then to the smaller path; repeated rows vote and come out each; very
long pages are read whole; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_IDS, Scratch
from .textkit import slices

#: Share of the page's score that a container must hold to be chosen.
SHARE = 0.8
#: Weight of text under a marked element, by strength of the mark, and of text in an article or main element.
WEIGHTS, MAIN = (1.0, 0.6, 0.1), 2.0
#: Share of a container's text that must be left without a marked element in it: of comments, of others.
LEFT_COMMENTS, LEFT = 0.05, 0.25
_DIGITS, _CAMEL = re.compile(r"\d+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = frozenset("script style noscript textarea template title iframe noembed noframes xmp plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
BARRED = frozenset("head script style noscript template title iframe button select option svg math canvas object audio video map datalist textarea".split())
#: Elements that mark themselves as words below do.
MARKED = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Words in a class, an id or a role that mark menus, notices, adverts, side matter and comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs toc header masthead topbar footer "
    "foot copyright cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies "
    "disqus discussion respond widget toolbar pager pagination pagenav skip hidden search contentinfo complementary".split()
)
COMMENTS = frozenset("comment comments reply replies disqus discussion respond".split())
HEADERS = frozenset(("header", "masthead"))
#: Words that change nothing about the words beside them.
NEUTRAL = frozenset(
    "list box area wrap wrapper container section block item items content inner outer top bottom left right main site page post posts article articles entry global primary secondary slot law info bar text link "
    "links button buttons icon icons count form module component el js wp id unit panel group row col column".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div td body center html form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag on the left ends an open element on the right.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "body": ("head",)}
SCOPE = frozenset("table ul ol dl td th div article section main body html aside nav header footer form blockquote".split())


class Element:
    """An element with its path, how strongly it is marked (0 to 2) and by what, and the text that it holds."""

    __slots__ = ("tag", "path", "barred", "parent", "mark", "kinds", "weight", "main", "score", "chars", "links", "heading", "first", "last")

    def __init__(self, tag, path, barred, parent, first, mark=0, kinds=frozenset()):
        self.tag, self.path, self.barred, self.parent, self.mark, self.kinds, self.first, self.last = tag, path, barred, parent, mark, kinds, first, None
        self.main = tag in ("article", "main") or parent is not None and parent.main
        self.weight = WEIGHTS[mark] * (parent.weight if parent is not None else 1.0) * (MAIN if self.main and not (parent is not None and parent.main) else 1.0)
        self.score, self.chars, self.links, self.heading = 0.0, 0, 0, False


def _marked(tag: str, attrs: str) -> tuple[str, int, frozenset]:
    """The class part of a path, the strength of an element's mark, and the words that make it."""
    names, mark, kinds = "", 0, set()
    if tag in MARKED:
        mark, kinds = 2, {tag}
    for name, a, b, c in ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), a or b or c
        if name == "class":
            names = ".".join(sorted(_DIGITS.sub("#", x) for x in value.lower().split()))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            mark, kinds = 2, kinds | {"hidden"}
        elif name in ("class", "id", "role"):
            for one in value.split():
                words = {x for x in re.split(r"[^a-z]+", _CAMEL.sub("-", one).lower()) if x}
                if found := words & MARKS:
                    mark = max(mark, 2 if words <= MARKS | NEUTRAL else 1)
                    kinds |= found
    return names, min(mark, 1) if tag in ("article", "main") else mark, frozenset(kinds)


def parse(page: str):
    """(blocks, elements): blocks as (text, deepest element, share of it in links), elements in page order with block ranges."""
    root = Element("", "", False, None, 0)
    elements, blocks, open_, text = [root], [], [root], []
    in_link, linked, read = False, 0, 0

    def flush():
        nonlocal linked, read
        joined = " ".join(entities.unescape("".join(text)).split()) if text else ""
        text.clear()
        if joined:
            blocks.append((joined, open_[-1], linked / max(1, read)))
        linked = read = 0

    def add(part: str):
        nonlocal linked, read
        text.append(part)
        n = len(part.strip())
        read += n
        linked += n if in_link else 0

    def close(to: int):
        while len(open_) > to:
            open_.pop().last = len(blocks)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            if not open_[-1].barred:
                add(page[at:])
            break
        if m.start() > at and not open_[-1].barred:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if tag in INLINE or tag == "br":
            if tag == "br":
                text.append("\n")
                continue
            if tag == "a":
                in_link = not closing
            if not closing and attrs and tag in ("span", "a", "small", "label"):
                _, mark, kinds = _marked(tag, attrs)
                if mark == 2:
                    flush()
                    parent = open_[-1]
                    open_.append(Element(tag, parent.path, parent.barred, parent, len(blocks), mark, kinds))
                    elements.append(open_[-1])
            elif closing and open_[-1].tag == tag:
                flush()
                close(len(open_) - 1)
            continue
        flush()
        if closing:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    close(i)
                    break
            continue
        ended = ("p",) if tag in ENDS_P else ()
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in ended or open_[i].tag in ENDS.get(tag, ()):
                close(i)
            elif open_[i].tag in SCOPE and not (tag == "tr" and open_[i].tag in ("td", "th")):
                break
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        names, mark, kinds = _marked(tag, attrs) if tag not in ("html", "body") else (_marked(tag, attrs)[0], 0, frozenset())
        parent = open_[-1]
        path = f"{parent.path}/{tag}{'.' + names if names else ''}"
        open_.append(Element(tag, path, parent.barred or tag in BARRED, parent, len(blocks), mark, kinds))
        elements.append(open_[-1])
    flush()
    close(1)
    root.last = len(blocks)
    for joined, element, share in blocks:
        heading, worth = element.tag in HEADINGS, len(joined) * max(0.05, 1 - share) * element.weight
        while element is not None:
            element.score += worth
            element.chars += len(joined)
            element.links += share * len(joined)
            element.heading = element.heading or heading
            element = element.parent
    return blocks, elements


def best_container(blocks, elements) -> Element:
    """The deepest container that holds most of the page's score, widened to its article."""
    best = elements[0]
    for e in elements[1:]:
        # each holds most of the page, so they lie inside each other
        if not e.barred and e.tag in CONTAINERS and e.score and e.score >= SHARE * elements[0].score:
            best = e
    return _widened(best, blocks)


def _left_out(element: Element, base: Element) -> bool:
    """Whether a marked element inside ``base`` is no part of its article."""
    if not element.mark:
        return False
    if element.mark == 1:
        return element.links >= 0.5 * element.chars
    if element.kinds <= HEADERS and element.heading and element.links < 0.5 * element.chars:
        return False
    least = LEFT_COMMENTS if element.kinds & COMMENTS else LEFT
    return base.chars - element.chars >= least * base.chars


def _inside(element: Element, base: Element) -> bool:
    """Whether a block's element belongs to the article that ``base`` holds."""
    while element is not base and element is not None:
        if _left_out(element, base):
            return False
        element = element.parent
    return True


def _widened(best: Element, blocks) -> Element:
    """The highest container around ``best`` that adds text of the article only; none beyond an article element."""
    above, e = [], best.parent
    while e is not None:
        above.append(e)
        e = e.parent
    articles = [e for e in [best, *above] if e.tag == "article"]
    if articles:
        return articles[-1]
    for e in above:
        if (e.tag in CONTAINERS or e.parent is None) and e.chars > best.chars:
            added = [b[1] for at in (range(e.first, best.first), range(best.last, e.last)) for b in blocks[at.start : at.stop] if _inside(b[1], e)]
            if added and all(_plain(x, e) for x in added):
                best = e
    return best


def _plain(element: Element, inside: Element) -> bool:
    """Whether a block is a heading, a paragraph or the like of a container, not of another one in it."""
    while element is not inside:
        if element.tag in CONTAINERS:
            return False
        element = element.parent
    return True


def _text(blocks, chosen: list[Element]) -> str:
    found, done = [], 0
    for e in chosen:
        found += [text for text, element, _ in blocks[max(done, e.first) : e.last] if _inside(element, e)]
        done = max(done, e.last)
    return " ".join(found)


def _votes(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, 2_000_000):
            rows = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                best = best_container(*parse(page))
                if best.score:
                    rows.append((host, best.path, round(best.score)))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["host", "path", "chars"])


def _texts(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, 2_000_000):
            texts = []
            for path, page in zip(batch.column("path").to_pylist(), batch.column("html").to_pylist()):
                blocks, elements = parse(page or "")
                chosen = [e for e in elements if e.path == path and not e.barred]
                text = _text(blocks, chosen) if chosen else ""
                texts.append(text or _text(blocks, [best_container(blocks, elements)]))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("path")], ["page_id", "url", "text", "n_chars", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes, chars: the winning path of every host; pages(host, html)."""
    votes = pages.where("length(html) > 0").select("host", "html").mapInArrow(_votes, "host string, path string, chars long")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    best = sums.groupBy("host").agg(F.min(F.struct(-F.col("votes"), -F.col("chars"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (the host's) of every page."""
    scratch = Scratch(pages.sparkSession, "html")
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", F.lower(host))
    paths = scratch.save(host_paths(pages), "paths")
    few = paths.limit(BROADCAST_IDS // 10).count() < BROADCAST_IDS // 10
    joined = pages.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "url", "html", "path")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long, path string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
