"""Main text of web pages from the containers that the pages of a host agree on.

Every page is parsed into elements, parts that are never main text are set aside, and the rest
is scored container by container.  A page votes for the path of its best container, in
generalised form: tag and classes from the root down, digits as one 0.  Votes are counted per
host in Spark; each page is then extracted again, from the container of its own that won most
votes on its host.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import map_batches
from metricwatch.sources import written

# Fixed values of HTML: elements without content, with plain text as content, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr q rb rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
# Start tags that end open elements of the first kinds, as far as the nearest one of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "body": ({"head"}, set()),
}
# A paragraph ends where one of these starts.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " main menu nav ol p pre search section summary table ul".split()
)
ENDS_P_UNTIL = (ENDS_P - {"p"}) | {"td", "th", "li", "body", "button", "object", "caption"}

# What is never main text, by element, role and class or id.
DROP_TAGS = frozenset(
    "script style noscript template head title iframe object embed applet canvas svg audio video map nav aside footer form button input select"
    " textarea datalist output dialog menu noembed noframes".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
QUALIFIERS = frozenset("has with without no js is".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs byline-share comment comments comentarios commentaires"
    " kommentare consent cookie cookies disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification"
    " overlay pager pagination paywall popup popups print-only promo promos promotion recommended recommendations related replies reply respond"
    " share sharing sidebar sidebars signup sitemap skip skiplink social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
CONTAINERS = frozenset("body article main section div td center blockquote form html".split())
# A short line that stands in one of these, and in no paragraph, is rarely main text.
LOOSE, LOOSE_CHARS = frozenset(["div", "td", "body", "section", "li", "html", ""]), 80
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][^\s=/>\"']*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


# A path wins with this share of the votes of its host's most voted path; a page uses it if the container
# there has this share of the page's best score.  The whole page and its body win only where nothing else does.
WINNING_SHARE, FITTING_SHARE = 0.2, 0.05
WHOLE = ("", "/html", "/html/body", "/body")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    names: tuple[str, ...] = ()  # classes
    marks: frozenset[str] = frozenset()  # words of classes and id
    role: str = ""
    hidden: bool = False
    dropped: bool = False
    chars: int = 0  # characters of main text inside, links left out
    waste: int = 0  # characters of links and of loose short lines inside
    closed: bool = False  # by its own end tag


@dataclass
class Page:
    elements: list[Element]
    # Blocks in page order: (element that holds the text, text, characters of links in it).
    blocks: list[tuple[int, str, int]]


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTRIBUTE.finditer(attributes)}


def _words(value: str) -> list[str]:
    """Class and id names and their parts (``main-nav``: ``main`` and ``nav``); ``with-sidebar`` is no sidebar."""
    out = []
    for name in value.lower().split():
        parts = re.split(r"[-_:.]+", name)
        if not QUALIFIERS.intersection(parts):
            out += [name, *parts]
    return out


def parse(html: str) -> Page:
    """Elements and text blocks of a page, tolerant of unclosed and stray tags.

    A block is the text between two boundaries of block elements, with references decoded and white
    space as one blank; a line break is white space.
    """
    elements = [Element("", -1)]
    blocks: list[tuple[int, str, int]] = []
    stack = [0]
    text: list[str] = []
    links = 0
    anchors = 0

    def flush() -> None:
        nonlocal links
        if text:
            line = " ".join("".join(text).split())
            if line:
                holder = next(e for e in reversed(stack) if elements[e].tag not in INLINE)
                blocks.append((holder, line, min(links, len(line))))
            text.clear()
        links = 0

    def close_to(depth: int) -> None:
        nonlocal anchors
        if any(elements[e].tag not in INLINE for e in stack[depth:]):
            flush()
        for e in stack[depth:]:
            anchors -= elements[e].tag == "a"
        del stack[depth:]

    def add(piece: str) -> None:
        nonlocal links
        piece = unescape(piece) if "&" in piece else piece
        text.append(piece)
        if anchors:
            links += len(piece.strip())

    at, size = 0, len(html)
    while at < size:
        found = _MARKUP.search(html, at)
        if found is None:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag), 0)
            if depth:
                elements[stack[depth]].closed = True
                close_to(depth)
            elif tag == "p":
                flush()
            continue
        if tag == "br" or tag == "hr":
            text.append(" ") if tag == "br" else flush()
            continue
        if tag in VOID:
            continue
        if elements[stack[-1]].tag == "head" and tag not in HEAD_TAGS:
            close_to(len(stack) - 1)
        kinds, until = CLOSES.get(tag, (frozenset(), frozenset()))
        if tag in ENDS_P:
            kinds, until = frozenset({"p"}), ENDS_P_UNTIL
        if kinds:
            ended = 0
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]].tag in until:
                    break
                if elements[stack[k]].tag in kinds:
                    ended = k
            if ended:
                close_to(ended)
        if tag not in INLINE:
            flush()
        element = Element(tag, stack[-1])
        if found[3] and not found[3].isspace():
            given = _names(found[3])
            element.names = tuple(sorted(set(given.get("class", "").split())))
            element.marks = frozenset(_words(given.get("class", "") + " " + given.get("id", "")))
            element.role = given.get("role", "").lower().strip()
            element.hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(given.get("style", "")))
            if given.get("itemprop", "").lower() == "articlebody":
                element.role = element.role or "main"
        elements.append(element)
        if tag in RAW:
            # Plain text up to the end tag; none of it is main text.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        stack.append(len(elements) - 1)
        anchors += tag == "a"
    flush()
    return Page(elements, blocks)


def _is_main(e: Element) -> bool:
    return e.tag in MAIN_TAGS or e.role in ("main", "article")


def judge(page: Page) -> None:
    """Mark elements that are never main text, and add up text and waste of the others."""
    elements = page.elements
    holds_main = [False] * len(elements)
    for k in range(len(elements) - 1, 0, -1):
        if holds_main[k] or _is_main(elements[k]) or elements[k].tag == "h1":
            holds_main[elements[k].parent] = True
    inside_main = [False] * len(elements)
    for k in range(1, len(elements)):
        e = elements[k]
        inside_main[k] = inside_main[e.parent] or _is_main(e)
        # A wrapper round the article isn't dropped for its name or role, nor what lost its end tag.
        wraps = _is_main(e) or holds_main[k]
        tagged = e.tag in DROP_TAGS and not (wraps and (e.tag == "form" or not e.closed))
        heads = (e.tag == "header" or "header" in e.marks) and not inside_main[k] and (e.closed or not wraps)
        named = bool(e.marks & DROP_NAMES or e.role in DROP_ROLES) and not wraps and e.tag not in INLINE
        e.dropped = e.tag not in ("html", "body") and (e.hidden or tagged or heads or named) or elements[e.parent].dropped
    for holder, line, links in page.blocks:
        e = elements[holder]
        if not e.dropped:
            loose = e.tag in LOOSE and len(line) < LOOSE_CHARS
            e.chars += 0 if loose else (3 if e.tag in HEADINGS else 1) * (len(line) - links)
            e.waste += len(line) if loose else links
    for k in range(len(elements) - 1, 0, -1):
        parent = elements[elements[k].parent]
        parent.chars += elements[k].chars
        parent.waste += elements[k].waste


def paths(page: Page) -> list[str]:
    """Generalised path of every element: tags and classes from the root, digits as one 0; html and body without classes."""
    out = [""]
    for e in page.elements[1:]:
        names = {_DIGITS.sub("0", n.lower()) for n in e.names} if e.names and e.tag not in ("html", "body") else ()
        out.append(f"{out[e.parent]}/{'.'.join([e.tag, *sorted(names)])}")
    return out


def _score(e: Element) -> float:
    """Text, half more where an element calls itself main text, less waste."""
    return (1.5 if _is_main(e) else 1.25 if e.marks & MAIN_NAMES else 1.0) * e.chars - e.waste


def containers(html: str) -> tuple[str, dict[str, float]]:
    """Path of a page's best container, and the score of every container path.

    Of equal scores the innermost wins, so wrappers never do.  The whole page is a container, of the path ''.
    """
    page = parse(html)
    judge(page)
    scores = {"": _score(page.elements[0])}
    best = ""
    for e, path in zip(page.elements[1:], paths(page)[1:]):
        if not e.dropped and e.tag in CONTAINERS and e.chars + e.waste:
            scores[path] = max(_score(e), scores.get(path, _score(e)))
            if _score(e) >= scores[best]:
                best = path
    return best, scores


def extract(html: str, path: str) -> str:
    """Main text of the containers with this path, blocks joined by one blank.

    Where several share the path, only those count that hold more text than waste, if any does.
    """
    page = parse(html)
    judge(page)
    named = paths(page)
    chosen = {k for k, p in enumerate(named) if p == path and not page.elements[k].dropped}
    chosen = {k for k in chosen if _score(page.elements[k]) > 0} or chosen
    inside = [False] * len(named)
    for k in range(len(named)):
        inside[k] = k in chosen or (k > 0 and inside[page.elements[k].parent])
    return " ".join(line for holder, line, _ in page.blocks if inside[holder] and not page.elements[holder].dropped)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.xxhash64("url", html).alias("key"),
    )


def ballots(pages: DataFrame) -> DataFrame:
    """``(page_id, key, host, path, score, best, fits)``: every container path of every page.

    ``best`` marks the page's vote, ``fits`` what may be used for the page if the path wins.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, hosts, found, scores, best, fits = [], [], [], [], [], []
        for row, (url, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            vote, every = containers(html)
            least = FITTING_SHARE * every[vote]
            rows += [row] * len(every)
            hosts += [host_of(url)] * len(every)
            found += every
            scores += every.values()
            best += [p == vote for p in every]
            fits += [p not in WHOLE and score > 0 and score >= least for p, score in every.items()]
        rows = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(3).take(rows), pa.array(hosts, pa.string()), pa.array(found, pa.string())]
            + [pa.array(scores, pa.float64()), pa.array(best, pa.bool_()), pa.array(fits, pa.bool_())],
            ["page_id", "key", "host", "path", "score", "best", "fits"],
        )

    return map_batches(pages, run, "page_id long, key long, host string, path string, score double, best boolean, fits boolean")


def chosen_paths(votes: DataFrame) -> DataFrame:
    """``(page_id, key, path)``: the path from which each page is extracted.

    A page takes the most voted of its fitting containers whose paths win, without one the most voted of
    all.  Ties go to the better score, then to the smaller path.  Votes are summed before they
    shuffle, and the sums written, so a hot host's pages meet them in a plain join.
    """
    sums = written(votes.where("best").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "extraction-votes")
    tops = sums.groupBy(F.col("host").alias("h")).agg(F.max("n").alias("most"))
    won = written(
        sums.join(tops, F.col("host") == F.col("h")).select("host", "path", "n", (F.col("n") >= F.lit(WINNING_SHARE) * F.col("most")).alias("wins")),
        "extraction-winners",
    )
    order = F.struct((~(F.col("wins") & F.col("fits"))).alias("late"), (-F.col("n")).alias("less"), (-F.col("score")).alias("worse"), "path")
    first = F.min(order).alias("first")
    return votes.join(won, ["host", "path"]).groupBy("page_id", "key").agg(first).select("page_id", "key", "first.path")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every row.

    Blocks of the winning containers are joined by one blank, in page order, with character
    references decoded and white space as one blank.  Left out are menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles, hidden parts and comments of readers, by element, role,
    class or id.

    Null and empty html give an empty text; so do pages without text.  A null or malformed url
    is of the host ''; ``www.`` is no part of a host.  Repeated rows vote each and give equal results.  Null
    page_ids stay.  Texts are whole, of any length.  An empty table gives an
    empty result; other columns are ignored.
    """
    keyed = _keyed(pages)
    votes = written(ballots(keyed), "extraction-ballots")
    chosen = written(chosen_paths(votes), "extraction-paths").withColumnsRenamed({"page_id": "_id", "key": "_key"})
    joined = keyed.join(chosen, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, p or "") for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return map_batches(joined.select("page_id", "url", "html", "path"), run, "page_id long, url string, text string, n_chars long")
