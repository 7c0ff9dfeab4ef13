"""Main text of web pages by consensus paths of their hosts.

Each page scores its containers by the text below them. Its best container votes, under a path of
tags and classes with numbers generalised, for its host; Spark adds up the votes per host and
path. Every page is then extracted again below the path that won on its host, or below its own
best container where it has none with that path.

Inside the container everything is kept but what is marked as no part of the article (tags, roles,
class and id words listed below). A block is what lies between block-level tags; ``br`` and other
white space inside it become one space. From the best container the choice widens to its parent while
that adds text of its own or like parts, so a section that outweighs the rest does not cut it off;
a page of which names or a form around everything leave nothing is read without them. Reading
takes time in proportion to the page, however its tags are nested or broken.

Defined results: NULL or empty html gives an empty text; pages without a host vote for themselves;
repeated pages are extracted each; unclosed tags, broken references and cut pages are read as far
as they go (a tag without an end ends the page); decimal references of 4,000 digits and more become U+FFFD; an empty table gives an empty result; columns other than id, URL and html are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import host_of, picked
from panelwright.runtime import stage

# Elements by their role in HTML, and words that mark parts around an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr label meter output progress area base col embed link meta param source track input".split()
)
RAW = frozenset("script style".split())
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template svg iframe object button select textarea dialog menu canvas "
    "audio video map".split()
)
CONTAINERS = frozenset("html body main article section div td blockquote center dd li details figure fieldset".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SAME_BORDERS = ("ul", "ol", "dl", "table", "select", "div", "article", "section")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond "
    "related recommended recommendations share sharing social sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead toolbar pagination pager widget widgets login search form copyright disclaimer".split()
)
ARTICLE = frozenset("article post content entry story main text body page".split())

# Words that tell content from what a word of AROUND would name ("share-price-table").
CONTENT = frozenset("table figure chart graph price prices result results data".split())

MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Decimal references too long to be a number of a character.
LONG_REFERENCE = re.compile(r"&#[0-9]{4000,};?")


def decoded(source: str) -> str:
    """The text with its character references replaced."""
    return references.unescape(LONG_REFERENCE.sub("\ufffd", source)) if "&" in source else source


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): decoded(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


class Scanner:
    """Tags of a page one after the other, each sign looked at a bounded number of times.

    A quote that never closes is an ordinary sign, and once a tag has no end outside quotes, quotes
    count no longer. What opens last and never ends reaches to the end of the page.
    """

    def __init__(self, source: str):
        self.source, self.at, self.quotes = source, 0, {'"', "'"}

    def _end(self, at: int) -> int:
        start = at
        while self.quotes and (q := QUOTE_OR_END.search(self.source, at)) is not None:
            if q[0] == ">":
                return q.start()
            closing = self.source.find(q[0], q.end()) if q[0] in self.quotes else -1
            if closing < 0:
                self.quotes.discard(q[0])
            at = q.end() if closing < 0 else closing + 1
        self.quotes.clear()
        return self.source.find(">", start)

    def next(self) -> tuple[str, bool, str, str] | None:
        """Text before the next tag, whether the tag closes, its name (empty for comments) and attributes."""
        m = MARKUP.search(self.source, self.at)
        if m is None:
            return None
        before = self.source[self.at : m.start()]
        if m[2] is None:
            end = self.source.find("-->" if m[3] else ">", m.end())
            self.at = len(self.source) if end < 0 else end + (3 if m[3] else 1)
            return before, False, "", ""
        end = self._end(m.end())
        if end < 0:
            self.at = len(self.source)
            return before, False, "", ""
        self.at = end + 1
        return before, m[1] == "/", m[2].lower(), self.source[m.end() : end]

    def skip_raw(self, tag: str) -> None:
        """Go on after the end tag of an element without markup inside."""
        self.at = re.compile(rf"</{tag}\s*>|\Z", re.I).search(self.source, self.at).end()

    def rest(self) -> str:
        return self.source[self.at :].removesuffix("</")


def _named(value: str, words: frozenset[str]) -> bool:
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        if parts and parts[0] not in ("no", "with", "has", "without") and not words.isdisjoint(parts) and CONTENT.isdisjoint(parts):
            return True
    return False


def around(tag: str, given: dict[str, str], names: bool = True) -> bool:
    """Whether an element is no part of the article; without ``names`` its class, its id and that it is a form do not tell."""
    if tag in DROPPED and (names or tag != "form"):
        return True
    if not given or tag in ("html", "body"):
        return False
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return True
    if given.get("role", "").lower() in ROLES:
        return True
    if tag in ("article", "main") and not _named(given.get("class", ""), frozenset(("comment", "comments"))):
        return False
    return names and (_named(given.get("class", ""), AROUND) or _named(given.get("id", ""), AROUND))


@dataclass
class Container:
    step: str
    bonus: float
    parent: int
    score: float = 0.0
    length: int = 0
    linked: int = 0
    own: int = 0  # text in no container below, without links
    article: bool = False  # tag or name of it or of one around it tell of an article

    @property
    def tag(self) -> str:
        return self.step.split(".", 1)[0]


@dataclass
class Page:
    containers: list[Container] = field(default_factory=list)
    blocks: list[tuple[str, int]] = field(default_factory=list)  # text and innermost container


def _step(tag: str, given: dict[str, str]) -> str:
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in given.get("class", "").split()})
    return ".".join([tag, *names]).replace(">", "")


class Open:
    """Open elements, with the positions of each tag, so that none is looked for from the top."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []  # tag, dropped, container to return to
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, gone: bool, inside: int) -> None:
        for places in (self.places.setdefault(tag, []), *([] if tag in INLINE else [self.blocks])):
            places.append(len(self.stack))
        self.stack.append((tag, gone, inside))

    def pop(self) -> tuple[str, bool, int]:
        out = self.stack.pop()
        self.places[out[0]].pop()
        if out[0] not in INLINE:
            self.blocks.pop()
        return out

    def last(self, names: Iterable[str]) -> int:
        """Highest position of any of the tags, -1 if none is open."""
        return max((self.places[t][-1] for t in names if self.places.get(t)), default=-1)


def parse(source: str, names: bool = True) -> Page:
    """Blocks and containers of a page in one pass, in time proportional to its length.

    Without ``names``, names and forms tell only inside what looks like an article.
    """
    page, tags, opened = Page(), Scanner(source), Open()
    dropped, inside, links = 0, -1, 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal text, linked
        block = " ".join(decoded("".join(text)).split()) if text else ""
        if block:
            page.blocks.append((block, inside))
            if inside >= 0:
                c = page.containers[inside]
                c.score += len(block)
                c.length += len(block)
                c.linked += linked
                c.own += max(len(block) - linked, 0)
        text, linked = [], 0

    def close(k: int) -> None:
        nonlocal dropped, inside, links
        while len(opened.stack) > k:
            tag, gone, before = opened.pop()
            if tag not in INLINE:
                flush()
            dropped -= gone
            links -= tag == "a"
            inside = before

    def add(part: str) -> None:
        nonlocal linked
        if part and not dropped:
            text.append(part)
            if links:
                linked += len(part)

    while (found := tags.next()) is not None:
        before, closes, tag, inner = found
        add(before)
        if not tag:
            continue
        if closes:
            k = opened.last((tag,))
            if k >= 0 and (tag not in INLINE or k > (opened.blocks[-1] if opened.blocks else -1)):
                close(k)
            continue
        if tag == "br":
            add(" ")
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and (k := opened.last(("p",))) >= 0:
            close(k)
        elif tag in SAME_CLOSES:
            k = opened.last(SAME_CLOSES[tag])
            if k > opened.last(SAME_BORDERS):
                close(k)
        given = attributes(inner) if inner and not inner.isspace() else {}
        gone = around(tag, given, names or inside >= 0 and page.containers[inside].article)
        opened.push(tag, gone, inside)
        dropped += gone
        links += tag == "a"
        if tag in CONTAINERS and not dropped:
            bonus = {"article": 2.0, "main": 1.6, "body": 0.4, "html": 0.3}.get(tag, 1.0)
            if tag not in ("html", "body") and (_named(given.get("class", ""), ARTICLE) or _named(given.get("id", ""), ARTICLE)):
                bonus *= 1.5
            article = bonus > 1 or inside >= 0 and page.containers[inside].article
            page.containers.append(Container(_step(tag, given), bonus, inside, article=article))
            inside = len(page.containers) - 1
        if tag in RAW and not inner.rstrip().endswith("/"):
            tags.skip_raw(tag)
            close(len(opened.stack) - 1)
    add(tags.rest())
    close(0)
    flush()
    for c in reversed(page.containers):
        if c.parent >= 0:
            parent = page.containers[c.parent]
            parent.score += 0.8 * c.score
            parent.length += c.length
            parent.linked += c.linked
    return page


def read(source: str) -> Page:
    """The page; where names or forms around everything leave nothing, read without them."""
    page = parse(source)
    if page.blocks or any(c.tag in ("article", "main") for c in page.containers):
        return page
    open_page = parse(source, names=False)
    return open_page if any(c.article for c in open_page.containers if c.length) else page


def _widened(page: Page, k: int) -> int:
    """The container around all of the article whose best part is container ``k``.

    A parent is taken if it adds text that is not mostly links: text of its own, or parts like the one
    chosen or without a name. Other parts beside come along only where the parent's name tells of an
    article. An ``article`` or ``main`` is never left.
    """
    children: dict[int, list[int]] = {}
    for j, c in enumerate(page.containers):
        children.setdefault(c.parent, []).append(j)
    at = k
    while page.containers[at].tag not in ("article", "main", "body") and page.containers[at].parent >= 0:
        up = page.containers[at].parent
        here, parent = page.containers[at], page.containers[up]
        more, more_linked = parent.length - here.length, parent.linked - here.linked
        beside = [page.containers[j].step for j in children[up] if j != at and page.containers[j].length]
        alike = sum(step == here.step or step in ("section", "div", "blockquote", "figure", "details") for step in beside)
        if 2 * more_linked > more or parent.tag == "html" or alike < len(beside) and parent.bonus <= 1:
            break
        at = up
        if more:
            k = at
    return k


def path_to(page: Page, k: int) -> str:
    steps = []
    while k >= 0:
        steps.append(page.containers[k].step)
        k = page.containers[k].parent
    return ">".join(reversed(steps))


def best_path(page: Page) -> tuple[str, float]:
    """Path of the best container and its share of the page's score; empty without containers."""
    ranked = [(c.score * c.bonus * (1 - c.linked / max(c.length, 1)), -k) for k, c in enumerate(page.containers) if c.length]
    if not ranked:
        return "", 0.0
    score, k = max(ranked)
    return path_to(page, _widened(page, -k)), score / sum(s for s, _ in ranked) if score else 0.0


def at_path(page: Page, path: str) -> list[bool]:
    """Which containers stand at the path."""
    steps = path.split(">")
    reached: list[int] = []  # number of the path's first steps that lead to the container, -1 beside the path
    for c in page.containers:
        k = reached[c.parent] if c.parent >= 0 else 0
        reached.append(k + 1 if 0 <= k < len(steps) and steps[k] == c.step else -1)
    return [k == len(steps) for k in reached]


def main_text(page: Page, path: str) -> str:
    """Blocks below all containers with the path, in page order."""
    below = at_path(page, path)
    for k, c in enumerate(page.containers):
        below[k] = below[k] or c.parent >= 0 and below[c.parent]
    return "\n".join(text for text, k in page.blocks if (k >= 0 and below[k]) or not path)


def paths(pages: DataFrame) -> DataFrame:
    """Per page its host, the path of its best container and that container's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_path(read(h.as_py() or "")) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["host", "path", "share"],
            )

    return pages.select("host", "html").mapInArrow(run, "host string, path string, share double")


def consensus(found: DataFrame) -> DataFrame:
    """The path of each host with most votes; among equals the larger share, then the path."""
    votes = found.where("host != '' AND path != ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("share").alias("share"))
    best = F.max(F.struct("votes", F.round("share", 6).alias("share"), "path"))
    return votes.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("winner"))


def extracted(pages: DataFrame) -> DataFrame:
    """Per page ``page_id``, ``url``, ``text`` and its code points ``n_chars``."""
    rows = picked(pages, page_id="page_id", url="url", html="html").withColumn("host", host_of(F.col("url")))
    winners = stage(consensus(paths(rows)))
    addressed = rows.join(winners, "host", "left").select("page_id", "url", "html", "winner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, winner in zip(batch.column("html"), batch.column("winner").to_pylist(), strict=True):
                page = read(source.as_py() or "")
                has = winner is not None and any(at and c.length for at, c in zip(at_path(page, winner), page.containers, strict=True))
                texts.append(main_text(page, winner if has else best_path(page)[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return addressed.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
