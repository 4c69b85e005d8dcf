"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies a block by where it stands (menus, footers,
forms, adverts, comments …), by the share of its text inside links, by its length and by its share of stop words. The
second pass gives undecided blocks, mostly short ones, the label of the nearest decided neighbour; a heading follows
the block after it. Blocks of an article are judged among themselves, and then nothing outside it is main text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from difflens.llm.common import slices, text_column

GOOD, BAD, OPEN = 1, -1, 0

# Frequent function words of some languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were we when your can said there "
    "der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch es an er so dass sie nach bei um "
    "le la les de du des et un une est que qui dans pour sur pas au avec plus par ce il ne se elle on "
    "el los las del y en que por con para una su al lo como más pero sus o este si "
    "il di che non per una sono della con è nel alla dei i o da um uma não com os as ao het een van dat op te zijn".split()
)

_QUOTED = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TAG = re.compile(rf"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_QUOTED})>")
_NAME = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)")
#: Elements that run to their end tag, or to the end of the page.
_RAW = re.compile(r"<(script|style|textarea)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "textarea")}
#: Tags up to this length are read by the pattern, longer ones by their quotes.
_NEAR = 512
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr td th option".split())
_OUTSIDE = frozenset("nav footer aside form dialog menu".split())
#: Elements whose text isn't read. The first have no blocks inside, so that a block ends them when their end tag is missing.
_PHRASES = frozenset("button select option optgroup svg math".split())
_UNREAD = _PHRASES | frozenset("noscript template iframe object canvas".split())
_IN_HEAD = frozenset("title meta link base script style noscript template".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main menu nav ol p pre section summary table tbody td th tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu)\b", re.I)
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Names that pages give to parts outside the main text, and to the main text.
_PARTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|banner|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|toolbar|sidebar|side|menu|nav\w*|breadcrumbs?|footer|footnav|header|masthead|topbar|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|discussion|respond|social|share|sharing|related|recommend\w*|widget|newsletter|subscribe|signup|login|form|search|pag(?:er|ination)|copyright|disclaimer|legal|tags?)(?:$|[\s_-])",
    re.I,
)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content)(?:[_-]?(?:body|content|text))?(?:$|\s)", re.I)
_CORE = re.compile(r"[^\W\d_](?:.*[^\W\d_])?", re.S)


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    outside: bool
    article: bool


class _TagEnds:
    """Where the tag that a place lies in ends: at the next ``>`` outside quotes, -1 without one. All places of a page
    together take time linear in its length, as each quote is followed once."""

    def __init__(self, page: str):
        self.page = page
        self.signs = [m.start() for m in re.finditer(r"[>\"']", page)]
        self.known: dict[int, int] = {}

    def __call__(self, at: int) -> int:
        passed, end = [], -1
        while True:
            i = bisect_left(self.signs, at)
            if i == len(self.signs):
                break
            sign = self.signs[i]
            if sign in self.known:
                end = self.known[sign]
                break
            if self.page[sign] == ">":
                end = sign
                break
            passed.append(sign)
            closing = self.page.find(self.page[sign], sign + 1)
            if closing < 0:
                break
            at = closing + 1
        for sign in passed:
            self.known[sign] = end
        return end


def pieces(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it is an end tag, attributes) of the page's markup in order. The tag is '' for comments,
    declarations, and raw elements with all they hold. A ``<`` that opens nothing is text."""
    ends = None
    last = page.rfind(">")
    at = page.find("<")
    while at >= 0:
        end, tag, closing, attrs = -1, "", False, ""
        if page.startswith("<!--", at):
            found = page.find("-->", at + 4)
            end = found + 3 if found >= 0 else len(page)
        elif m := _TAG.match(page, at, at + _NEAR):
            end, tag, closing, attrs = m.end(), m["tag"].lower(), bool(m["end"]), m["attrs"]
        elif at < last and (m := _NAME.match(page, at)):
            ends = ends or _TagEnds(page)
            if (found := ends(m.end())) >= 0:
                end, tag, closing, attrs = found + 1, m["tag"].lower(), bool(m["end"]), page[m.end() : found]
        if end < 0 and at + 1 < last and page[at + 1] in "!?/":
            end = page.index(">", at + 2) + 1
        if tag and (raw := _RAW.match(page, at)):
            found = _RAW_END[raw[1].lower()].search(page, end)
            end, tag, closing, attrs = found.end() if found else len(page), "", False, ""
        if end >= 0:
            yield at, end, tag, closing, attrs
        at = page.find("<", max(end, at + 1))


class _Open:
    """The open elements, with counts of what is asked about them, so that depth costs nothing."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.tags: Counter = Counter()
        self.outside = self.article = self.unread = 0

    @property
    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def push(self, tag: str, outside: bool, article: bool) -> None:
        self.stack.append((tag, outside, article))
        self._count(1, tag, outside, article)

    def pop(self) -> str:
        one = self.stack.pop()
        self._count(-1, *one)
        return one[0]

    def _count(self, by: int, tag: str, outside: bool, article: bool) -> None:
        self.tags[tag] += by
        self.outside += by * outside
        self.article += by * article
        self.unread += by * (tag in _UNREAD)

    def leave(self, tag: str) -> None:
        """Close the innermost ``tag`` and all inside it; nothing, if none is open."""
        if self.tags[tag]:
            while self.pop() != tag:
                pass


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with references decoded and white space turned into single blanks. Time is linear in
    the page's length, also for markup that is never closed."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    opened = _Open()
    heading = ""
    link = 0

    def close():
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            chars = len(" ".join(html.unescape("".join(linked)).split()))
            out.append(Block(text, chars, bool(heading), opened.outside > 0, opened.article > 0))
        parts.clear()
        linked.clear()

    def read(text):
        if opened.top == "head" and text.strip():
            opened.pop()
        if not opened.unread and not opened.tags["head"]:
            parts.append(text)
            if link:
                linked.append(text)

    at = 0
    last_end: dict[str, int] = {}
    for start, stop, tag, ends, attrs in pieces(page):
        if start > at:
            read(page[at:start])
        at = stop
        if not tag:
            continue
        if tag == "head" and ends or not ends and tag not in _IN_HEAD:  # the end tag of head may be missing
            if opened.tags["head"] and not opened.unread:
                while opened.tags["head"]:
                    opened.pop()
                close()
        if not ends and tag in _BLOCKS:
            while opened.top in _PHRASES:
                opened.pop()
        if tag in _UNREAD:
            if ends:
                opened.leave(tag)
            elif not attrs.rstrip().endswith("/"):
                if tag not in last_end:
                    last_end[tag] = max((e.start() for e in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
                if tag in _PHRASES or last_end[tag] > at:
                    opened.push(tag, True, False)
            continue
        if tag in _INLINE:
            if tag == "a":
                link = 0 if ends else 1
            elif tag in ("br", "img"):
                parts.append(" ")
                linked.append(" ")
            continue
        close()
        if tag in _HEADINGS:
            heading = "" if ends else tag
            continue
        heading = ""
        if tag in _VOID or tag in _LEAVES and not attrs.strip():
            continue
        if ends:
            opened.leave(tag)
            continue
        if attrs.rstrip().endswith("/"):
            continue
        if tag in _LEAVES:  # a leaf ends the one before it
            while opened.top in _LEAVES:
                opened.pop()
        opened.push(tag, *_place(tag, attrs, opened.article > 0))
    if at < len(page):
        read(page[at:])
    close()
    return out


def _place(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is outside the main text, and whether it is an article."""
    names = " ".join(a or b or c for a, b, c in _NAMED.findall(attrs))
    main = tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articlebody", attrs, re.I))
    outside = tag in _OUTSIDE or tag == "header" and not in_article or bool(_ROLES.search(attrs) or _HIDDEN.search(attrs))
    if names and not main:
        outside = outside or bool(_PARTS.search(names)) and tag not in ("body", "html")
        main = not outside and tag in ("div", "section", "td") and bool(_MAIN.search(names))
    elif names and tag == "article" and in_article:
        outside = outside or bool(_PARTS.search(names))
    return outside, main


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum((m := _CORE.search(w)) is not None and m[0] in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(b: Block, short: int = 70, long: int = 200, links: float = 0.4, low: float = 0.12, high: float = 0.25) -> int:
    """The label of a block from itself alone; undecided if it is short, or long enough but poor in stop words."""
    if b.outside or b.link_chars > links * len(b.text):
        return BAD
    share = stop_share(b.text)
    if b.article:
        return GOOD if len(b.text) >= short and share >= low else OPEN
    if len(b.text) < short:
        return BAD if b.link_chars else OPEN
    if share >= high and len(b.text) >= long:
        return GOOD
    return OPEN if share >= low else BAD


def labels(page: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    first = [first_pass(b) for b in page]
    if any(b.article and not b.outside for b in page):
        # An article's own blocks decide among themselves; undecided ones stay when nothing speaks against them.
        first = [f if b.article else BAD for f, b in zip(first, page)]
        own = [i for i, b in enumerate(page) if b.article and not b.outside]
        decided = {i: GOOD for i in own if first[i] == GOOD} or {i: GOOD for i in own if first[i] == OPEN}
        decided |= {i: BAD for i in own if first[i] == BAD}
    else:
        own = list(range(len(page)))
        decided = {i: f for i, f in enumerate(first) if f != OPEN}
    out = [False] * len(page)
    before: int | None = None
    previous: dict[int, int | None] = {}
    for i in own:
        before = i if i in decided else before
        previous[i] = before
    after: int | None = None
    for i in reversed(own):
        after = i if i in decided else after
        near = [j for j in (previous[i], after) if j is not None]
        if not near:
            continue
        if page[i].heading and i not in decided and after is not None:
            out[i] = decided[after] == GOOD
        else:  # the nearer one; if both are as near and disagree, main text keeps articles' blocks and whole sentences
            best = min(abs(j - i) for j in near)
            said = [decided[j] == GOOD for j in near if abs(j - i) == best]
            out[i] = any(said) if page[i].article or page[i].text[-1] in ".!?…\"”»" else all(said)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, labels(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without main text, have the text ''. Pages of any length are read whole. Repeated
    rows stay; other columns are ignored. No rows give no rows.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract_batches, "page_id long, url string, text string")


def _extract_batches(batches):
    for whole in batches:
        named = whole.rename_columns(["page_id", "url", "text"])
        for batch in slices(named):
            texts = [main_text(h) for h in text_column(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])
