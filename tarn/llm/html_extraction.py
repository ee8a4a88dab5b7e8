"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass decides each
block by what it is made of:

- inside an element that is boilerplate by its name, role, class or id (menus,
  headers, footers, sidebars, notices, adverts, forms, comments): bad. A class,
  id or role says nothing about the page, an article or main part, or an element
  that holds one, nor does the id of a heading or a name of a state (no-sidebar).
  Words that also occur in names of content (legal, related) only count as bad if
  they are a whole class or role; else they make the block ambiguous, unless it is
  long and dense;
- share of its characters inside links over LINKS_HIGH: bad;
- long and dense in stop words: good; dense but shorter: good inside the main
  part, else ambiguous; long with few stop words: bad outside the main part; the
  rest is ambiguous. On a page that hardly has the listed stop words, as it is in
  another language, density says nothing: long blocks are good.

The second pass gives every ambiguous block the label of the nearest decided
blocks before and after it among those of the same part of the page (the
article, or what is outside); where they differ, the nearer one counts. In a
tie, and without a decided neighbour, the part itself counts: an article is
good, the rest bad. Where articles hold at least half of the good text, what is
outside of them goes; else they are teasers, and all good text stays.

Scripts, styles, comments and other raw elements are never text. White space
inside a block becomes one space; blocks are joined by one line feed.

A page is read once, in time that grows with its length, whatever its tags.

Defined cases: a null or empty page, or one without main text, gives an empty
string. Unclosed elements (paragraphs, list items, cells, rows, options) end where
browsers end them, and unfinished tags, comments and references and stray signs
are read as browsers do, as near as a page without a tree allows; where a quote
that is not closed would swallow the rest of the page, tags end at the next >. Rows, repeated ones too,
stay as they are; an empty table gives an empty result. No page or block is
cut. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import column, map_texts

LENGTH_LOW, LENGTH_HIGH = 40, 140
STOP_LOW, STOP_HIGH = 0.1, 0.2
#: Share of listed stop words below which a page is in another language.
STOP_PAGE = 0.03
LINKS_HIGH = 0.5

#: Frequent words of the languages at hand (fixed values).
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has have he in is it its not of on or she that the they this to was were with you
    au aux avec ce dans de des du elle en et est il je la le les ne nous on ou par pas pour que qui sa se son sur un une
    al como con de del el en es la las lo los no o para pero por que se su sus un una y
    als am an auf aus bei das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von war zu
    """.split()
)
#: Elements whose content is not text of the page (fixed values).
RAW = ("script", "style", "template", "noscript", "textarea", "iframe", "title")
#: Elements that aren't text of the page either, but end at the next block-level tag if they are not closed (fixed values).
INERT = ("select", "svg", "math", "object")
#: Elements that hold no main text (fixed values).
BOILERPLATE = frozenset("nav footer aside form button dialog menu fieldset header".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary
    table tbody td tfoot th thead tr ul""".split()
)
OPTIONS = frozenset(("optgroup", "option", "hr"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that name boilerplate (fixed values); an article may have a header of its own.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal"
    r"|overlay|nav|navbar|navigation|menu\w*|breadcrumbs?|(?P<header>header|masthead)|footer|copyright|legal|sidebar"
    r"|side|aside|widget|comments?|respond|replies|disqus|share|sharing|social|related|recommended|newsletter"
    r"|subscribe|signup|login|search|toolbar|skip|complementary|contentinfo)(?=$|[\s_-])"
)
#: Of these words, those that also name content, and names that tell a state (fixed values).
WEAK = frozenset(
    """alert banner consent copyright legal login notice promo recommended related replies respond search share sharing
    side signup skip social subscribe""".split()
)
STATE = re.compile(r"(?:no|not|has|have|with|without|is|hide|show)[_-]|.*[_-](?:open|opened|closed|enabled|disabled|on|off)$")
PAGE = frozenset("html head body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag ends if they are open, unless one of the second kind is open within them (fixed values).
_CELL, _ROW = (("td", "th"), ("tr", "table")), (("tr",), ("table",))
ENDED = {
    **dict.fromkeys(("li",), [(("li",), ("ul", "ol", "menu", "dir"))]),
    **dict.fromkeys(("dt", "dd"), [(("dt", "dd"), ("dl",))]),
    **dict.fromkeys(("td", "th"), [_CELL]),
    **dict.fromkeys(("tr",), [_ROW, _CELL]),
    **dict.fromkeys(("thead", "tbody", "tfoot"), [(("thead", "tbody", "tfoot"), ("table",)), _ROW, _CELL]),
    **dict.fromkeys(("option", "optgroup"), [(("option",), ("select",))]),
}


def _token(rest: str, end: str) -> re.Pattern:
    """No part of it is tried at more than a few places of a page: what follows < ends with the page at the latest."""
    return re.compile(
        r"<!--(?:>|->|.*?(?:--!?>|\Z))"
        r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
        r"|<(?P<inert>" + "|".join(INERT) + r")(?=[\s/>])(?:(?!<(?P=inert)[\s/>]).)*?</(?P=inert)(?=[\s/>])[^>]*+(?:>|\Z)"
        r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>" + rest + ")(?:>|" + end + ")"
        r"|<[!?/][^>]*+>?"
        r"|(?P<text>[^<]++|<)",
        re.IGNORECASE | re.DOTALL,
    )


#: Quoted values may hold a >; a tag that would so take the rest of the page is read by LOOSE, and so are those behind it.
STRICT = _token(r"""(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+""", r"(?P<open>\Z)")
LOOSE = _token(r"[^>]*+", r"\Z")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
STRIPPED = " .,;:!?\"'()[]{}|#$%&*"


@dataclass
class Tag:
    """An open tag; hints are what its attributes say, which an article within it takes back."""

    name: str
    bad: bool = False
    main: bool = False
    hinted: bool = False
    weak: bool = False
    outer: Tag | None = None  # the next open tag around it that says something
    any_bad: bool = False  # of itself and those around it, known at the page's end
    any_weak: bool = False


@dataclass
class Block:
    text: str
    linked: int
    tag: Tag | None  # the innermost open one that says something
    main: bool
    label: bool | None = field(default=None)

    @property
    def bad(self) -> bool:
        return self.tag is not None and self.tag.any_bad

    @property
    def weak(self) -> bool:
        return self.tag is not None and self.tag.any_weak


class OpenTags:
    """The open tags, with what has to be known of them at each token."""

    def __init__(self):
        self.tags: list[Tag] = []
        self.places: dict[str, list[int]] = {}  # of each name
        self.telling: list[Tag] = []  # those open that say something
        self.all_telling: list[Tag] = []
        self.main = self.inert = self.inline = 0  # open main parts, inert elements and boilerplate within a line

    def push(self, tag: Tag) -> None:
        self.places.setdefault(tag.name, []).append(len(self.tags))
        self.tags.append(tag)
        self.main += tag.main
        self.inert += tag.name in INERT
        self.inline += (tag.bad or tag.hinted) and tag.name not in BLOCK
        if tag.bad or tag.hinted or tag.weak:
            tag.outer = self.telling[-1] if self.telling else None
            self.telling.append(tag)
            self.all_telling.append(tag)

    def pop(self) -> Tag:
        tag = self.tags.pop()
        self.places[tag.name].pop()
        self.main -= tag.main
        self.inert -= tag.name in INERT
        self.inline -= (tag.bad or tag.hinted) and tag.name not in BLOCK
        if self.telling and self.telling[-1] is tag:
            self.telling.pop()
        return tag

    def last(self, names: tuple[str, ...]) -> int:
        """The place of the innermost open tag of these names, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def end(self, names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """End the innermost of these, if none of `within` is open inside it."""
        at = self.last(names)
        if at > self.last(within):
            while len(self.tags) > at:
                self.pop()

    def take_back_hints(self) -> None:
        for tag in self.telling:
            self.inline -= tag.hinted and not tag.bad and tag.name not in BLOCK
            tag.hinted = tag.weak = False
        self.telling = [t for t in self.telling if t.bad]


def _hinted(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """Whether a tag's attributes name boilerplate, surely and perhaps; inside the main part, headers don't count."""
    if "=" not in rest or name in PAGE:
        return False, False
    sure = perhaps = False
    for kind, *values in ATTRIBUTE.findall(rest):
        kind = kind.lower()
        if kind == "id" and name in HEADINGS:
            continue
        for token in "".join(values).lower().split():
            if STATE.match(token):
                continue
            for m in HINT.finditer(token):
                if inside and m["header"]:
                    continue
                word = m[0].strip("_-")
                weak = word in WEAK and (kind == "id" or word != token)
                sure, perhaps = sure or not weak, perhaps or weak
    return sure, perhaps


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked = links = at = 0
    tags, token = OpenTags(), STRICT

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, linked, tags.telling[-1] if tags.telling else None, tags.main > 0))
            parts.clear()

    while at < len(page):
        m = token.match(page, at)
        if token is STRICT and m["open"] is not None and ">" in m[0]:
            token = LOOSE
            m = token.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            if not tags.inline:  # else boilerplate within a line, such as a share link
                parts.append(text)
                linked += len(text) if links else 0
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if m["close"] else 1
        if name in BLOCK:
            flush()
            linked = 0
            if name not in OPTIONS and not m["close"]:
                while tags.inert:
                    tags.pop()
            links = 0 if m["close"] else links
        if m["close"]:
            tags.end((name,))
            continue
        if name in VOID:
            continue
        if name in INERT:
            if not m["rest"].endswith("/"):
                tags.push(Tag(name, bad=True))
            continue
        for ended, within in ENDED.get(name, ()):
            tags.end(ended, within)
        inside = tags.main > 0
        hinted, weak = _hinted(name, m["rest"], inside)
        if name in MAIN:
            tags.take_back_hints()
        if name == "p":
            # A paragraph ends where the next block begins, closed or not.
            while tags.tags and tags.tags[-1].name == "p":
                tags.pop()
        if hinted or name in BLOCK and (weak or name != "p"):
            if tags.tags and tags.tags[-1].name == "p" and name in BLOCK:
                tags.pop()
            bad = name in BOILERPLATE and not (name == "header" and inside)
            tags.push(Tag(name, bad, name in MAIN, hinted, weak and name in BLOCK))
    flush()
    for tag in tags.all_telling:  # outer ones first
        tag.any_bad = tag.bad or tag.hinted or (tag.outer is not None and tag.outer.any_bad)
        tag.any_weak = tag.weak or (tag.outer is not None and tag.outer.any_weak)
    return blocks


def stop_words(block: Block) -> tuple[int, int]:
    """How many of a block's words are listed stop words, and how many words there are."""
    words = [w.strip(STRIPPED) for w in block.text.lower().split()]
    return sum(w in STOP_WORDS for w in words), len(words)


def decide(block: Block, density: float | None) -> bool | None:
    """The first pass: good, bad or ambiguous. density: the block's share of stop words, None if it says nothing."""
    if block.bad or block.linked > LINKS_HIGH * len(block.text):
        return False
    long = len(block.text) >= LENGTH_HIGH
    if density is None:
        return True if long else None
    if block.weak:
        return True if long and density >= STOP_HIGH else None
    if long:
        if density >= STOP_HIGH:
            return True
        return None if density >= STOP_LOW or block.main else False
    if density >= STOP_HIGH and len(block.text) >= LENGTH_LOW:
        return True if block.main else None
    return None


def main_text(page: str) -> str:
    """The main text of a page."""
    blocks = page_blocks(page)
    counts = [(0, 1) if b.bad else stop_words(b) for b in blocks]
    known = sum(n for n, _ in counts) >= STOP_PAGE * sum(n for b, (_, n) in zip(blocks, counts) if not b.bad)
    for b, (stops, words) in zip(blocks, counts):
        b.label = decide(b, stops / words if known else None)
    for main in (True, False):
        part = [b for b in blocks if b.main == main and not b.bad]
        decided = [i for i, b in enumerate(part) if b.label is not None]
        before = -1
        for i, b in enumerate(part):
            while before + 1 < len(decided) and decided[before + 1] <= i:
                before += 1
            if b.label is None:
                near = [decided[k] for k in (before, before + 1) if 0 <= k < len(decided)]
                b.label = part[min(near, key=lambda k: (abs(k - i), part[k].label != main))].label if near else main
    good = {main: sum(len(b.text) for b in blocks if b.label and b.main == main) for main in (True, False)}
    alone = good[True] > 0 and good[True] >= good[False]
    return "\n".join(b.text for b in blocks if b.label and (b.main or not alone))


def extracted(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of pages: id, url, text (the main text), n_chars (its code points)."""
    rows = pages.select(
        column(id_col).alias("id"), column(url_col).alias("url"), column(html_col).cast("string").alias("html")
    )

    def work(texts):
        return {"text": [main_text(t) for t in texts]}

    found = map_texts(rows, [T.StructField("text", T.StringType())], lambda: work, text_col="html")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
