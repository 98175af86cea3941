"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block
from what it is and where it stands: menus, headers, footers, sidebars, notices,
adverts, forms and reader comments (by element, role or class name) and blocks
that are mostly links are boilerplate; long blocks with the stop-word density
of running text are content. Short blocks, and long ones with few stop words,
stay open. In the second pass every open block takes the label of its nearest
decided neighbour (on a tie: content inside an article, else what follows a
heading, else the earlier). If the page marks its article, neighbours are
sought inside it, its edges count as content, and blocks outside are
boilerplate; otherwise the edges of the page count as boilerplate.

Stop words are those of four languages. Where they decide no block of a page
without an article (another language, or short paragraphs only), length and link
density decide alone: blocks of LONG_WORDS words, or of LONG_CHARS characters
where the script has no blanks, are content, and if there is none of these
either, all open blocks are. If all of the page stands in containers that only
their class names call boilerplate, these names are not believed and the page is
judged without them.

Class and id names are read token by token: a token is boilerplate by one of its
parts (``site-footer``), but not by a part that a word of state governs
(``no-sidebar``, ``content-with-sidebar``, ``has-related-posts``).

Nulls: a null html is the empty page, whose text is empty; null ids and urls
are passed through. A page without blocks gives "". Repeated rows each give a
row; an empty table gives an empty result. Unclosed tags, comments, scripts and
character references are read as browsers do, so nothing crashes on broken
pages. Only the named columns are read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"

#: Elements without text of the page, whatever they hold.
SKIPPED = "script style noscript template textarea select button option svg canvas iframe object audio video head title datalist"
#: Elements that begin and end a block.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
            "thead tr ul".split())
#: Elements that never have content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ARTICLE = {"article", "main"}
BOILERPLATE_TAGS = set("nav footer aside form dialog menu search fieldset".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Class and id words of boilerplate.
BOILERPLATE_NAMES = set(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget widgets".split())
#: A container with one of these names stays boilerplate even around an article element.
FIRM_NAMES = set("comment comments commentlist disqus replies respond sidebar related recommended ad ads advert advertisement".split())

#: Name parts that say something about what follows them in a class name instead of naming the element.
STATE_NAMES = set("no not has have with without is hide hides hidden show shows enable enabled disable disabled".split())

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset((
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in "
    "into is it its more most my no not of on one only or other our out over she so some such than that the their them then there these "
    "they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer eines er es für hat hatte "
    "ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn wer wie wir wird zu "
    "zum zur au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre "
    "nous on ou où par pas pour qu que qui sa se ses son sur ta te tu un une vos votre vous y "
    "al algo como con cuando del desde donde el ella ellos entre era es esta estas este esto estos fue ha hay la las le lo los más mi muy "
    "nada ni no nos o otro para pero poco por porque qué quien se sin sobre su sus también te tiene todo un una unos ya yo").split())

LONG_WORDS = 15
#: Long without stop words and blanks: characters of a script that does not part its words.
LONG_CHARS = 40
STOP_DENSITY = 0.15
LINK_DENSITY = 0.5

_SKIP = "|".join(SKIPPED.split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({_SKIP})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|(?=<body\b)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAME = re.compile(r"[a-z0-9]+")
#: Scripts written without blanks: Thai to Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_STRIP = ".,;:!?\"'()[]{}#*$%&|<>…«»„“”‘’"


@dataclass
class Open:
    """An open element: is it boilerplate (firmly?), is it an article."""
    tag: str
    bad: bool = False
    firm: bool = False
    article: bool = False


def _name_words(value: str) -> set[str]:
    """Parts of the class or id tokens that name the element."""
    out = set()
    for token in value.split():
        parts = _NAME.findall(token)
        state = next((k for k, part in enumerate(parts) if part in STATE_NAMES), len(parts))
        out.update(parts[:state])
    return out


@dataclass
class Block:
    bad: bool
    article: int
    heading: bool
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: bool | None = None


def _names(tag: str, attributes: str, by_name: bool) -> tuple[bool, bool]:
    """Whether the element is boilerplate, and firmly so; class and id names
    count if ``by_name``."""
    bad = tag in BOILERPLATE_TAGS
    if not attributes or tag in ("html", "body"):
        return bad, False
    firm = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and by_name:
            words = _name_words(value)
            if tag not in ARTICLE:
                bad = bad or not words.isdisjoint(BOILERPLATE_NAMES)
            else:
                bad = bad or not words.isdisjoint(FIRM_NAMES)
            firm = firm or not words.isdisjoint(FIRM_NAMES)
        elif name == "role":
            bad = bad or value.strip() in BOILERPLATE_ROLES
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
            bad = firm = True
    return bad, firm


def split_blocks(page: str, by_name: bool = True) -> list[Block]:
    """The page's blocks that have text, in order."""
    stack: list[Open] = []
    out: list[Block] = []
    articles = in_link = 0
    article_id = -1
    heading = False
    current: Block | None = None

    def state() -> tuple[bool, int]:
        bad = firm = False
        art = -1
        for o in stack:
            firm = firm or o.firm
            if o.article and not o.bad and not firm:
                bad, art = False, article_id
            else:
                bad = bad or o.bad or (o.tag == "header" and art < 0)
        return bad, art

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if not raw.strip():
                return
            bad, art = state()
            current = Block(bad, art, heading)
        current.parts.append(raw)
        if in_link:
            current.link_chars += len(raw)

    def close() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join(html.unescape("".join(current.parts)).split())
            if current.text:
                out.append(current)
            current = None

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() in ("option", "head", "title"):
                close()
            continue
        if m[2]:
            if tag in BLOCK:
                close()
                heading = heading and tag not in HEADINGS
                in_link = 0
            if tag == "a":
                in_link = 0
            if any(o.tag == tag for o in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = 1
        if tag in BLOCK:
            close()
            in_link = 0
            heading = tag in HEADINGS
            for sibling in ("p", "li", "td", "th", "tr", "dt", "dd"):
                if stack and stack[-1].tag == sibling and (sibling == "p" or sibling == tag):
                    stack.pop()
                    break
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCK:
            continue
        bad, firm = _names(tag, m[4], by_name)
        if tag in ARTICLE and not any(o.article for o in stack):
            articles += 1
            article_id = articles
        if bad or tag in BLOCK and tag != "p" or tag == "p" and bad:
            stack.append(Open(tag, bad, firm, tag in ARTICLE))
    add(page[at:])
    close()
    return out


def linked(b: Block) -> bool:
    """Mostly links."""
    return b.link_chars > LINK_DENSITY * sum(map(len, b.parts))


def first_pass(b: Block) -> bool | None:
    words = b.text.split()
    if b.bad or linked(b):
        return False
    if len(words) >= LONG_WORDS and not b.heading:
        stops = sum(w.strip(_STRIP).lower() in STOP_WORDS for w in words)
        if stops >= STOP_DENSITY * len(words):
            return True
    return None


def by_length(b: Block) -> bool | None:
    """The first pass where stop words decide nothing."""
    if b.label is None and not b.heading:
        if len(b.text.split()) >= LONG_WORDS or len(_UNSPACED.findall(b.text)) >= LONG_CHARS:
            return True
    return b.label


def second_pass(blocks: list[Block], edge: bool) -> None:
    """Open blocks inherit from the nearest decided neighbour; ``edge`` is the
    label beyond the first and last block."""
    n = len(blocks)
    before: list[tuple[int, bool]] = []
    last = (-1, edge)
    for i, b in enumerate(blocks):
        before.append(last)
        if b.label is not None and not (b.bad and edge):
            last = (i, b.label)
    last = (n, edge)
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        if b.label is None:
            (p, left), (q, right) = before[i], last
            nearer = left if i - p < q - i else right if q - i < i - p else (edge or (right if b.heading else left))
            b.label = left if left == right else nearer
        elif not (b.bad and edge):
            last = (i, b.label)


def main_text(page: str) -> tuple[str, int, int]:
    """Text, number of blocks, number of blocks kept."""
    found = split_blocks(page)
    if found and all(b.bad for b in found):
        unnamed = split_blocks(page, by_name=False)
        if sum(len(b.text.split()) >= LONG_WORDS and not b.bad and not linked(b) for b in unnamed):
            found = unnamed
    for b in found:
        b.label = first_pass(b)
    inside = [b for b in found if b.article >= 0]
    if any(not b.bad for b in inside):
        for k in sorted({b.article for b in inside}):
            second_pass([b for b in inside if b.article == k], True)
        kept = [b for b in inside if b.label]
    else:
        if not any(b.label for b in found):
            for b in found:
                b.label = by_length(b)
            if not any(b.label for b in found):
                for b in found:
                    b.label = b.label is None
        second_pass(found, False)
        kept = [b for b in found if b.label]
    return "\n".join(b.text for b in kept), len(found), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: SCHEMA."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for i, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                text, n, kept = main_text(page)
                rows.append((i, url, text, len(text), n, kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return named.mapInArrow(run, SCHEMA)
