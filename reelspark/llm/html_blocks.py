"""Main text of web pages by two passes over their blocks."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PAGE_SCHEMA = "page_id long, url string, text string, n_blocks int, n_kept int"

LONG_CHARS = 120
SHORT_CHARS = 60
LINK_DENSITY = 0.5
STOP_DENSITY = 0.2

STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out so what up into "
        "der die und das von zu den mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
        "le la les des et un une du dans est que qui par pour il au sur pas plus se ne ce avec sont son cette aux mais comme ou si leur ont être nous vous elle été fait tout même entre sans deux "
        "el los las una por con para del al lo como su más pero sus le ya este sí porque esta cuando muy sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos"
    ).split()
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noframes svg math select".split())
# Elements whose content is never the article; the last four give way to an article that opens inside.
CHROME = frozenset("aside button dialog menu datalist object audio video canvas nav header footer form".split())
YIELDING = frozenset("nav header footer form".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body"))
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CHROME_NAMES = re.compile(
    r"(?:nav|navbar|navigation|menu|menus|sidebar|side|aside|footer|foot|masthead|topbar|breadcrumbs?|pagination|pager|ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|"
    r"comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|widget|toolbar|hidden|skip)",
    re.I,
)
HEADER_NAMES = re.compile(r"header|head", re.I)
# Names that tell what an element is wherever they stand in a compound one.
ANYWHERE = re.compile(
    r"(?:(?:user|reader|post|page|site|blog)?comments?(?:list|area|box|section|form)?|disqus|respond|replies|cookies?|consent|gdpr|notices?|ads?|advert\w*|adsense|sponsor\w*|promo\w*|"
    r"newsletter|subscribe|share|sharing|breadcrumbs?|pagination)",
    re.I,
)
# Names that say little inside an article unless nothing but a container is named with them.
WEAK = re.compile(r"search|login|signup|widget|toolbar|side|banner|alert|popup|modal|overlay|menu|menus|related|recommended|hidden|skip|foot|social", re.I)
CONTAINER = frozenset("area bar block box button container content field form group holder icon inner item items link links list outer panel row section wrap wrapper".split())
PARTS = re.compile(r"[_\-:.]+|(?<=[a-z0-9])(?=[A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names that begin like this tell what an element has or does, not what it is.
STATES = frozenset("has no not without with is js show hide toggle open close".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    in_main: bool
    named: bool = False  # lies in an element that only its class or id names a menu or the like
    freed: bool = False  # of those: in an article that opens inside
    heading: bool = False


def _names_chrome(name: str, value: str, in_main: bool) -> bool:
    """Whether a class or id says menu, advert or the like: some names as any part, others as the first or last one."""
    found = value.split()
    for whole in found[:1] if name in MAIN else found:  # "post related" is a post
        parts = [p for p in PARTS.split(whole) if p]
        states = [i for i, p in enumerate(parts) if p.lower() in STATES]
        parts = parts[: states[0]] if states else parts  # "layout-with-sidebar" is a layout
        if any(ANYWHERE.fullmatch(p) for p in parts):
            return True
        for part in (parts[0], parts[-1]) if parts else ():
            if CHROME_NAMES.fullmatch(part):
                others = [p for p in parts if p is not part]
                if not in_main or not WEAK.fullmatch(part) or all(p.lower() in CONTAINER or CHROME_NAMES.fullmatch(p) for p in others):
                    return True
            elif not in_main and HEADER_NAMES.fullmatch(part):
                return True
    return False


def _is_chrome(name: str, attrs: str, in_main: bool) -> bool | None:
    """True: left out. None: only the class or id of a block says so."""
    if name in WHOLE:
        return False
    if name == "header":
        return not in_main
    if name in CHROME:
        return True
    if not attrs.strip():
        return False
    named = False
    for key, a, b, c in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            named = named or _names_chrome(name, value, in_main)
        elif key == "role" and value.lower() in CHROME_ROLES:
            return True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return (None if name in BLOCK else True) if named else False


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, without those in menus, forms and the like; those in elements named so are marked."""
    out: list[Block] = []
    pieces: list[str] = []
    link_chars = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # name, opens chrome, opens main, is named chrome
    chrome = main = links = names = 0

    def finish() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                block = Block(text, link_chars, main > 0, names > 0, heading=any(entry[0] in HEADINGS for entry in stack))
                if names and main:
                    last = max(i for i, entry in enumerate(stack) if entry[3])
                    block.freed = any(entry[2] for entry in stack[last + 1 :])
                out.append(block)
            pieces.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if chrome or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            link_chars += len("".join(text.split()))

    def leave(to: int) -> None:
        nonlocal chrome, main, links, names
        if any(entry[3] for entry in stack[to:]):
            finish()
        for name, is_chrome, is_main, is_named in stack[to:]:
            chrome -= is_chrome
            main -= is_main
            names -= is_named
            links -= name == "a"
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if name is None:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        closes = bool(found["close"] or found["close2"])
        attrs = found["attrs"] or found["attrs2"] or ""
        if name == "br" or name == "wbr":
            if name == "br" and not chrome:
                pieces.append(" ")
            continue
        if name in BLOCK:
            finish()
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name in VOID or (attrs.endswith("/") and name not in BLOCK):
            continue
        if name in BLOCK or name == "a":
            # A block ends an open paragraph, an item an open item, a link an open link.
            ended = {"li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "a": ("a",)}.get(name, ("p",))
            walls = ("ul", "ol", "dl", "table", "article", "main", "section", "div", "aside", "nav", "footer", "form", "body") if name != "a" else tuple(BLOCK)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in walls:
                    break
                if stack[i][0] in ended:
                    leave(i)
                    break
        if name in MAIN:
            # An article does not lie inside a menu or a page header: that one was never closed.
            for i, (other, is_chrome, *_) in enumerate(stack):
                if is_chrome:
                    if other in YIELDING:
                        leave(i)
                    break
        verdict = _is_chrome(name, attrs, main > 0)
        is_chrome, is_named = verdict is True, verdict is None
        is_main = name in MAIN and verdict is False
        stack.append((name, is_chrome, is_main, is_named))
        chrome += is_chrome
        main += is_main
        names += is_named
        links += name == "a"
    finish()
    return out


def stop_density(text: str) -> float:
    """Share of stop words among the words of a text."""
    found = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / max(1, len(found))


def first_pass(block: Block) -> bool | None:
    """Keep, drop, or undecided: by link density, then length and stop-word density. Few stop words alone drop nothing."""
    size = len(block.text)
    if block.link_chars > LINK_DENSITY * len(block.text.replace(" ", "")):
        return False
    if size <= SHORT_CHARS:
        return None
    density = stop_density(block.text)
    if density >= STOP_DENSITY:
        # A marked article is evidence too: there a shorter block is enough.
        return True if size > LONG_CHARS or block.in_main else None
    return None


def main_blocks(page: str | None) -> tuple[list[str], int]:
    """Kept blocks of a page in order, and the number of blocks outside menus and the like."""
    every = blocks_of(page) if page else []
    # An article in an element that is only named like a menu frees itself where the page has no other.
    free = not any(b.in_main and not b.named for b in every)
    found = [b for b in every if not b.named or (free and b.freed)]
    kept = labelled(found)
    if not kept and len(found) < len(every):
        # Names alone never empty a page.
        found, kept = every, labelled(every)
    return kept, len(found)


def labelled(found: list[Block]) -> list[str]:
    """Texts of the blocks that both passes keep."""
    labels = [first_pass(b) for b in found]
    if True not in labels:
        # Stop words say nothing here (another language, a table, code): length and links alone decide.
        labels = [True if label is None and len(b.text) > LONG_CHARS else label for b, label in zip(found, labels)]
    # Outside an article; inside it, a block of links speaks for itself alone.
    decided = [i for i, (b, label) in enumerate(zip(found, labels)) if label is not None and not b.in_main]
    kept = []
    for i, (block, label) in enumerate(zip(found, labels)):
        if label is None and block.in_main:
            label = True
        elif label is None and not decided:
            label = False
        elif label is None:
            at = bisect.bisect(decided, i)
            near = decided[max(0, at - 1) : at + 1]
            if block.heading and at < len(decided):
                near = [decided[at]]  # a heading belongs to what follows
            distance = min(abs(i - j) for j in near)
            label = any(labels[j] for j in near if abs(i - j) == distance)
        if label:
            kept.append(block.text)
    return kept


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of web pages.

    The project keeps no web pages, so the operator is general. pages: page_id (long), url, html. Other
    columns are ignored. Elements that never hold the article (scripts, forms, menus, notices, adverts,
    reader comments, by element, role or class name) are left out. Of a class or id some names count as any part
    (comments, notice, advert), others as the first or last; an article inside frees itself from it where the page has
    no other, and where nothing else of the page is kept names are ignored. Pass one labels the other blocks by
    link density, length and share of stop words (English, German, French, Spanish). Short blocks and those with
    few stop words stay undecided; where stop words decide none, long blocks are kept. In pass two they take the label of the nearest decided block outside
    articles (of two at equal distance, of the kept one; a heading that of the next one). An article or main
    element is one more input: in it a block with many stop words need not be long, and a block of links drops itself but
    not its neighbours, so undecided ones stay. Blocks outside are judged as on any page.

    Returns page_id, url, text (kept blocks, white space folded, joined by two newlines), n_blocks and
    n_kept. A null, empty or text-less page has the empty text. Repeated rows are each returned, null
    ids and urls too. Pages of any length are read whole. An empty table gives an empty result.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [main_blocks(p.as_py()) for p in batch.column("html")]
            text = pa.array(["\n\n".join(kept) for kept, _ in done], pa.string())
            counts = [pa.array([n for _, n in done], pa.int32()), pa.array([len(kept) for kept, _ in done], pa.int32())]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), text, *counts], ["page_id", "url", "text", "n_blocks", "n_kept"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(step, PAGE_SCHEMA)
