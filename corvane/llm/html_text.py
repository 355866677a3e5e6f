"""Main text of web pages by scoring the element tree.

Paragraphs give points for length and commas to the elements around them, less with each level;
an element's points are discounted by the share of its text that is link text. The best container
is kept with those of its siblings that score or read like it. Menus, forms and the like are
dropped wherever they stand. Pages are handled one by one inside their partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.base import table

# Element names by their part in a page.
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption header footer nav aside form fieldset address details summary center dialog hgroup menu search".split())
DROPPED = frozenset("nav footer aside form menu dialog search fieldset head title".split())
RAW = frozenset("script style noscript template iframe svg math canvas object audio video select textarea button title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset(["br", "hr"])
HEAD = frozenset("base link meta head".split())
PARAGRAPHS = frozenset("p pre td blockquote dd div section article main li body".split())
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd", "summary"} | {"li", "hr"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner|comments?|commentlist|disqus|respond|replies|sidebar|side|rail|nav\w*|menu\w*|breadcrumbs?|"
    r"discussions?|talkback|guestbook|pagination|pager|footer|foot|masthead|site-?header|page-?header|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|share|sharing|social|related|recommend\w*|trending|widget|skip-?link|hidden|legal|copyright)(?:$|[\s_-])"
)
_WANTED = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|post|story|text|blog)(?:$|[\s_-])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What a name says isn't there, or is there besides the content.
_BESIDES = re.compile(r"(?<=[\s_-])(?:no|has|with)[_-]\S*")
#: Quotes count only after "="; nothing is tried twice, so any text takes linear time.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))?)?""")


#: What a start tag ends if it is open: names of one kind, and the elements beyond which it isn't looked for.
_EDGES = frozenset("ul ol dl table tbody thead tfoot div article section body".split())
ENDED = {
    "p": (frozenset(["p"]), frozenset("td th li div section article main body blockquote".split())),
    "li": (frozenset(["li"]), _EDGES | DROPPED | {"header"}),
    "dt": (frozenset(["dt", "dd"]), _EDGES | DROPPED | {"header"}),
    "tr": (frozenset(["tr"]), _EDGES),
    "td": (frozenset(["td", "th"]), _EDGES | {"tr"}),
}
ENDS = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td"}
#: Levels up to which a paragraph's points are passed on.
LEVELS = 32


class Element:
    __slots__ = ("name", "parent", "parts", "children", "score", "chars", "link_chars", "bonus", "at", "inline", "skip", "open", "in_article", "of_article")

    def __init__(self, name: str, parent: Element | None, bonus: float, at: int):
        self.name, self.parent, self.bonus, self.at = name, parent, bonus, at
        self.parts: list = []  # own text and child elements, in order
        self.children: list[Element] = []
        self.score, self.chars, self.link_chars = 0.0, 0, 0
        self.inline: dict[str, int] = {}  # inline elements open in it
        self.skip: Element | None = parent and parent.skip  # the outermost dropped element it is or stands in
        self.of_article: bool = name == "article" or bool(parent and parent.of_article)
        self.in_article: bool = name in ("article", "main") or bool(parent and parent.in_article)
        # of each kind the open element that a start tag in this one would end
        self.open: dict[str, Element | None] = {k: self if name in names else None if name in edges or parent is None else parent.open[k] for k, (names, edges) in ENDED.items()}


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; of a name that repeats the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))


def _kind(name: str, text: str, in_article: bool) -> tuple[bool, float]:
    """Whether an element is dropped, and the factor on its points.

    An unwanted word drops it only if no other of its names is one of content; parts of one name, as in
    comment-body, don't speak for it. Names like no-sidebar say nothing.
    """
    if name in DROPPED or name == "header" and not in_article:
        return True, 1.0
    if not text.strip(" \n\t/"):
        return False, 1.5 if name in ("article", "main") else 1.0
    attributes = _attributes(text)
    if _hidden(attributes):
        return True, 1.0
    role = attributes.get("role", "").strip().lower()
    if role in ROLES:
        return True, 1.0
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "itemprop"))
    words = _BESIDES.sub("", " " + re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower())
    unwanted = bool(_UNWANTED.search(words))
    wanted = name in ("article", "main") or role in ("main", "article") or any(_WANTED.search(w) and not _UNWANTED.search(w) for w in words.split())
    if unwanted and not wanted and name not in ("html", "body"):
        return True, 1.0
    return False, 1.5 if wanted or _WANTED.search(words) else 1.0


def parse(html: str) -> Element:
    """The tree of block elements; inline elements only mark text as link text.

    Dropped elements stay out of their parent, but end like any other: by their end tag, that of an
    element around them, or a start tag that implies it.
    """
    root = at = Element("#root", None, 1.0, 0)
    opened: dict[str, int] = {}  # open elements by name
    unclosed: set[str] = set()  # raw elements without an end tag from here on
    pos, count = 0, 1
    in_link = False
    low = None
    end, tags_end = len(html), html.rfind(">") + 1

    def leave(to: Element) -> Element:
        """Closes the open elements inside `to`; each is closed once."""
        x = at
        while x is not to:
            opened[x.name] -= 1
            x = x.parent
        return to

    def enter(e: Element) -> Element:
        opened[e.name] = opened.get(e.name, 0) + 1
        return e

    while pos < end:
        m = _TAG.search(html, pos, tags_end)
        text = html[pos : m.start() if m else end]
        if text and at.skip is None:
            at.parts.append((text, in_link))
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        top = at.skip
        if m[1]:
            if name in ("body", "html"):
                at = leave(top.parent) if top else at
            elif name in BLOCKS:
                if opened.get(name):
                    x = at
                    while x.name != name:
                        x = x.parent
                    in_link = in_link and x.skip is not None
                    at = leave(x.parent)
            elif at.inline.get(name):
                at.inline[name] -= 1
            elif top and top.name not in BLOCKS and (name == top.name or top.parent.inline.get(name)):
                at = leave(top.parent)
                if name != top.name:
                    at.inline[name] -= 1
                    in_link = in_link and name != "a"
            if name == "a" and top is None:
                in_link = False
            continue
        closed = m[3].rstrip().endswith("/")
        if name in RAW and not closed:
            low = low if low is not None else html.lower()
            stop = -1 if name in unclosed else low.find(f"</{name}", pos)
            if stop < 0:
                # unclosed: nothing that follows is text of the page
                if name in ("script", "style", "textarea", "title", "iframe", "xmp"):
                    break
                unclosed.add(name)
                continue
            close = html.find(">", stop)
            pos = close + 1 if close >= 0 else end
            continue
        if at.name == "head" and name not in HEAD:
            at = leave(at.parent)
        if name in VOID and not (name == "hr" and at.skip):
            if name in SPACED and at.skip is None:
                at.parts.append((" ", False))
            continue
        if name not in BLOCKS and name not in VOID:
            if at.skip is None and name != "a" and m[3] and _hidden(_attributes(m[3])):
                at = enter(Element(name, at, 1.0, 0))
                at.skip = at
            elif not (at.skip and closed):
                at.inline[name] = at.inline.get(name, 0) + 1
                in_link = in_link or name == "a" and at.skip is None
            continue
        if name in ENDS_P and at.open["p"]:
            at = leave(at.open["p"].parent)
        if name in ENDS and (x := at.open[ENDS[name]]):
            at = leave(x.parent)
        if name in VOID:
            if at.skip is None:
                at.parts.append((" ", False))
            continue
        if at.skip:
            if not closed:
                at = enter(Element(name, at, 1.0, 0))
            continue
        dropped, bonus = _kind(name, m[3], at.in_article)
        e = enter(Element(name, at, bonus, count))
        if dropped:
            e.skip = e
            if name != "head":
                at.parts.append((" ", False))
            at = e
            continue
        count += 1
        at.parts.append(e)
        at.children.append(e)
        at, in_link = e, False
    return root


def _weigh(root: Element) -> list[Element]:
    """All elements, with chars, link_chars and score set."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack.extend(e.children)
    for e in reversed(order):
        own = commas = 0
        for p in e.parts:
            if type(p) is tuple:
                n = len(p[0]) - p[0].count(" ") if len(p[0]) < 4 else len(" ".join(p[0].split()))
                own += n
                e.link_chars += n if p[1] else 0
                commas += p[0].count(",")
            else:
                e.chars += p.chars
                e.link_chars += p.link_chars
        linked = e.link_chars / max(1, own + e.chars)
        e.chars += own
        if own and e.name in PARAGRAPHS:
            points = (1 + commas + own / 100) * (1 - linked)
            x, share = (e.parent, 1.0) if e.name in ("p", "pre", "td", "blockquote", "dd", "li") else (e, 1.0)
            level = 0
            while x is not None and level <= LEVELS:
                x.score += points * share
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
                x = x.parent
    for e in order:
        e.score *= (1 - e.link_chars / max(1, e.chars)) * e.bonus
    return order


def _is_menu(e: Element) -> bool:
    """A block of three short links or more. Long links, as those of a list of references, are text."""
    return e.name in ("ul", "ol", "div", "section", "table", "dl") and e.link_chars > 0.6 * e.chars and len(e.children) >= 3 and e.chars < 30 * len(e.children)


def _between_text(e: Element) -> set[Element]:
    """The children of e that have paragraphs both before and after them: what stands there belongs to the text."""
    text = [i for i, c in enumerate(e.children) if c.name in ("p", "pre", "blockquote") and c.chars and c.link_chars <= 0.5 * c.chars]
    return set(e.children[text[0] + 1 : text[-1]]) if len(text) > 1 else set()


def _collect(e: Element, out: list[str]) -> None:
    """Texts of e in page order: blocks are parted by white space, inline pieces aren't.

    Inside an article element nothing more is dropped; elsewhere blocks of short links are menus unless they stand between paragraphs.
    """
    stack: list = [e]
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
        elif type(x) is tuple:
            out.append(unescape(x[0]) if "&" in x[0] else x[0])
        else:
            stack.append(" ")
            if e.of_article or not any(_is_menu(c) for c in x.children):
                stack.extend(reversed(x.parts))
            else:
                kept = _between_text(x)
                stack.extend(p for p in reversed(x.parts) if not (type(p) is Element and p not in kept and _is_menu(p)))
            stack.append(" ")


def main_text(html: str | None) -> str:
    """The main text of a page, white space as single spaces; empty if there is none."""
    if not html:
        return ""
    order = _weigh(parse(html))
    best = max(order, key=lambda e: (e.score, -e.at))
    if best.score <= 0 and not best.chars:
        return ""
    x = best
    while x is not None and x.name != "article":
        x = x.parent
    best = x or best  # an article is whole; any other element around the best one must earn its place by score
    chosen = [best]
    if best.parent is not None and best.name not in ("article", "body", "html"):
        for s in best.parent.children:
            density = s.link_chars / max(1, s.chars)
            if s is not best and (s.score >= max(5.0, 0.2 * best.score) or s.name in ("p", "h1", "h2", "h3", "pre", "blockquote") and s.chars and density < 0.25):
                chosen.append(s)
    elif best.name == "article" and best.parent is not None:
        chosen += [s for s in best.parent.children if s is not best and s.name == "article" and s.score >= 0.2 * best.score]
    out: list[str] = []
    for e in sorted(chosen, key=lambda e: e.at):
        out.append(" ")
        _collect(e, out)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text and n_chars (code points) of each row.

    Null and empty pages, and pages without main text, give an empty text; rows may repeat; an empty
    table gives an empty result.
    """
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, schema)


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
