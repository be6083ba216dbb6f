"""HTML as a tree of block elements and runs of text, read in one pass without failing on any input."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# fixed values of the HTML standard: elements without content, elements within a line, elements that end an open paragraph
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split()
)
NO_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl dt dd li fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Elements whose content is no text of the page; that of the first ones is no markup either.
RAW = set("script style title textarea noscript iframe xmp noembed noframes".split())
UNSHOWN = RAW | set("template svg math canvas object audio video select option datalist button head".split())
#: Elements that end an open one of the same kind: the open ones, and what keeps them apart.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "tr": (("tr",), ("table",))}
ENDS |= dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))) | dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table")))
ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr"), ("table",)))

_NAME = r"[^\s/>=]"
_ATTRIBUTE = rf"""({_NAME}[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+"""
ATTRIBUTE = re.compile(_ATTRIBUTE)
#: A comment, a tag up to its end or the page's, or another declaration. No alternative gives back what it took, so it is linear.
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)>?|<[!?/][^>]*+>?", re.S)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Nodes in page order, each after its parent: block elements and, with a text, runs. Node 0 is the page."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])  # characters of a run within links
    fields: list[int] = field(default_factory=lambda: [0])  # form fields right in an element

    def add(self, parent: int, tag: str, tokens: tuple[str, ...] = (), text: str | None = None, linked: int = 0) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.tokens, tokens), (self.text, text), (self.linked, linked), (self.fields, 0)):
            column.append(value)
        return len(self.tag) - 1


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def tokens_of(found: dict[str, str]) -> tuple[str, ...]:
    """The words of the attributes that name an element: class, id, role, aria-label and itemprop."""
    named = " ".join(found.get(a, "") for a in ("class", "id", "role", "aria-label", "itemprop"))
    return tuple(dict.fromkeys(t.lower() for t in TOKEN.findall(named)))[:24] if named.strip() else ()


def read(source: str) -> Page:
    """The page's tree. Elements within a line belong to the run of text that they stand in; scripts, styles, menus of
    choices and the like leave nothing, nor does what is marked as hidden. White space of a run becomes one space."""
    page = Page()
    stack = [0]  # open elements
    open_: dict[str, list[int]] = {}  # their places in the stack, by tag
    run: list[str] = []
    linked, link, unseen, raw = 0, 0, 0, 0  # characters in links; heights of the stack where a link, something unseen, began; depth of an unseen inline element
    unseen_tag = ""
    endless: set[str] = set()  # tags that are not closed any more

    def closed(name: str) -> bool:
        """Whether an end tag of this name follows, so what is never closed does not hide the rest of the page."""
        if name not in endless and not re.compile(f"</{re.escape(name)}(?![A-Za-z0-9])", re.I).search(source, at):
            endless.add(name)
        return name not in endless

    def close_run() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.add(stack[-1], "#text", (), text, min(linked, len(text)))
            run.clear()
            linked = 0

    def pop_to(height: int) -> None:
        nonlocal link, unseen
        close_run()
        while len(stack) > height:
            open_[page.tag[stack.pop()]].pop()
        if link > height:
            link = 0
        if unseen > height:
            unseen = 0

    at = 0
    while at < len(source):
        found = TAG.search(source, at)
        upto = found.start() if found else len(source)
        if upto > at and not unseen and not raw:
            piece = html.unescape(source[at:upto])
            run.append(piece)
            if link:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if raw:
                raw -= name == unseen_tag
            elif name == "a":
                link = 0
            elif name == "br" or name == "p" and not open_.get("p"):
                run.append(" ")
            elif name not in INLINE and open_.get(name):
                pop_to(open_[name][-1])
            continue
        if raw:
            raw += name == unseen_tag and name not in VOID
            continue
        found_attributes = attributes(found[3]) if found[3].strip(" /\t\n\r\f") else {}
        if name in RAW:
            end = re.compile(rf"</{name}(?![A-Za-z0-9])", re.I).search(source, at)
            at = end.start() if end else len(source)
            end = TAG.match(source, at)
            at = end.end() if end else len(source)
            page.fields[stack[-1]] += name == "textarea"
            continue
        if name in ("input", "select", "button"):
            page.fields[stack[-1]] += 1
        hidden = name in UNSHOWN or "hidden" in found_attributes or bool(UNSEEN.search(found_attributes.get("style", "")))
        if name in INLINE:
            if name == "br":
                run.append(" ")
            elif name == "a" and not link:
                link = len(stack) + 1
            if hidden and name not in VOID and not unseen and closed(name):
                raw, unseen_tag = 1, name
            continue
        if "-" not in name and name not in NO_PARAGRAPH and name not in BLOCKS and not hidden:
            continue  # unknown elements stand within a line
        if open_.get("p") and name in NO_PARAGRAPH and page.tag[stack[-1]] == "p":
            pop_to(len(stack) - 1)
        if name in ENDS:
            same, apart = ENDS[name]
            height = min((open_[t][-1] for t in same if open_.get(t)), default=0)
            if height > max((open_[t][-1] for t in apart if open_.get(t)), default=0):
                pop_to(height)
        close_run()
        if name in VOID:
            continue
        if name in ("button", "select", "svg", "math", "canvas", "object", "audio", "video", "template", "option", "datalist"):
            if not unseen and closed(name):
                raw, unseen_tag = 1, name  # within a line, too, so the stack stays as it is
            continue
        node = page.add(stack[-1], name, tokens_of(found_attributes))
        open_.setdefault(name, []).append(len(stack))
        stack.append(node)
        if hidden and not unseen and name != "head":
            unseen = len(stack)
    close_run()
    return page


BLOCKS = NO_PARAGRAPH | UNSHOWN | set("html body table thead tbody tfoot tr td th caption colgroup frameset legend optgroup".split())
