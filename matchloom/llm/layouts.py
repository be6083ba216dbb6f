"""Labelled pages in varied layouts, made of invented words, to fit the trees of HTML extraction to."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Stands in front of each main text; a private character, so no other text has it.
MAIN = ""
SYLLABLES = "an ba ce dor en fi gra ha in ka lo me nu or pre qui ra so ti un ver wo xi yl za é ö ñ".split()
#: Kinds of text beside the article: elements, and words that name them, in pages that use such names.
ASIDES = {
    "menu": (["nav", "div", "ul", "nav", "header"], ["nav", "navbar", "menu", "main-menu", "navigation", "topnav", "breadcrumb breadcrumbs", "links", "pagination pager", "toc", "site-nav", "skip-links"]),
    "header": (["header", "div", "header", "table"], ["header", "site-header", "masthead", "page-header top", "logo branding", "top-bar", "hero-bar"]),
    "footer": (["footer", "div", "footer", "p"], ["footer", "site-footer", "copyright", "bottom", "legal colophon", "page-foot foot"]),
    "sidebar": (["aside", "div", "section", "ul"], ["sidebar", "widget widget-area", "related related-posts", "recommended", "popular most-read trending", "side rail", "right-col", "more-stories teaser"]),
    "notice": (["div", "section", "aside", "p", "dialog"], ["cookie cookie-banner", "consent gdpr", "notice", "alert", "popup modal overlay", "newsletter subscribe", "message info-box", "paywall", "announcement", "warning disclaimer"]),
    "advert": (["div", "aside", "section", "p", "ins", "figure"], ["ad", "ads", "advert", "advertisement", "ad-slot adsbox", "sponsored sponsor", "promo promotion", "banner", "adsense dfp", "commercial"]),
    "form": (["form", "div", "form", "fieldset"], ["login", "search search-form", "signup register", "contact-form form", "poll", "comment-form reply-form", "subscribe-form"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment-list commentlist", "discussion", "replies responses", "disqus thread", "user-comments reader-comments", "reactions reviews"]),
    "share": (["div", "ul", "p"], ["share", "social social-links", "tags", "post-meta meta", "share-buttons toolbar", "actions", "print-links"]),
}
ARTICLES = ["article", "content", "main", "post", "entry entry-content", "story story-body", "article-body", "post-content", "page-content", "text", "body-text", "article__content", "main-content"]
PLAIN = ["wrap", "wrapper", "container", "row", "col col-8", "inner", "block", "section", "box", "grid", "layout", "left", "x1", "css-1q2w3e", "sc-aXZ", "region", "group", "panel", "unit"]


class Maker:
    """A page at a time; all choices come from one seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.known = ["".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(3_000)]

    def words(self, least: int, most: int, stops: float = 0.15) -> str:
        r = self.r
        n = r.randint(least, most)
        ends = r.choices((" ", ", ", ". "), (1 - stops, stops / 2, stops / 2), k=n)
        return "".join(x for pair in zip(r.choices(self.known, k=n), ends) for x in pair).strip(" ,.").capitalize()

    def sentence(self, least: int, most: int) -> str:
        return self.words(least, most, self.stops) + ("." if self.r.random() < 0.9 else self.r.choice(("", "!", "?", ".$$$")))

    def el(self, tag: str, body: str, words: str = "") -> str:
        r = self.r
        named = words if self.named and words else r.choice(PLAIN) if r.random() < 0.3 else ""
        attributes = ""
        if named:
            attributes = f' {r.choice(("class", "class", "id"))}="{named}"'
            if r.random() < 0.2:
                attributes = f' class="{named} {r.choice(PLAIN)}"'
        return f"<{tag}{attributes}>{body}</{tag}>"

    def link(self, least: int = 1, most: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(least, most, 0.02)}</a>'

    def links(self, n: int, least: int = 1, most: int = 3) -> str:
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{self.link(least, most)}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ", "")).join(self.link(least, most) for _ in range(n))

    def aside(self, kind: str) -> str:
        """A part of the page that is no article."""
        r = self.r
        tags, names = ASIDES[kind]
        tag = r.choice(tags) if self.semantic else "div"
        tag = "div" if tag == "p" and not self.named else tag  # nothing would tell it from a paragraph of the article
        fits = lambda body: body if tag not in ("ul", "ol") else f"<li>{body}</li>"
        if kind == "menu":
            body = self.links(r.randint(2, 14))
        elif kind == "header":
            body = r.choice(("<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "{}")).format(r.choice((self.link(), self.words(1, 4)))) + r.choice(("", f"<p>{self.words(2, 8)}</p>", self.links(r.randint(2, 6))))
        elif kind == "footer":
            text = r.choice((f"&copy; {self.words(1, 3)} {r.randint(1999, 2030)}", f"&copy; {self.words(1, 2)}.example.com &middot; {self.sentence(4, 14)}", self.sentence(5, 25), self.words(2, 5)))
            body = r.choice(("{}", "<p>{}</p>", "<div>{}</div>")).format(text) + r.choice(("", "", self.links(r.randint(2, 8))))
        elif kind == "sidebar":
            heading = r.choice(("", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 3)}</h2>"))
            body = heading + r.choice((self.links(r.randint(3, 10), 3, 9), "".join(f"<div>{self.link(3, 8)}<p>{self.sentence(5, 25)}</p></div>" for _ in range(r.randint(1, 5))), f"<p>{self.sentence(6, 50)}</p>"))
        elif kind == "notice":
            text = self.sentence(5, 40)
            body = r.choice(("{}", "<p>{}</p>", "<h4>{}</h4><p>" + self.sentence(6, 40) + "</p>")).format(text) + r.choice(("", "<button>Ok</button>", self.link()))
        elif kind == "advert":
            body = r.choice(("{}", "<p>{}</p>", "<h3>{}</h3>" + self.link(2, 6), '<a href="/x">{}</a>')).format(self.sentence(3, 40))
        elif kind == "form":
            body = "".join(f"<label>{self.words(1, 4)}</label><input type=text>" for _ in range(r.randint(1, 5))) + r.choice(("", f"<p>{self.sentence(4, 25)}</p>", "<select><option>1<option>2</select>")) + "<button>Go</button>"
        elif kind == "comments":
            item = lambda: self.el("li" if tag in ("ol", "ul") else r.choice(("div", "article", "div")), r.choice(("<b>{}</b>", "<h4>{}</h4>", "<span>{}</span>", "<cite>{}</cite>")).format(self.words(1, 2)) + "".join(f"<p>{self.sentence(3, 60)}</p>" for _ in range(r.choice((1, 1, 1, 2, 3)))) + r.choice(("", self.link(1, 1))), r.choice(("comment", "comment-body", "reply", "response", "comment user")))
            items = "".join(item() for _ in range(r.randint(1, 6)))
            return self.el(tag, (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.5 and tag not in ("ol", "ul") else "") + items, r.choice(names))
        else:
            body = r.choice((self.links(r.randint(2, 6), 1, 2), self.words(2, 7), f"{self.words(1, 2)} {self.link()} {r.randint(1, 28)}.{r.randint(1, 12)}.2020"))
        return self.el(tag, fits(body) if not body.startswith("<ul>") else body, r.choice(names))

    def paragraph(self) -> str:
        r = self.r
        n = r.choice(((1, 3), (2, 12), (15, 60), (20, 90), (40, 160)))
        text = MAIN + self.sentence(*n)
        if r.random() < 0.2:
            text += " " + self.link(1, 4) + " " + self.sentence(2, 20)
        if r.random() < 0.15:
            text = f"<b>{text}</b>" if r.random() < 0.5 else f"<b>{text}<br>"
        return text

    def article(self) -> str:
        """The blocks of an article; now and then with something else between them."""
        r = self.r
        out = []
        if r.random() < 0.75:
            heading = f"<h{r.choice((1, 1, 1, 2))}>{MAIN}{self.words(2, 12)}</h1>"
            out.append(f"<header>{heading}</header>" if r.random() < 0.08 else heading)
        if r.random() < 0.15:
            out.append(self.aside("share"))
        kind = r.choice(("p", "p", "p", "p", "div", "br", "loose"))
        for _ in range(r.choice((1, 2, 3, 5, 8, 13, 20))):
            text = self.paragraph()
            out.append({"p": f"<p>{text}</p>" if r.random() < 0.93 else f"<p>{text}", "div": f"<div>{text}</div>", "br": f"{text}<br><br>", "loose": f"{text}<hr>"}[kind])
            x = r.random()
            if x < 0.05:
                out.append(f"<h2>{MAIN}{self.words(1, 7)}</h2>")
            elif x < 0.09:
                tag = r.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{MAIN}{self.sentence(2, 25)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif x < 0.11:
                out.append(f"<blockquote><p>{MAIN}{self.sentence(6, 40)}</p></blockquote>")
            elif x < 0.13:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MAIN}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.15:
                out.append(f"<figure><img src=a.png><figcaption>{MAIN}{self.sentence(3, 14)}</figcaption></figure>")
            elif x < 0.16:
                out.append(f"<pre>{MAIN}{self.words(3, 30)}</pre>")
            elif x < 0.22 and self.named:
                out.append(self.aside(r.choice(("advert", "advert", "notice", "sidebar", "share"))))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        self.named, self.semantic, self.stops = r.random() < 0.88, r.random() < 0.75, r.choice((0.05, 0.15, 0.25, 0.35))
        some = lambda kinds, p: [self.aside(k) for k in kinds if r.random() < p]
        tag = r.choice(("article", "article", "main", "div", "section")) if self.semantic else "div"
        body = self.article()
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body = self.el("div", body, r.choice(("", *ARTICLES)))
        if r.random() < 0.1:  # other parts may stand in the article's element
            body += "".join(some(("share", "sidebar", "comments", "form"), 0.5))
        body = self.el(tag, body, r.choice(("", "", *ARTICLES)))
        before = some(("notice", "header", "menu", "menu", "form", "advert", "share"), 0.4)
        after = some(("share", "comments", "form", "sidebar", "sidebar", "advert", "notice"), 0.35)
        if r.random() < 0.5:
            r.shuffle(before)
            r.shuffle(after)
        middle = "".join(before[len(before) // 2 :]) + body + "".join(after[: len(after) // 2])
        if r.random() < 0.4:
            middle = self.el(r.choice(("div", "main")) if self.semantic else "div", middle)
        if r.random() < 0.06:
            middle = f"<table><tr><td>{self.aside('menu')}</td><td>{middle}</td></tr></table>"
        out = "".join(before[: len(before) // 2]) + middle + "".join(after[len(after) // 2 :]) + "".join(some(("menu", "footer"), 0.3)) + (self.aside("footer") if r.random() < 0.8 else "")
        if r.random() < 0.5:
            out = self.el("div", out)
        if r.random() < 0.04:
            out = f'<form method=post id="{r.choice(("form1", "aspnetForm"))}">{out}</form>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{out}</body></html>"


def sample(pages: int, seed: int) -> Iterator[str]:
    maker = Maker(seed)
    for _ in range(pages):
        yield maker.page()
