"""Labelled pages for training: layouts made from rules, with the label of each part in an attribute.

Texts are invented words, so that a model can only learn from markup, length, punctuation and links.
"""

from __future__ import annotations

import random

_CONSONANTS, _VOWELS = "bcdfghjklmnprstvwz", "aeiou"
#: Texts that stand in such places on many sites, in the languages of the corpus.
_PHRASES = {
    "footer": ["Copyright 2024", "© 2023 All rights reserved", "Impressum", "Mentions légales", "Privacy policy", "Terms of use", "Aviso legal", "Datenschutz"],
    "notice": ["We use cookies to improve this site.", "Wir verwenden Cookies.", "Ce site utilise des cookies.", "Este sitio usa cookies.", "Please enable JavaScript.", "Subscribe to continue reading."],
    "share": ["Share", "Tweet", "Print", "Email this", "Teilen", "Partager", "Compartir"],
    "form": ["Your email", "Sign up", "Log in", "Search", "Password", "Submit", "Anmelden", "Rechercher"],
    "advert": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Buy now and save 20%"],
    "comments": ["Comments", "3 comments", "Kommentare", "Commentaires", "Leave a reply"],
    "related": ["Related articles", "Most read", "You may also like", "Mehr zum Thema", "À lire aussi"],
}


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def pick(self, *values: str) -> str:
        return self.random.choice(values)

    def word(self) -> str:
        r = self.random
        return "".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) for _ in range(r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        mark = self.random.choices([".", "?", "!", ":", ""], [80, 6, 4, 4, 6])[0]
        return self.words(low, high).capitalize() + mark

    def text(self) -> str:
        out = " ".join(self.sentence() for _ in range(self.random.choices([1, 2, 4, 9], [25, 25, 30, 20])[0]))
        if self.random.random() < 0.1:
            out = self.words(1, 2).capitalize() + "."
        if self.random.random() < 0.06:  # noise inside a text is text
            out = " ".join(w + self.pick("&&&", "%%%", "###", "***", "!!") for w in out.split())
        if self.random.random() < 0.05:
            out = out.upper()
        if self.random.random() < 0.15:
            out += f' <a href="/{self.word()}">{self.words(1, 4)}</a> {self.words(2, 6)}.'
        if self.random.random() < 0.15:
            out = f"<{(t := self.pick('b', 'i', 'em', 'strong', 'span'))}>{out}</{t}>"
        return out

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def element(self, tag: str, inner: str, names: str = "", label: str = "") -> str:
        key = self.pick("class", "class", "id")
        attributes = (f' {key}="{names}"' if names else "") + (f' data-label="{label}"' if label else "")
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def box(self, semantic: str, names: tuple[str, ...], inner: str, label: str = "other") -> str:
        """A part in an element of its meaning, or in a plain one named for it."""
        if semantic and self.random.random() < 0.55:
            return self.element(semantic, inner, self.pick("", *names), label)
        return self.element(self.pick("div", "div", "section"), inner, self.pick(*names), label)

    def menu(self) -> str:
        links = [self.link() for _ in range(self.random.randint(2, 9))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if self.random.random() < 0.7 else " | ".join(links)
        return self.box("nav", ("nav", "menu", "navbar", "main-menu", "breadcrumb"), inner)

    def header(self) -> str:
        inner = self.element(self.pick("div", "p", "h2", "h1"), self.words(1, 5), self.pick("", "logo", "site-title"))
        return self.box("header", ("header", "masthead", "topbar", "site-header"), inner + (self.menu() if self.random.random() < 0.5 else ""))

    def footer(self) -> str:
        inner = f"<p>{self.pick(*_PHRASES['footer'])} {self.pick('', '&copy; ', '&middot; ')}{self.sentence()}</p>"
        if self.random.random() < 0.4:
            inner = f"&copy; {self.word()}.example.com &middot; {self.sentence()}"
        return self.box("footer", ("footer", "site-footer", "bottom", "legal"), inner + " ".join(self.link() for _ in range(self.random.randint(0, 4))))

    def advert(self) -> str:
        inner = self.pick(self.pick(*_PHRASES["advert"]), self.sentence(), self.sentence() + " " + self.sentence(), self.link(2, 8))
        return self.element(self.pick("div", "div", "aside", "section", "p"), inner, self.pick("ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "banner"), "other")

    def notice(self) -> str:
        inner = f"<p>{self.pick(*_PHRASES['notice'])} {self.sentence()}</p>" + (f"<button>{self.word()}</button>" if self.random.random() < 0.5 else "")
        return self.element(self.pick("div", "aside", "section"), inner, self.pick("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "paywall"), "other")

    def form(self) -> str:
        inner = "".join(f"<label>{self.pick(*_PHRASES['form'])}</label><input name=x>" for _ in range(self.random.randint(1, 3)))
        return self.element("form", f"<p>{self.sentence()}</p>{inner}<button>{self.pick(*_PHRASES['form'])}</button>", self.pick("", "search", "newsletter", "login", "subscribe"), "other")

    def sidebar(self) -> str:
        title = f"<h3>{self.pick(*_PHRASES['related'])}</h3>"
        items = "".join(f"<li>{self.link(2, 9)}{self.pick('', ' ' + self.sentence())}</li>" for _ in range(self.random.randint(2, 6)))
        extra = f"<p>{self.text()}</p>" if self.random.random() < 0.4 else ""
        return self.box("aside", ("sidebar", "related", "widget", "recommended", "side", "trending"), f"{title}<ul>{items}</ul>{extra}")

    def share(self) -> str:
        links = " ".join(f'<a href="#">{self.pick(*_PHRASES["share"])}</a>' for _ in range(self.random.randint(2, 4)))
        return self.element(self.pick("div", "ul", "p"), links, self.pick("share", "social", "sharing", "share-buttons"), "other")

    def comments(self) -> str:
        one = lambda: self.element(self.pick("div", "li", "article"), self.element(self.pick("p", "div"), self.words(1, 2), self.pick("author", "user", "")) + f"<p>{self.text()}</p>", self.pick("comment", "reply", "comment-body", "response"))
        inner = f"<h3>{self.pick(*_PHRASES['comments'])}</h3>" + "".join(one() for _ in range(self.random.randint(1, 6)))
        return self.element(self.pick("section", "div", "ol", "aside"), inner, self.pick("comments", "comment-list", "discussion", "respond", "disqus"), "other")

    def body_part(self) -> str:
        kind = self.random.choices(["p", "head", "list", "quote", "pre", "table", "figure", "div"], [60, 10, 8, 5, 3, 4, 4, 6])[0]
        if kind == "p":
            return f"<p>{self.text()}</p>" if self.random.random() < 0.85 else f"<p><b>{self.text()}<br><p>{self.text()}</p>"
        if kind == "head":
            return self.element(self.pick("h2", "h3", "h4"), self.words(1, 8))
        if kind == "list":
            return self.element(self.pick("ul", "ol"), "".join(f"<li>{self.pick(self.sentence(), self.words(1, 5), self.text())}</li>" for _ in range(self.random.randint(2, 6))))
        if kind == "quote":
            return f"<blockquote><p>{self.text()}</p></blockquote>"
        if kind == "pre":
            return f"<pre>{self.words(3, 12)}</pre>"
        if kind == "table":
            row = lambda: "<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>"
            return f"<table>{row()}{row()}</table>"
        if kind == "figure":
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        return f"<div>{self.text()}</div>"

    def article(self) -> str:
        parts = [f"<{(t := self.pick('h1', 'h1', 'h2'))}>{self.words(2, 10)}</{t}>"] if self.random.random() < 0.9 else []
        for _ in range(self.random.choices([1, 3, 8, 18], [15, 30, 35, 20])[0]):
            parts.append(self.body_part())
            if self.random.random() < 0.07:
                parts.append(getattr(self, self.pick("advert", "share", "sidebar", "form", "notice"))())
        inner = "".join(parts)
        if self.random.random() < 0.5:
            inner = self.element("article", inner, self.pick("", "", "post", "story", "entry"), "main")
        else:
            inner = self.element(self.pick("div", "section"), inner, self.pick("content", "post", "entry-content", "article-body", "story", "text", "main-content", "c" + str(self.random.randint(1, 9))), "main")
        return self.element("main", inner, self.pick("", "content")) if self.random.random() < 0.4 else inner

    def page(self) -> str:
        some = lambda chance, part: part() if self.random.random() < chance else ""
        before = [some(0.3, self.notice), some(0.6, self.header), some(0.7, self.menu), some(0.4, self.advert), some(0.15, self.form), some(0.25, self.sidebar)]
        after = [some(0.3, self.share), some(0.4, self.sidebar), some(0.2, self.form), some(0.4, self.comments), some(0.2, self.advert), some(0.8, self.footer), some(0.15, self.notice)]
        middle = "".join(before) + self.article() + "".join(after)
        if self.random.random() < 0.3:
            middle = self.element("div", middle, self.pick("wrapper", "page", "container", "site"))
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body data-label="other">{middle}</body></html>'


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    """n pages; the label of a block is in the nearest data-label above it, main or other."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]
