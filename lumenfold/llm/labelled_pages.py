"""A labelled collection of web pages: layouts as sites use them, each part marked as content or not.

Pages are composed at random from a fixed seed. ``data-main`` marks the parts;
a mark holds for everything below until another one.
"""

from __future__ import annotations

import random

LABEL = "data-main"

_SYLLABLES = "an be co de er fi go ha in ka lo me no or pa re si ta un ve wo za ent ing ion est ble".split()
#: Names of page parts in class and id attributes, by what they hold.
_MENU = ["nav", "menu", "navigation", "navbar", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "pagination", "toc", "links", "tabs"]
_SIDE = ["sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "archive", "tags", "categories", "rail", "aside"]
_ADVERT = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adsense", "commercial", "adslot"]
_NOTICE = ["cookie", "cookie-notice", "consent", "notice", "banner", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "overlay"]
_FOOT = ["footer", "foot", "copyright", "legal", "colophon", "site-footer", "bottom", "disclaimer"]
_HEAD = ["header", "masthead", "site-header", "logo", "top", "brand", "topbar"]
_COMMENTS = ["comments", "comment", "comment-list", "discussion", "replies", "reply", "responses", "disqus", "feedback", "comment-section"]
_SHARE = ["share", "social", "share-buttons", "follow", "toolbar", "sharing"]
_MAIN = ["content", "main", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "text", "body", "page", "main-content"]
_NEUTRAL = ["container", "wrapper", "row", "inner", "col", "wrap", "layout", "box"]


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        ends = ["."] * 6 + ["!", "?"]
        kind = self.r.random()
        if kind < 0.15:  # tables as text, symbols, shouting: sentences without their usual ends
            ends = [[" |"], ["***", "%%%"], ["!!"]][int(kind * 20)]
        text = " ".join(self.words(2, 18).capitalize() + self.r.choice(ends) for _ in range(self.r.randint(low, high)))
        return text.rstrip(".") if self.r.random() < 0.12 else text

    def named(self, names: list[str]) -> str:
        if self.r.random() < 0.03:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def rich(self, text: str) -> str:
        """Now and then inline markup within a sentence."""
        pieces = text.split(" ")
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            k = self.r.randrange(len(pieces))
            pieces[k] = self.r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<code>{}</code>", "{}<br>", "<span>{}</span>", "<math><mi>{}</mi></math>"]).format(pieces[k])
        return " ".join(pieces)

    def part(self, tag: str, names: list[str], inside: str, mark: int = 0) -> str:
        return f'<{tag} {LABEL}="{mark}"{self.named(names)}>{inside}</{tag}>'

    def menu(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 8)))
        return self.part(self.r.choice(["nav", "nav", "div", "ul"]), _MENU, f"<ul>{items}</ul>" if self.r.random() < 0.8 else items)

    def side(self) -> str:
        items = "".join(self.r.choice([f"<li>{self.link()}</li>", f"<p>{self.sentences(1, 2)}</p>", f"<p>{self.link(3, 9)}</p>"]) for _ in range(self.r.randint(1, 6)))
        return self.part(self.r.choice(["aside", "aside", "div", "section"]), _SIDE, f"<h3>{self.words(1, 3)}</h3>{items}")

    def advert(self) -> str:
        text = self.sentences(1, 3)
        return self.part(self.r.choice(["div", "div", "aside", "section"]), _ADVERT, self.r.choice([text, f"<p>{text}</p>", f"<p>{text} {self.link()}</p>"]))

    def notice(self) -> str:
        text = f"<p>{self.sentences(1, 3)}</p>"
        return self.part(self.r.choice(["div", "div", "section", "aside", "dialog"]), _NOTICE, self.r.choice([text, f"{text}<button>{self.words(1, 2)}</button>", self.sentences(1, 2)]))

    def form(self) -> str:
        fields = "".join(f'<label>{self.words(1, 3)}</label>{self.r.choice(['<input name="x">', '<input name="x">', f"<textarea>{self.words(1, 6)}</textarea>"])}' for _ in range(self.r.randint(1, 3)))
        return self.part("form", ["search", "login", "form", "signup", "contact"], f"{self.r.choice(['', f'<p>{self.sentences(1, 2)}</p>'])}{fields}<button>{self.words(1, 2)}</button>")

    def foot(self) -> str:
        text = f"&copy; {self.words(1, 4)} &middot; {self.sentences(1, 2)}"
        return self.part(self.r.choice(["footer", "footer", "footer", "div"]), _FOOT, self.r.choice([text, f"<p>{text}</p>", f"<p>{text}</p><ul><li>{self.link()}</li></ul>"]))

    def head(self) -> str:
        return self.part(self.r.choice(["header", "header", "div"]), _HEAD, self.r.choice([self.link(), f"<p>{self.words(1, 5)}</p>", f"<h1>{self.link()}</h1><p>{self.words(3, 8)}</p>"]) + self.r.choice(["", self.menu()]))

    def comments(self) -> str:
        one = lambda: self.r.choice([
            f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></div>', f"<li><p>{self.sentences(1, 3)}</p></li>",
            f"<article{self.named(['comment', 'reply', 'comment-body'])}><p>{self.sentences(1, 4)}</p></article>", f"<p>{self.sentences(1, 4)}</p>",
        ])
        return self.part(self.r.choice(["section", "div", "ol", "div"]), _COMMENTS, f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 6))))

    def share(self) -> str:
        return self.part("div", _SHARE, " ".join(self.link(1, 1) for _ in range(self.r.randint(2, 5))))

    def references(self) -> str:
        """Links that are part of the article: lists of sources, tables of links."""
        if self.r.random() < 0.3:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.link(1, 5)}</td></tr>" for _ in range(self.r.randint(1, 5))) + "</table>"
        tag = self.r.choice(["ul", "ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{self.link(1, 8)}{self.r.choice(['', '', '.', ' ' + self.words(1, 4)])}</li>" for _ in range(self.r.randint(1, 6))) + f"</{tag}>"

    def bare(self) -> str:
        """A page without a container: text right in the body, between paragraphs and other parts."""
        parts = [self.r.choice([lambda: self.sentences(1, 6), lambda: f"<p>{self.rich(self.sentences(1, 6))}</p>", lambda: f"<h1>{self.words(2, 8)}</h1>", lambda: self.rich(self.sentences(1, 4)) + "<br>"])() for _ in range(self.r.randint(1, 8))]
        some = lambda p, f: f() if self.r.random() < p else ""
        return some(0.3, self.head) + some(0.5, self.menu) + some(0.2, self.notice) + "".join(parts) + some(0.2, self.references) + some(0.3, self.advert) + some(0.5, self.foot)

    def article(self) -> str:
        out = [f"<h1>{self.words(2, 14)}</h1>"] if self.r.random() < 0.85 else []
        if out and self.r.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = self.r.random()
            if kind < 0.72:
                text = self.r.choice([self.sentences(1, 8), self.sentences(1, 3), self.words(1, 3).capitalize() + "."])
                out.append(f"<p>{self.rich(text)}</p>" if self.r.random() < 0.85 else f"<p><b>{text}<br><p>{self.sentences(1, 3)}</p>")
            elif kind < 0.8:
                out.append(f"<h{self.r.randint(2, 4)}>{self.words(1, 7)}</h{2}>")
            elif kind < 0.87:
                items = "".join(f"<li>{self.rich(self.sentences(1, 2) if self.r.random() < 0.6 else self.words(1, 5))}</li>" for _ in range(self.r.randint(1, 5)))
                out.append(f"<ul>{items}</ul>" if self.r.random() < 0.6 else f"<ol>{items}</ol>")
            elif kind < 0.90:
                out.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.92:
                out.append(self.references())
            elif kind < 0.93:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            elif kind < 0.953:
                out.append(self.references())
            elif kind < 0.957:
                out.append(self.r.choice([f"<noscript><p>{self.sentences(1, 2)}</p></noscript>", f"<xmp>{self.words(3, 20)}</xmp>", f"<object><p>{self.sentences(1, 2)}</p></object>"]))
            elif kind < 0.965:
                out.append(f'<figure><img src="x.png"><figcaption>{self.words(3, 9)}</figcaption></figure>')
            else:
                out.append(self.r.choice([self.advert, self.share, self.notice, self.side, self.form, self.menu])())
        if self.r.random() < 0.03:
            out.append(self.comments())
        body = "".join(out)
        kind = self.r.random()
        if kind < 0.6:
            return self.part("article", _MAIN, body, 1)
        if kind < 0.75:
            return self.part("main", _MAIN, body, 1)
        return f'<div {LABEL}="1" {self.r.choice(["class", "id"])}="{self.r.choice(_MAIN)}">{body}</div>'

    def page(self) -> str:
        r = self.r
        if r.random() < 0.1:
            return f'<html><head><title>{self.words(2, 6)}</title></head><body {LABEL}="1">{self.bare()}</body></html>'
        some = lambda p, f: f() if r.random() < p else ""
        before = [some(0.1, lambda: self.part("noscript", _NOTICE, self.sentences(1, 1))), some(0.4, self.notice), some(0.4, self.head), some(0.7, self.menu), some(0.15, self.form), some(0.5, self.advert)]
        after = [some(0.1, self.share), some(0.35, self.comments), some(0.35, self.side), some(0.3, self.advert), some(0.2, self.form), some(0.2, self.notice), some(0.85, self.foot)]
        article = self.article()
        if r.random() < 0.4:
            article = f"<{(t := r.choice(['div', 'main', 'section']))}{self.named(_NEUTRAL + _MAIN)}>{some(0.3, self.side)}{article}{some(0.2, self.comments)}</{t}>"
        body = "".join(before) + article + "".join(after)
        if r.random() < 0.3:
            body = f"<div{self.named(_NEUTRAL)}>{body}</div>"
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>'


def pages(n: int, seed: int = 1) -> list[str]:
    """``n`` labelled pages; another seed gives other pages of the same kind."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]
