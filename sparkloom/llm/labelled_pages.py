"""Labelled web pages to train main-text extraction on.

Pages are laid out at random from the parts that sites are made of. Every element whose text belongs
to the article, and every container that holds nothing but the article, carries data-y="1"; the
parser reads that mark as the label and hides it from the model."""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tas vo el un dar pi sen go rat nel os ver tin ma".split()

_HEADERS = ["header", "site-header", "masthead", "top-bar", "page-header", "branding", "topbar"]
_NAVS = ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "navigation", "site-nav", "tabs", "toc-links"]
_SIDES = ["sidebar", "side", "widget-area", "rail", "secondary", "aside", "right-col", "widget"]
_FOOTS = ["footer", "site-footer", "bottom", "colophon", "copyright", "foot", "legal"]
_ADS = ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "ad-slot", "adsbox"]
_NOTES = ["cookie-notice", "notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "banner-notice", "disclaimer"]
_SHARES = ["share", "social", "share-buttons", "tags", "byline-links", "related", "related-posts", "recommended", "more-links", "read-more", "author-box", "pagination"]
_REPLIES = ["comments", "comment-list", "comment-section", "replies", "discussion", "responses", "reader-comments", "disqus"]
_REPLY = ["comment", "reply", "comment-body", "response", "comment-text"]
_BODIES = ["content", "post", "article", "entry", "entry-content", "article-body", "post-content", "story", "main", "main-content", "body-text", "text"]


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        out[0] = out[0].capitalize()
        return " ".join(w + ("," if r.random() < 0.06 else "") for w in out)

    def prose(self) -> str:
        r = self.r
        text = " ".join(self.words(3, 22) + "." for _ in range(r.randint(1, 6)))
        if r.random() < 0.15:
            text = text.replace(" ", f' <a href="/{r.randint(1, 99)}">{self.words(1, 3)}</a> ', 1)
        if r.random() < 0.1:
            text = f"<b>{self.words(1, 4)}</b> {text}"
        if r.random() < 0.08:
            text = " ".join(w + r.choice(["###", "%%%", "***", "$$$", "&amp;&amp;"]) for w in text.split(" ") if "<" not in w and ">" not in w) or text
        return text

    def attr(self, names: list[str]) -> str:
        r = self.r
        name = r.choice(names)
        kind = r.random()
        return f' class="{name}"' if kind < 0.55 else f' id="{name}"' if kind < 0.8 else f' class="{name} {r.choice("box wrap inner row col clearfix block".split())}"'

    def box(self, tags: str, names: list[str], inner: str, plain: float = 0.0) -> str:
        tag = self.r.choice(tags.split())
        own = {"nav", "aside", "footer", "header", "article", "main", "form"}
        attr = "" if (tag in own and self.r.random() < 0.5) or self.r.random() < plain else self.attr(names)
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, low=3, high=9) -> str:
        items = [f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def advert(self) -> str:
        return self.box("div div aside section", _ADS, self.r.choice([self.words(3, 12) + ".", f"<a href='/x'>{self.words(2, 8)}</a>", f"<p>{self.prose()}</p>"]))

    def notice(self) -> str:
        text = f"<p>{self.words(5, 20)}.</p><button>{self.words(1, 2)}</button>" if self.r.random() < 0.6 else self.words(5, 20) + "."
        if self.r.random() < 0.2:
            return f'<div role="{self.r.choice(["alert", "status", "dialog", "note"])}">{text}</div>'
        return self.box("div div section aside", _NOTES, text)

    def form(self) -> str:
        return f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><select><option>{self.words(1, 2)}</option></select>' + self.r.choice([f"<p>{self.words(3, 12)}.</p>", ""]) + f"<button>{self.words(1, 2)}</button></form>"

    def share(self) -> str:
        return self.box("div div section aside p", _SHARES, self.r.choice([self.links(2, 6), f"<h3>{self.words(1, 4)}</h3>{self.links(2, 6)}", f"<span>{self.words(2, 6)}</span>"]))

    def replies(self) -> str:
        one = [self.box("div li article div", _REPLY, f"<{t}>{self.words(1, 3)}</{t}><p>{self.prose()}</p>") for t in self.r.choices(["b", "h4", "span", "cite"], k=self.r.randint(1, 6))]
        return self.box("section div div ol", _REPLIES, f"<h3>{self.words(1, 3)}</h3>" + "".join(one))

    def side(self) -> str:
        return self.box("aside div div", _SIDES, "".join(self.r.choice([f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<div class='widget'><h4>{self.words(1, 3)}</h4><p>{self.prose()}</p></div>", self.advert(), self.form()]) for _ in range(self.r.randint(1, 3))))

    def head(self) -> str:
        r = self.r
        inner = r.choice([f"<h1>{self.words(1, 3)}</h1>", f'<div class="logo"><a href="/">{self.words(1, 2)}</a></div>', f"<p>{self.words(2, 6)}</p>", ""])
        return r.choice([self.box("header div", _HEADERS, inner + self.box("nav div", _NAVS, self.links())), self.box("nav nav div ul", _NAVS, self.links())])

    def foot(self) -> str:
        return self.box("footer footer div", _FOOTS, self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.words(3, 12)}.", f"<p>&copy; {self.words(3, 9)}.</p>{self.links()}", f"<p>{self.prose()}</p>"]))

    def article(self) -> str:
        r, y = self.r, ' data-y="1"'
        title = f"<h1{y}>{self.words(2, 9)}</h1>" if r.random() < 0.85 else ""
        if r.random() < 0.15:
            title = f"<header{y}>{title}</header>"
        out = []
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.58:
                out.append(f"<p{y}>{self.prose()}</p>")
            elif kind < 0.68:
                out.append(f"<p{y}>{self.words(1, 3)}.</p>")
            elif kind < 0.75:
                out.append(f"<p{y}><b>{self.prose() if r.random() < 0.7 else self.words(1, 6)}<br>")  # left open
            elif kind < 0.81:
                out.append(f"<{(t := r.choice(['h2', 'h3']))}{y}>{self.words(1, 6)}</{t}>")
            elif kind < 0.86:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}{y}>" + "".join(f"<li{y}>{self.words(3, 15)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif kind < 0.9:
                out.append(f"<blockquote{y}><p{y}>{self.prose()}</p></blockquote>")
            elif kind < 0.93:
                cells = "".join(f"<tr{y}>" + "".join(f"<td{y}>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4)))
                out.append(f"<table{y}>{cells}</table>")
            elif kind < 0.95:
                out.append(f"<figure{y}><img src='x.png'><figcaption{y}>{self.words(3, 9)}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<p{y}>{self.words(1, 2)}.</p>")
            else:
                out.append(r.choice([self.advert, self.share, self.notice, self.notice])())
        for make, share in ((self.notice, 0.25), (self.form, 0.05)):
            if r.random() < share:
                out.insert(r.randrange(len(out) + 1), make())
        if r.random() < 0.12:  # dialogue, verse
            out += [f"<p{y}>{self.words(1, 6)}.</p>" for _ in range(r.randint(10, 60))]
        if r.random() < 0.15:  # builders' markup: every block in a box of its own
            out = [f"<div{y}{self.anyhow()}>{x}</div>" if y in x[:20] and r.random() < 0.8 else x for x in out]
        if r.random() < 0.25:  # a part of the blocks stands in a box of its own
            at = r.randrange(len(out))
            out[at:] = [f"<div{y}{self.anyhow()}>{''.join(out[at:])}</div>"]
        inner = title + "".join(out)
        if r.random() < 0.3:
            inner += self.share()
        if r.random() < 0.12:
            inner += self.replies()
        shape = r.random()
        if shape < 0.3:
            return f"<article{y}>{inner}</article>"
        if shape < 0.4:
            return f"<main{y}><article{y}>{inner}</article></main>"
        if shape < 0.5:
            return f"<main{y}{self.attr(_BODIES)}>{inner}</main>"
        if shape < 0.72:
            return f"<{(t := r.choice(['div', 'div', 'section', 'article']))}{y}{self.attr(_BODIES)}>{inner}</{t}>"
        if shape < 0.82:
            return f"<div{y}{self.anyhow()}>{inner}</div>"
        return inner

    def anyhow(self) -> str:
        """Nothing, or a class that says nothing."""
        r = self.r
        return r.choice(["", f' class="{r.choice(_SYLLABLES)}{r.choice(_SYLLABLES)}"', f' class="{r.choice("css x sc jsx u".split())}-{r.randrange(10**6):x}"', f' class="{r.choice("col row box wrap inner grid cell layer".split())}-{r.randint(1, 12)}"'])

    def page(self) -> str:
        r = self.r
        parts = [self.head()] if r.random() < 0.9 else []
        for make, share in ((self.notice, 0.3), (self.advert, 0.5), (self.side, 0.2)):
            if r.random() < share:
                parts.append(make())
        parts.append(self.article())
        for make, share in ((self.share, 0.25), (self.replies, 0.35), (self.side, 0.35), (self.form, 0.25), (self.advert, 0.25), (self.notice, 0.15)):
            if r.random() < share:
                parts.append(make())
        parts += [self.foot()] if r.random() < 0.9 else []
        body = "".join(f"{x}<!-- {self.words(1, 2)} -->" if r.random() < 0.2 else x for x in parts)
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["page", "wrapper", "container", "site", "layout"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}" + r.choice(["</body></html>", "</body></html>", ""])


def labelled_pages(pages: int = 320, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(pages)]
