"""Labelled training pages: generated, bounded, the same every time.

Pages of many layouts are put together from parts whose label is known. Names
of classes and ids are the usual ones; prose is of invented words, so that no
language or vocabulary is learnt. ``data-y`` marks each part: 1 is the article.
"""

from __future__ import annotations

import random

#: Usual names of page parts.
NAMES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav nav-links site-nav pagination pager tabs toc-nav menu-item skip-links".split(),
    "header": "header masthead site-header top-bar page-header branding logo banner-top topbar".split(),
    "footer": "footer site-footer page-footer bottom copyright colophon legal foot footer-links".split(),
    "side": "sidebar side aside widget related rail right-column recommended most-read trending tags tag-cloud archive-list secondary related-posts see-also".split(),
    "notice": "cookie cookie-notice cookies notice alert gdpr consent popup modal newsletter subscribe paywall banner announcement warning toast overlay signup cookie-banner".split(),
    "ad": "ad ads advert advertisement sponsored promo ad-slot adsbygoogle banner-ad sponsor ad-container promoted outbrain taboola advertorial adbox".split(),
    "form": "form search search-form login login-form contact-form signup-form poll survey subscribe-form".split(),
    "comment": "comments comment comment-list disqus_thread responses reader-comments comment-body discussion replies user-comments reply comments-area feedback".split(),
    "share": "share social share-buttons social-links follow-us sharing byline-tools print-tools".split(),
    "main": "content main post entry article article-body story post-content entry-content text body-text main-content story-body article-content page-content".split(),
    "wrap": "container wrapper row col page site inner outer layout grid section box clearfix wrap column".split(),
}
SYLLABLES = "ba be bi co cu da de di er en el fa fi ga ge ha he in ka ki la le li ma mi mo na ne ni on or pa pe ra re ri sa se si ta te ti un va ve wi ya zo".split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.n = 0

    def words(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.r.randint(lo, hi)):
            w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))
            out.append(w)
        return " ".join(out)

    def prose(self, lo: int, hi: int) -> str:
        return " ".join(self.words(3, 14).capitalize() + self.r.choice("...!?") for _ in range(self.r.randint(lo, hi)))

    def name(self, kind: str) -> str:
        word = self.r.choice(NAMES[kind])
        if self.r.random() < 0.3:
            word += " " + self.r.choice([*NAMES["wrap"], self.words(1, 1)])
        return f'{self.r.choice(("class", "class", "id"))}="{word}"'

    def links(self, n: int) -> str:
        style = self.r.random()
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(n)]
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "<div>" + self.r.choice((" | ", " ", " &middot; ")).join(items) + "</div>" if style < 0.8 else "".join(f"<p>{x}</p>" for x in items)

    def part(self, kind: str) -> str:
        """A part that is not the article."""
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "section" if kind == "comment" and r.random() < 0.4 else "ins" if kind == "ad" and r.random() < 0.1 else "div")
        bare = tag not in ("div", "section", "ins") and r.random() < 0.5
        if not bare and tag in ("nav", "header", "footer", "aside") and r.random() < 0.5:
            tag = "div"
        open_tag = f"<{tag}>" if bare else f"<{tag} {self.name(kind)}>"
        body = {
            "nav": lambda: self.links(r.randint(2, 8)),
            "header": lambda: f"<{r.choice(('h1', 'h2', 'p', 'div', 'span'))}>{self.words(1, 4)}</p>" + (self.links(3) if r.random() < 0.5 else "") + (f"<p>{self.prose(1, 1)}</p>" if r.random() < 0.3 else ""),
            "footer": lambda: r.choice(("&copy; ", "", "Copyright 2024 ")) + r.choice((self.words(1, 4), self.prose(1, 2))) + r.choice(("", " &middot; " + self.prose(1, 1))) + (self.links(4) if r.random() < 0.5 else ""),
            "side": lambda: f"<h{r.randint(2, 4)}>{self.words(1, 3)}</h3>" + r.choice((self.links(5), f"<p>{self.prose(1, 3)}</p>", f"<p>{self.prose(2, 5)}</p><p>{self.prose(1, 4)}</p>")),
            "notice": lambda: f"<p>{self.prose(1, 3)}</p>" if r.random() < 0.5 else self.prose(1, 2) + f" <button>{self.words(1, 1)}</button>",
            "ad": lambda: r.choice((self.prose(1, 2), f"<p>{self.prose(1, 3)}</p>", f'<a href="x">{self.words(2, 8)}</a>', f"<h4>{self.words(2, 5)}</h4><p>{self.prose(1, 2)}</p>")),
            "form": lambda: f'<label>{self.words(1, 3)}</label><input name="q">' + r.choice(("", f"<p>{self.prose(1, 2)}</p>", f"<legend>{self.words(1, 3)}</legend>", self.words(2, 5))) + f"<select><option>{self.words(1, 1)}</option></select><button>{self.words(1, 1)}</button>",
            "comment": lambda: f"<h3>{self.words(1, 3)}</h3>" + "".join(r.choice((f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.prose(1, 5)}</p></div>', f"<p>{self.prose(1, 6)}</p>", f"<li><p>{self.prose(1, 4)}</p></li>", f"<article><p>{self.prose(1, 4)}</p></article>")) for _ in range(r.randint(1, 4))),
            "share": lambda: self.links(3),
        }[kind]()
        return f'{open_tag[:-1]} data-y="0">{body}</{tag}>'

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = f"<h1>{self.words(2, 9)}</h1>"
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            x = r.random()
            long = f"<p>{self.prose(1, r.choice((1, 2, 5, 9)))}" + ("</p>" if r.random() < 0.9 else "")
            if x < 0.68:
                out.append(long)
            elif x < 0.74:
                out.append(f"<p><b>{self.words(1, 9)}.<br>{long}")
            elif x < 0.8:
                out.append(f"<h{r.randint(2, 4)}>{self.words(1, 6)}</h2>{long}")
            elif x < 0.84:
                out.append("<ul>" + "".join(f"<li>{r.choice((self.words(2, 7), self.prose(1, 2)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.87:
                out.append(f"<blockquote>{r.choice((self.prose(1, 3), long))}</blockquote>")
            elif x < 0.89:
                out.append(f"<figure><img src=x><figcaption>{self.words(3, 9)}</figcaption></figure>")
            elif x < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.93:
                out.append(f"<pre>{self.words(4, 20)}</pre>")
            elif x < 0.95:
                out.append(f'<p>{self.prose(1, 2)} <a href="x">{self.words(1, 5)}</a> {self.prose(1, 2)}</p>')
            elif x < 0.97:
                out.append(f"<p>{self.words(1, 3)}.</p>")
            else:
                out.append(f"{self.prose(1, 3)}<br><br>{self.prose(1, 3)}")
            if r.random() < 0.09:
                out.append(self.part(r.choice(("ad", "ad", "notice", "side", "share", "form"))))
        tag = r.choice(("article", "article", "main", "div", "div", "section", "td"))
        named = f" {self.name('main')}" if tag in ("div", "section", "td") and r.random() < 0.85 or r.random() < 0.25 else ""
        inner = "".join(out)
        if r.random() < 0.3:
            inner = f"<div {self.name('main' if r.random() < 0.5 else 'wrap')}>{inner}</div>"
        if r.random() < 0.12:
            inner += self.part("comment")
        whole = f'<{tag}{named} data-y="1">{inner}</{tag}>'
        return f"<table><tr>{whole}</tr></table>" if tag == "td" else whole

    def page(self) -> str:
        r = self.r
        before = [self.part(k) for k in ("header", "nav", "notice", "ad", "form", "side", "share") if r.random() < 0.4]
        after = [self.part(k) for k in ("comment", "comment", "side", "ad", "nav", "form", "notice", "share", "footer") if r.random() < 0.4]
        r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        for _ in range(r.randint(0, 2)):
            body = f"<div {self.name('wrap')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]
