"""Labelled pages to train the extractor on, made from a seed.

A page is an article (headings, paragraphs, lists, quotes) amid what surrounds one:
menus, page headers and footers, sidebars, notices, adverts, forms, related links
and reader comments, under the tags and class names that sites commonly give them,
also inside the article's own element. Every block says whether it belongs.
"""

from __future__ import annotations

import random

SYLLABLES = "an ber chi den er fo gra hin is jo ka lo men ne or pre qui ra sten ti un ver wo xi ya zo sch tion ment que los ein".split()

#: Tag and class or id names commonly given to parts of pages.
ARTICLE = [("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("div", "article-body"), ("div", "story"), ("section", "text"), ("div", "")]
AROUND = {
    "menu": [("nav", ""), ("div", "menu"), ("div", "nav navbar"), ("ul", "navigation"), ("div", "breadcrumb"), ("div", "toc")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-title"), ("div", "topbar")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "legal"), ("div", "colophon")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "recommended"), ("section", "popular"), ("div", "share social"), ("div", "author-bio"), ("div", "tags"), ("div", "pagination")],
    "notice": [("div", "cookie-banner"), ("div", "notice"), ("div", "consent"), ("div", "alert"), ("div", "popup modal"), ("div", "disclaimer"), ("div", "gdpr"), ("div", "warning")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "banner"), ("div", "sponsored promo"), ("aside", "ad"), ("ins", "adsbygoogle")],
    "form": [("form", ""), ("form", "search"), ("form", "login"), ("div", "newsletter subscribe"), ("div", "signup")],
    "comments": [("div", "comments"), ("section", "comments"), ("div", "comment"), ("ul", "comment-list"), ("div", "disqus_thread"), ("section", "responses replies"), ("div", "reviews")],
}


def _words(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
    words[0] = words[0].capitalize()
    for k in range(len(words) - 1):
        if r.random() < 0.12:
            words[k] += r.choice([",", ".", ";"])
    return " ".join(words) + r.choice([".", ".", ".", "", "!", "?"])


def _open(tag: str, name: str, r: random.Random) -> str:
    return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">' if name else f"<{tag}>"


def _around(kind: str, r: random.Random) -> str:
    tag, name = r.choice(AROUND[kind])
    link = lambda: f'<a href="/{r.random():.6f}">{_words(r, 1, 4)}</a>'
    if kind == "menu" or (kind == "side" and r.random() < 0.5):
        body = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
        body = body if tag == "ul" else f"<ul>{body}</ul>"
    elif kind == "header":
        body = r.choice([f"<h1>{_words(r, 1, 5)}</h1>", ""]) + f"<p>{_words(r, 2, 12)}</p>"
    elif kind == "footer":
        body = f"&copy; 2020 {_words(r, 1, 20)}" + r.choice(["", link(), f"<p>{_words(r, 3, 25)}</p>"])
    elif kind == "form":
        body = f'<label>{_words(r, 1, 4)}</label><input type="text"><button>{_words(r, 1, 2)}</button>' + r.choice(["", f"<p>{_words(r, 3, 20)}</p>"])
    elif kind == "comments":
        inner = r.choice(["div", "p", "li"])
        body = r.choice(["", f"<h3>{_words(r, 1, 3)}</h3>"]) + "".join(f"<{inner}>{_words(r, 3, 60)}</{inner}>" for _ in range(r.randint(1, 5)))
    else:
        inner = r.choice(["p", "", ""])
        body = "".join((f"<{inner}>" if inner else "<div>") + _words(r, 2, 45) + (f"</{inner}>" if inner else "</div>") for _ in range(r.randint(1, 3)))
    return f"{_open(tag, name, r)}{body}</{tag}>"


def _paragraph(r: random.Random) -> str:
    text = _words(r, *r.choice([(1, 4), (5, 20), (20, 90), (40, 160)]))
    if r.random() < 0.15:
        text = f"<b>{text}</b>"
    if r.random() < 0.2:
        text += f' <a href="/x">{_words(r, 1, 3)}</a>'
    kind = r.random()
    if kind < 0.75:
        return f"<p>{text}" + r.choice(["</p>", "</p>", "<br>"])
    if kind < 0.85:
        return f"<h2>{_words(r, 1, 8)}</h2>"
    if kind < 0.93:
        return "<ul>" + "".join(f"<li>{_words(r, 2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
    return f"<blockquote>{text}</blockquote>"


def labelled_page(seed: int) -> list[tuple[str, bool]]:
    """The pieces of a page in order, each with whether its blocks belong to the article; joined they are the page."""
    r = random.Random(seed)
    out = [(f"<html><head><title>{_words(r, 2, 8)}</title><style>p{{}}</style></head><body>", False)]
    wrap = r.random() < 0.4
    if wrap:
        out.append((_open("div", r.choice(["page", "wrapper", "container", ""]), r), False))
    out += [(_around(kind, r), False) for kind in ("header", "menu", "notice", "advert", "side") if r.random() < 0.5]
    tag, name = r.choice(ARTICLE)
    out.append((_open(tag, name, r), False))
    if r.random() < 0.8:
        out.append((f"<h1>{_words(r, 2, 10)}</h1>", True))
    for _ in range(r.randint(1, 14)):
        out.append((_paragraph(r), True))
        if r.random() < 0.12:
            out.append((_around(r.choice(["advert", "side", "notice", "form"]), r), False))
    if r.random() < 0.25:
        out.append((_around("comments", r), False))
    out.append((f"</{tag}>", False))
    out += [(_around(kind, r), False) for kind in ("comments", "side", "advert", "form", "notice", "footer") if r.random() < 0.5]
    out.append(("</div></body></html>" if wrap else "</body></html>", False))
    return out
