"""Labelled pages to learn the DOM model from, made from a few page plans.

The class word keep labels an element as content, drop as something else. Texts of
all lengths, from a letter up, stand in both, and class words come one at a time, so
that no length and no company of words stands for a label.
"""

from __future__ import annotations

from itertools import count

_VOCABULARY = "the committee met on second day and agreed plan members spoke at length about it who would pay a of in".split()
_LENGTHS = (1, 3, 1, 8, 2, 20, 5, 1, 60, 12, 2, 150, 30, 4, 400, 1, 90, 6)

#: (tag, class words to choose from, how its inside is laid out)
CONTAINERS = (("article", ("",)), ("main", ("",)), ("div", ("content", "article", "post", "entry", "story", "body", "text")), ("section", ("main", "article", "content")), ("article", ("post", "story", "entry")))
BEFORE = (
    ("nav", ("", "menu", "nav", "main"), "links"),
    ("header", ("", "site", "header", "banner", "top"), "heading"),
    ("div", ("nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "menu", "topbar"), "links"),
    ("div", ("cookie", "cookies", "notice", "consent", "banner", "alert", "gdpr", "header"), "text"),
    ("div", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor"), "bare"),
    ("ul", ("menu", "nav", "links"), "items"),
)
AFTER = (
    ("aside", ("", "sidebar", "related", "widget"), "both"),
    ("div", ("sidebar", "side", "related", "recommended", "widget", "trending"), "both"),
    ("footer", ("", "footer", "site", "bottom"), "bare"),
    ("div", ("footer", "copyright", "legal", "bottom"), "text"),
    ("section", ("comments", "discussion", "replies", "comment"), "remarks"),
    ("div", ("comments", "comment", "respond", "disqus", "reply"), "remarks"),
    ("form", ("", "newsletter", "subscribe", "search", "login", "signup"), "text"),
    ("div", ("share", "social", "sharing", "popup", "modal", "newsletter", "subscribe", "tags"), "links"),
    ("div", ("ad", "ads", "advert", "advertisement", "sponsored", "promo"), "bare"),
)
INSIDE = (None, ("div", ("ad", "advert", "promo", "ads"), "bare"), None, ("aside", ("", "related"), "text"), ("form", ("", "newsletter"), "text"), None, ("div", ("share", "social"), "links"))
_BLOCKS = ("p", "p", "h2", "p", "list", "p", "quote", "p", "table", "h3", "p", "pre", "dl", "p", "linked", "section", "list", "div", "p")


class _Plan:
    """Deals out lengths, words and blocks in turns."""

    def __init__(self) -> None:
        self.length, self.word, self.block = count(), count(), count()

    def said(self) -> str:
        k = next(self.length)
        size = _LENGTHS[k % len(_LENGTHS)]
        words = [_VOCABULARY[(k * 7 + j * 3) % len(_VOCABULARY)] for j in range(size)]
        ends = ("", ".", "!", ".", "?", ".")
        return " ".join(w + (ends[(k + j) % 6] if j % 9 == 8 or j == size - 1 else "") for j, w in enumerate(words)).capitalize()

    def links(self) -> str:
        return "".join(f'<li><a href="/{j}">{self.said()[:24]}</a></li>' for j in range(2 + next(self.word) % 5))

    def part(self, plan, label: str = "drop") -> str:
        tag, words, layout = plan
        inside = {
            "links": lambda: f"<ul>{self.links()}</ul>",
            "items": self.links,
            "heading": lambda: f'<h1><a href="/">{self.said()[:40]}</a></h1><p>{self.said()}</p>',
            "text": lambda: f"<p>{self.said()}</p><p>{self.said()}</p>",
            "bare": self.said,
            "both": lambda: f"<h3>{self.said()[:30]}</h3><ul>{self.links()}</ul><p>{self.said()}</p>",
            "remarks": lambda: f'<h2>{self.said()[:20]}</h2><div class="comment"><p>{self.said()}</p></div><ul><li>{self.said()}</li></ul>',
        }[layout]()
        word = words[next(self.word) % len(words)]
        return f'<{tag} class="{label} {word}">{inside}</{tag}>'

    def body(self, inside) -> str:
        blocks = [f"<h1>{self.said()}</h1>"]
        for _ in range(3 + next(self.word) % 6):
            kind = _BLOCKS[next(self.block) % len(_BLOCKS)]
            blocks.append(
                {
                    "list": lambda: f"<ul><li>{self.said()}</li><li>{self.said()}</li><li>{self.said()}</li></ul>",
                    "section": lambda: f"<section><h2>{self.said()}</h2><p>{self.said()}</p><p>{self.said()}</p></section>",
                    "div": lambda: f"<div><p>{self.said()}</p><p>{self.said()}</p></div>",
                    "quote": lambda: f"<blockquote><p>{self.said()}</p></blockquote>",
                    "table": lambda: f"<table><tr><th>{self.said()}</th><td>{self.said()}</td></tr></table>",
                    "dl": lambda: f"<dl><dt>{self.said()}</dt><dd>{self.said()}</dd></dl><figure><figcaption>{self.said()}</figcaption></figure>",
                    "linked": lambda: f'<p>{self.said()} <a href="/x">{self.said()[:30]}</a></p>',
                }.get(kind, lambda: f"<{kind}>{self.said()}</{kind}>")()
            )
        if inside:
            blocks.insert(1 + next(self.word) % len(blocks), self.part(inside))
        return "".join(blocks)


def labelled_pages(pages: int = 240) -> list[str]:
    plan, out = _Plan(), []
    for k in range(pages):
        tag, words = (None, ("",)) if k % 16 == 15 else CONTAINERS[k % len(CONTAINERS)]
        word = words[k // len(CONTAINERS) % len(words)]
        body = plan.body(INSIDE[k % len(INSIDE)])
        article = f'<{tag} class="keep {word}">{body}</{tag}>' if tag else body
        before = "".join(plan.part(BEFORE[(k + j) % len(BEFORE)]) for j in range(1 + k % 3))
        after = "".join(plan.part(AFTER[(2 * k + j) % len(AFTER)]) for j in range(1 + k % 4))
        inner = f"{before}{article}{after}"
        if k % 2:
            inner = f'<div class="{("wrapper", "page", "container", "row")[k // 2 % 4]}">{inner}</div>'
        opened = "<body>" if tag else '<body class="keep">'  # no smaller element holds the article
        out.append(f"<html><head><title>{plan.said()}</title></head>{opened}{inner}</body></html>")
    return out
