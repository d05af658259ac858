"""Labelled pages for training the main-text model: layouts put together by a seeded generator.

Every page is a list of parts; a part is markup whose text is main text or not. Names of containers, order of parts,
lengths of paragraphs and the words are drawn at random, and some pages have sloppy markup (open paragraphs, no
sections, text straight in a container). ``training_pages`` yields (html, label of each block in page order).
"""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

_SYLLABLES = "an ba ce da en for ga hi in ka lo ma ne or pa que ri sa ti un ver wa ye zo".split()
_MAIN = [
    ("<article>", "</article>"), ("<article class='post'>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ("<div class='content'>", "</div>"), ("<div id='content'>", "</div>"), ("<div class='post-body'>", "</div>"),
    ("<div class='entry-content'>", "</div>"), ("<div class='story'>", "</div>"), ("<section class='article-body'>", "</section>"),
    ("<div id='main'><div class='text'>", "</div></div>"), ("<div role='main'>", "</div>"),
]


def _words(r: Random, low: int, high: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
    words[0] = words[0].capitalize()
    return " ".join(words)


def _sentences(r: Random, low: int, high: int) -> str:
    return " ".join(_words(r, 2, 14) + r.choice([".", ".", ".", "!", "?", ", " + _words(r, 1, 4).lower() + "."]) for _ in range(r.randint(low, high)))


def _list(r: Random, opening: str, closing: str) -> tuple[str, int]:
    n = r.randint(2, 7)
    items = "".join(f"<li><a href='/{i}'>{_words(r, 1, 3)}</a></li>" for i in range(n))
    return f"{opening}<ul>{items}</ul>{closing}", n


def _boilerplate(r: Random, kind: str) -> tuple[str, int]:
    """(markup, blocks)"""
    if kind in ("nav", "menu"):
        return _list(r, *r.choice([("<nav>", "</nav>"), ("<div class='menu'>", "</div>"), ("<div id='navbar'>", "</div>"), ("<nav class='breadcrumb'>", "</nav>")]))
    if kind == "header":
        tag, end = r.choice([("<header>", "</header>"), ("<div class='header'>", "</div>"), ("<div id='masthead'>", "</div>")])
        return f"{tag}<h1>{_words(r, 1, 3)}</h1><p>{_words(r, 2, 6)}</p>{end}", 2
    if kind == "footer":
        tag, end = r.choice([("<footer>", "</footer>"), ("<div class='footer'>", "</div>"), ("<div id='footer'>", "</div>")])
        return f"{tag}&copy; {_words(r, 1, 4)} &middot; {_sentences(r, 1, 2)}{end}", 1
    if kind == "ad":
        tag, end = r.choice([("<div class='ad'>", "</div>"), ("<div class='advert'>", "</div>"), ("<div class='banner'>", "</div>"), ("<div class='sponsored'>", "</div>"), ("<aside class='promo'>", "</aside>")])
        return f"{tag}{_sentences(r, 1, 2)}{end}", 1
    if kind == "sidebar":
        tag, end = r.choice([("<aside>", "</aside>"), ("<div class='sidebar'>", "</div>"), ("<div class='widget'>", "</div>"), ("<div id='related'>", "</div>")])
        if r.random() < 0.5:
            return _list(r, tag, end)
        return f"{tag}<h3>{_words(r, 1, 3)}</h3><p>{_sentences(r, 1, 3)}</p>{end}", 2
    if kind == "notice":
        tag, end = r.choice([("<div class='cookie'>", "</div>"), ("<div class='notice'>", "</div>"), ("<div id='consent'>", "</div>"), ("<div role='alert'>", "</div>"), ("<div class='newsletter'>", "</div>")])
        return f"{tag}<p>{_sentences(r, 1, 2)}</p>{end}", 1
    if kind == "form":
        return f"<form action='/s'><label>{_words(r, 1, 2)}</label><input name='q'><p>{_words(r, 2, 6)}</p></form>", 2
    tag, end = r.choice([
        ("<section class='comments'>", "</section>"), ("<div id='comments'>", "</div>"), ("<ol class='commentlist'>", "</ol>"), ("<div class='replies'>", "</div>"),
        ("<section id='discussion'>", "</section>"), ("<div class='responses'>", "</div>"), ("<section class='reader-comments'>", "</section>"),
        ("<div id='respond'>", "</div>"), ("<div id='disqus_thread'>", "</div>"), ("<div class='feedback'>", "</div>"), ("<ul class='thread'>", "</ul>"),
    ])
    n = r.randint(1, 5)
    opening, closing = r.choice([
        ("<div class='comment'>", "</div>"), ("<article class='comment-body'>", "</article>"), ("<div class='reply'>", "</div>"),
        ("<article class='comment'>", "</article>"), ("<div class='response'>", "</div>"), ("<div>", "</div>"),
    ])
    if tag.startswith(("<ol", "<ul")):
        opening, closing = r.choice([("<li class='comment'>", "</li>"), ("<li class='reply'>", "</li>"), ("<li>", "</li>")])
    one = f"{opening}<p>{{}}</p>{closing}"
    return tag + "".join(one.format(_sentences(r, 1, 4)) for _ in range(n)) + end, n


def _body(r: Random) -> tuple[str, int]:
    """The inside of the main text."""
    n, out = r.choice([1, 2, 3, 5, 8, 14]), []
    blocks = 0
    if r.random() < 0.7:
        out.append(f"<h1>{_words(r, 1, 8)}</h1>")
        blocks += 1
    for _ in range(n):
        kind, text = r.random(), _sentences(r, 1, r.choice([1, 1, 3, 8]))
        if kind < 0.1:
            out.append(f"<h2>{_words(r, 1, 6)}</h2>")
        elif kind < 0.2:
            items = r.randint(1, 4)
            out.append("<ul>" + "".join(f"<li>{_sentences(r, 1, 1)}</li>" for _ in range(items)) + "</ul>")
            blocks += items - 1
        elif kind < 0.27:
            out.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.34:
            out.append(f"<pre>{text}</pre>")
        elif kind < 0.4:
            out.append(f"<table><tr><td>{text}</td></tr></table>")
        elif kind < 0.55:
            out.append(f"<p><b>{text}<br>")
        elif kind < 0.7:
            out.append(f"<p>{text} <a href='/x'>{_words(r, 1, 2)}</a> {_words(r, 1, 3)}.</p>")
        else:
            out.append(f"<p>{text if r.random() < 0.8 else _words(r, 1, 2)}</p>")
        blocks += 1
    return "".join(out), blocks


def training_pages(count: int, seed: int = 5) -> Iterator[tuple[str, list[int]]]:
    r = Random(seed)
    for _ in range(count):
        parts: list[tuple[str, int, int]] = []
        before = r.sample(["nav", "menu", "header", "ad", "notice", "sidebar"], r.randint(0, 4))
        after = r.sample(["sidebar", "comments", "ad", "form", "footer", "menu"], r.randint(0, 4))
        for kind in before:
            parts.append((*_boilerplate(r, kind), 0))
        opening, closing = r.choice(_MAIN)
        body, n = _body(r)
        inner, inside = [(body, n, 1)], None
        if r.random() < 0.25:  # an advert, a share list or comments inside the article
            inside = r.choice(["ad", "sidebar", "notice", "comments", "form"])
            inner.append((*_boilerplate(r, inside), 0))
            if r.random() < 0.5:
                more, m = _body(r)
                inner.append((more, m, 1))
        parts.append((opening, 0, 0))
        parts += inner
        parts.append((closing, 0, 0))
        for kind in after:
            parts.append((*_boilerplate(r, kind), 0))
        html = "<!DOCTYPE html><html><head><title>x</title><script>var a='</p>';</script></head><body>" + "".join(p[0] for p in parts) + "</body></html>"
        yield html, [label for _, blocks, label in parts for _ in range(blocks)]
