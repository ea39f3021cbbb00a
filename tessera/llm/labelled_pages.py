"""Labelled pages: invented pages in common layouts, with the blocks of their main text."""

from __future__ import annotations

import random

#: Usual names of page parts that are not the article, by part.
NAMES = {
    "menu": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination pager toc".split(),
    "header": "header masthead topbar logo branding tagline".split(),
    "footer": "footer colophon copyright legal credits".split(),
    "sidebar": "sidebar aside related widget rail recommended trending".split(),
    "notice": "cookie consent gdpr notice banner alert popup modal overlay toast disclaimer".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adbox dfp".split(),
    "form": "form newsletter subscribe signup login search".split(),
    "comments": "comment comments replies respond disqus discussion".split(),
    "share": "share social sharing tags meta toolbar".split(),
}
ARTICLE = "article content main post story entry post-content entry-content article-body text body-text".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    parts = "an be co de el fi go ha in ka lo mi no or pa re se ta un vi".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))).capitalize() + "."


def _part(rng: random.Random, part: str) -> str:
    """Markup of one part that is not the article."""
    name = rng.choice(NAMES[part])
    own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(part)
    if own and rng.random() < 0.5:
        head, tail = (f"<{own}>", f"</{own}>")
    else:
        box = rng.choice(["div", "div", "section"])
        head, tail = f'<{box} {rng.choice(["class", "id"])}="{name}">', f"</{box}>"
    links = "".join(f'<li><a href="/{k}">{_words(rng, 1, 2)}</a></li>' for k in range(rng.randint(3, 8)))
    inside = {
        "menu": f"<ul>{links}</ul>",
        "header": f"<h2>{_words(rng, 2, 4)}</h2><p>{_words(rng, 3, 9)}</p>",
        "footer": f"<p>&copy; {_words(rng, 4, 15)}</p>",
        "sidebar": f"<h3>{_words(rng, 1, 3)}</h3><ul>{links}</ul><p>{_words(rng, 4, 14)}</p>",
        "notice": f"<p>{_words(rng, 6, 25)}</p><button>{_words(rng, 1, 1)}</button>",
        "advert": f"{_words(rng, 3, 20)}",
        "form": f"<label>{_words(rng, 1, 3)}</label><input name=q><p>{_words(rng, 3, 10)}</p>",
        "comments": "".join(f"<div><b>{_words(rng, 1, 2)}</b><p>{_words(rng, 5, 40)}</p></div>" for _ in range(rng.randint(1, 5))),
        "share": f"<a href=x>{_words(rng, 1, 1)}</a> <a href=y>{_words(rng, 1, 2)}</a>",
    }[part]
    return head + inside + tail


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page and the blocks of its main text."""
    rng = random.Random(seed)
    blocks, body = [], []
    title = _words(rng, 3, 9)
    head = f"<h1>{title}</h1>"
    blocks.append(title)
    body.append(f"<header>{head}</header>" if rng.random() < 0.3 else head)
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        text = _words(rng, 4, 60)
        if kind < 0.75:
            body.append(f"<p>{text}</p>" if rng.random() < 0.8 else f'<p>{text} <a href="z">{_words(rng, 1, 2)}</a></p>')
            blocks.append(" ".join(body[-1].replace("<p>", "").replace("</p>", "").replace('<a href="z">', "").replace("</a>", "").split()))
        elif kind < 0.85:
            body.append(f"<h2>{text}</h2>")
            blocks.append(text)
        elif kind < 0.93:
            items = [_words(rng, 2, 9) for _ in range(rng.randint(2, 4))]
            body.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            blocks += items
        else:
            body.append(f"<blockquote>{text}</blockquote>")
            blocks.append(text)
        if rng.random() < 0.12:
            body.append(_part(rng, rng.choice(["advert", "share", "form", "sidebar", "notice"])))
    box = rng.choice(["article", "article", "main", "div", "section"])
    mark = f'<{box} class="{rng.choice(ARTICLE)}">' if box in ("div", "section") or rng.random() < 0.4 else f"<{box}>"
    before = [_part(rng, p) for p in ("notice", "header", "menu", "advert") if rng.random() < 0.6]
    after = [_part(rng, p) for p in ("share", "comments", "sidebar", "form", "footer") if rng.random() < 0.6]
    return "<html><head><title>x</title></head><body>" + "".join(before) + mark + "".join(body) + f"</{box}>" + "".join(after) + "</body></html>", blocks


def labelled_pages(n: int = 240) -> list[tuple[str, list[str]]]:
    return [labelled_page(k) for k in range(n)]
