"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, less so under elements whose cues (tag, role, words of
class and id) mark page furniture, and tags score negative; all weights come from labelled pages. One linear scan finds
the contiguous region of largest score. The region grows to each element that holds it, the whole page left out, if it
has half of the words there, or a quarter where cues mark an article; it is cut to the page's main element where that holds a quarter of
its words; blocks in the region under furniture are left out.

Text of a block: character references decoded, white space turned into one blank, trimmed; blocks in page order, joined
by a newline. Inline tags do not part words, line breaks do. Formulas and the fallback text of embedded objects are text.

Reading is one pass: a tag that does not end is looked for once, no closing tag is looked for behind the last bracket, and an
element costs the same at any depth.

Defined results: null and empty html, and pages without words, give the empty text; markup that does not end, or closes
what was not open, is read as far as it goes; very long pages are read whole; rows that repeat give equal rows; null ids
and urls stay null; an empty table gives no rows; columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, table
from .labelled_pages import labelled_pages

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|select|button|title|head)\b(?P<rawrest>(?:\"[^\"<]*\"|'[^'<]*'|[^'\">])*+)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"<]*\"|'[^'<]*'|[^'\">])*+)>"
    r"|<[/!?a-zA-Z][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
BREAK = frozenset("br td th input".split())
#: Cells of a row are one block, but for cells that are furniture.
CELL = frozenset(("td", "th"))
#: Elements of which nothing is shown, or only a control: code that does not end runs to the end of the page.
CODE = frozenset(("script", "style", "textarea"))
CLOSE = {n: re.compile(rf"</{n}\b[^>]*>" + ("|(?=<body\\b)" if n == "head" else ""), re.I) for n in "script style noscript template iframe textarea select button title head".split()}
#: Elements that are followed from start to end; others do not carry cues.
HOLDS = frozenset("article aside body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul td li dd p span label".split())
WHOLE = frozenset(("html", "body"))
FURNITURE = -1.0
LEAST_SHARE = 0.5


def cues(tag: str, rest: str, inside: bool) -> list[str]:
    """Cues of an element. inside: whether an article or main element holds it."""
    out = [f"{tag}@article" if tag == "header" and inside else tag]
    for m in ATTRIBUTE.finditer(rest) if rest else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("hidden")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out.append("hidden")
        else:
            out += [f"is {w.lower()}" for w in NAME.findall(value)]
    # the head of an article holds its title
    return ["header@article" if inside and c == "is header" else c for c in out]


class Weights:
    def __init__(self, cue: dict[str, float], tag: dict[str, float]):
        self.cue, self.tag = cue, tag

    def of(self, found: list[str]) -> float:
        """The strongest cue of an element."""
        return max((self.cue.get(c, 0.0) for c in found), key=abs, default=0.0)


class Elements:
    """The open elements, and for every element its parent, its last descendant and the blocks that it holds.

    Every step costs what it opens or closes, however deep it stands: the last place of each name on the stack is kept.
    """

    def __init__(self):
        self.names: list[str] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.first_block: list[int] = []
        self.end_block: list[int] = []
        self.weight: list[float] = []
        self.seen: list[list[str]] = []
        self.stack: list[int] = []
        self.inside: list[bool] = []  # of each on the stack: whether it or one above marks an article
        self.spots: dict[str, list[int]] = {}
        self.cleared = 0  # so many from the bottom are known to hold an article

    def open(self, name: str, found: list[str], weight: float, block: int) -> None:
        self.spots.setdefault(name, []).append(len(self.stack))
        self.inside.append(name in ("article", "main") or weight >= 1 or bool(self.inside and self.inside[-1]))
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.stack.append(len(self.names))
        self.names.append(name)
        self.seen.append(found)
        self.weight.append(weight)
        self.last.append(-1)
        self.first_block.append(block)
        self.end_block.append(-1)

    def close_from(self, place: int, block: int) -> None:
        while len(self.stack) > place:
            e = self.stack.pop()
            self.inside.pop()
            self.spots[self.names[e]].pop()
            self.last[e], self.end_block[e] = len(self.names) - 1, block
        self.cleared = min(self.cleared, len(self.stack))

    def spot(self, name: str) -> int:
        """The highest place of a name on the stack; -1 without one."""
        held = self.spots.get(name)
        return held[-1] if held else -1

    def holds_article(self) -> None:
        """What holds an article is not furniture, whatever its names say."""
        for e in self.stack[self.cleared :]:
            self.weight[e] = max(self.weight[e], 0.0)
        self.cleared = len(self.stack)


class Page:
    """Items (score, block) in page order; blocks with their text, innermost element and furniture mark."""

    def __init__(self, html: str, weights: Weights):
        self.html, self.weights = html, weights
        self.scores: list[float] = []
        self.of: list[int] = []
        self.blocks: list[str] = []
        self.holder: list[int] = []
        self.plain: list[bool] = []
        self.sizes: list[int] = []
        self.elements = Elements()
        self._read()
        self._judge()

    def _read(self) -> None:
        html, weights, el = self.html, self.weights, self.elements
        text: list[str] = []
        unclosed: set[str] = set()

        def flush() -> None:
            if not text:
                return
            words = "".join(text).split()
            text.clear()
            if words:
                self.scores.append(0.0)
                self.of.append(len(self.blocks))
                self.blocks.append(" ".join(words))
                self.sizes.append(len(words))
                self.holder.append(el.stack[-1] if el.stack else -1)

        def say(piece: str) -> None:
            text.append(unescape(piece) if "&" in piece else piece)

        # no tag ends behind the last bracket, so none is looked for there
        at, n, end = 0, len(html), html.rfind(">") + 1
        while at < n:
            m = TOKEN.search(html, at, end) if at < end else None
            if m is None:
                open_comment = html.find("<!--", max(at, end))
                say(html[at : open_comment if open_comment >= 0 else n])
                break
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            if m["raw"]:
                name = m["raw"].lower()
                if not m["rawrest"].endswith("/") or name in ("script", "style"):
                    close = None if name in unclosed else CLOSE[name].search(html, at, max(at, end))
                    # of what does not end only the tag goes, but for code
                    at = close.end() if close else n if name in CODE else at
                    if not close:
                        unclosed.add(name)
                if name != "button":
                    text.append(" ")
                continue
            if not m["tag"]:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = n
                continue
            tag, rest, ends = m["tag"].lower(), m["rest"], bool(m["end"])
            if tag in BLOCK:
                flush()
            elif tag in BREAK:
                text.append(" ")
            self.scores.append(weights.tag.get(tag, -0.3))
            self.of.append(-1)
            if tag not in HOLDS:
                continue
            block = len(self.blocks)
            if ends:
                k = el.spot(tag)
                if tag in CELL and k >= 0 and el.weight[el.stack[k]] < FURNITURE:
                    flush()
                    block = len(self.blocks)
                if k >= 0 and (tag != "p" or k == len(el.stack) - 1):
                    el.close_from(k, block)
                continue
            if tag in BLOCK and el.stack and el.names[el.stack[-1]] == "p":
                el.close_from(len(el.stack) - 1, block)
            if tag == "li":
                k = el.spot("li")
                if k > max(el.spot("ul"), el.spot("ol"), el.spot("menu")):
                    el.close_from(k, block)
            if rest.endswith("/"):
                continue
            found = cues(tag, rest, bool(el.inside and el.inside[-1]))
            own = weights.of(found)
            if own >= FURNITURE and tag in ("article", "main"):
                el.holds_article()
            if tag in CELL and own < FURNITURE:
                flush()
                block = len(self.blocks)
            el.open(tag, found, own, block)
        flush()
        el.close_from(0, len(self.blocks))

    def _judge(self) -> None:
        el = self.elements
        least, most = [], []
        for e, parent in enumerate(el.parent):
            w = el.weight[e]
            least.append(min(w, least[parent]) if parent >= 0 else w)
            most.append(max(w, most[parent], 0.0) if parent >= 0 else max(w, 0.0))
        for i, b in enumerate(self.of):
            if b >= 0:
                h = self.holder[b]
                cue = least[h] if h >= 0 else 0.0
                self.plain.append(cue >= FURNITURE)
                self.scores[i] = (cue if cue < FURNITURE else 1.0 + 0.1 * (most[h] if h >= 0 else 0.0)) * self.sizes[b]

    def region(self) -> tuple[int, int]:
        """First and last block of the best contiguous run of items; (0, -1) without any."""
        best, run, start, where = 0.0, 0.0, 0, (0, 0)
        for i, s in enumerate(self.scores):
            if run <= 0:
                run, start = 0.0, i
            run += s
            if run > best:
                best, where = run, (start, i + 1)
        inside = [b for b in self.of[where[0] : where[1]] if b >= 0]
        return (inside[0], inside[-1]) if inside else (0, -1)

    def text(self) -> str:
        first, last = self.region()
        if last < first:
            return ""
        el = self.elements
        words = [0]
        for size, plain in zip(self.sizes, self.plain, strict=True):
            words.append(words[-1] + size * plain)
        holder = self.holder[first]
        for h in self.holder[first : last + 1]:
            while holder >= 0 and not holder <= h <= el.last[holder]:
                holder = el.parent[holder]
        while holder >= 0:
            if el.names[holder] not in WHOLE:
                a, z = el.first_block[holder], el.end_block[holder]
                share = LEAST_SHARE / 2 if el.weight[holder] >= 1 else LEAST_SHARE
                if words[last + 1] - words[first] >= share * (words[z] - words[a]):
                    first, last = min(first, a), max(last, z - 1)
            holder = el.parent[holder]
        first, last = self._within_main(first, last, words)
        return "\n".join(self.blocks[b] for b in range(first, last + 1) if self.plain[b])


    def _within_main(self, first: int, last: int, words: list[int]) -> tuple[int, int]:
        """The region, cut to the page's main element if that is no furniture and holds a quarter of the region's words: what stands beside it is not main.

        The element counts whole if half of its words are in the region.
        """
        el = self.elements
        for e, name in enumerate(el.names):
            if name == "main" and el.weight[e] >= FURNITURE:
                low, high = el.first_block[e], el.end_block[e] - 1
                a, z = max(first, low), min(last, high)
                held = words[z + 1] - words[a] if a <= z else 0
                if held and held >= LEAST_SHARE / 2 * (words[last + 1] - words[first]):
                    return (low, high) if held >= LEAST_SHARE * (words[high + 1] - words[low]) else (a, z)
        return first, last


#: Tags that say nothing of what they hold.
GENERIC = frozenset("html body div section p ul ol li table td span label dl dd figure details".split())


def learned(pages: list[tuple[str, list[str]]], known: Weights | None = None) -> Weights:
    """Weights from labelled pages: log odds of words under a cue, and costs of tags by where they stand.

    known: weights of a first pass, by which heads of articles are told from heads of pages.
    """
    known = known or Weights({}, {})
    inside, outside, tags_in, tags_all = Counter(), Counter(), Counter(), Counter()
    for html, blocks in pages:
        page, wanted, good = Page(html, known), Counter(blocks), []
        for b in page.blocks:
            good.append(wanted[b] > 0)
            wanted[b] -= good[-1]
        words: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for b, h in enumerate(page.holder):
            while h >= 0:
                words[h][0 if good[b] else 1] += page.sizes[b]
                h = page.elements.parent[h]
        for h, (i, o) in words.items():
            # an element that holds most of the main text says nothing against itself by what else it holds
            for c in set(page.elements.seen[h]):
                inside[c] += i
                outside[c] += 0 if i > o else o
        low, high = html.find(blocks[0][:12]), html.rfind(blocks[-1][-12:])
        for m in TOKEN.finditer(html):
            if m["tag"]:
                tags_all[m["tag"].lower()] += 1
                tags_in[m["tag"].lower()] += low <= m.start() <= high
    cue = {c: max(-4.0, min(2.0, math.log((inside[c] + 1) / (outside[c] + 1)))) for c in {*inside, *outside} - GENERIC}
    tag = {t: -(0.05 + 1.2 * (n - tags_in[t] + 0.5) / (n + 1)) for t, n in tags_all.items()}
    return Weights(cue | {"hidden": -4.0}, tag)


_learned: Weights | None = None


def default_weights() -> Weights:
    global _learned
    if _learned is None:
        pages = labelled_pages()
        _learned = learned(pages, learned(pages))
    return _learned


def main_text(html: str | None, weights: Weights) -> str:
    return Page(html, weights).text() if html else ""


def extracted(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    used = weights or default_weights()

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(h, used) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.selectExpr("cast(page_id AS long) page_id", "cast(url AS string) url", "cast(html AS string) html")
    return map_arrow(slim, batch, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
