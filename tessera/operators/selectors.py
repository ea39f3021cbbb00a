"""Selection of page elements by CSS selectors, schemas of fields, XPath, and a chain of fallbacks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from .web import VOID, Markup, first_good, keyword_section

#: Elements that the start of some others ends.
ENDED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
PART = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<key>[\w-]+)(?:(?P<op>[~|^$*]?=)[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]|:(?P<nth>first-child|last-child)")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    children: list = field(default_factory=list)  # nodes and texts

    def text(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or x.tag not in ("script", "style"):
                stack += reversed(x.children)
        return " ".join("".join(out).split())

    def below(self):
        """All elements under this one, in page order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            x = stack.pop()
            yield x
            stack += [c for c in reversed(x.children) if isinstance(c, Node)]


class _Tree(Markup):
    def __init__(self, references: bool = True):
        super().__init__(references)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        elif self.at.tag != "p" and self.at.parent and self.at.parent.tag == "p" and tag in ENDED_BY["p"] and self.at.tag in ("b", "i", "em", "strong", "span", "a"):
            self.at = self.at.parent.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(self.written(data))


def tree(html: str | None, references: bool = True) -> Node:
    parser = _Tree(references)
    parser.read(html)
    return parser.root


class Selector:
    """Compound selectors: tag, *, #id, .class, [attribute], :first-child and :last-child, joined by blanks, > and commas."""

    def __init__(self, text: str):
        self.choices = [self._chain(c.strip()) for c in text.split(",") if c.strip()]

    @staticmethod
    def _chain(text: str) -> list[tuple[str, list[re.Match]]]:
        """(how it hangs on the one before, conditions) from left to right."""
        out, how = [], " "
        for word in re.sub(r"\s*>\s*", " > ", text).split():
            if word == ">":
                how = ">"
                continue
            parts = list(PART.finditer(word))
            if "".join(m[0] for m in parts) != word:
                raise ValueError(f"no selector: {word}")
            out.append((how, parts))
            how = " "
        return out

    @staticmethod
    def _holds(node: Node, parts: list[re.Match]) -> bool:
        for m in parts:
            if m["tag"]:
                good = m["tag"] in ("*", node.tag)
            elif m["id"]:
                good = node.attrs.get("id") == m["id"]
            elif m["cls"]:
                good = m["cls"] in node.attrs.get("class", "").split()
            elif m["key"]:
                have, want = node.attrs.get(m["key"]), m["value"]
                tests = {None: lambda h: True, "=": lambda h: h == want, "~=": lambda h: want in h.split(), "|=": lambda h: h == want or h.startswith(f"{want}-"), "^=": lambda h: h.startswith(want), "$=": lambda h: h.endswith(want), "*=": lambda h: want in h}
                good = have is not None and tests[m["op"]](have)
            else:
                same = [c for c in node.parent.children if isinstance(c, Node)]
                good = same[0 if m["nth"] == "first-child" else -1] is node
            if not good:
                return False
        return True

    def _matches(self, node: Node, chain, k: int, top: Node) -> bool:
        if not self._holds(node, chain[k][1]):
            return False
        if k == 0:
            return True
        above = node.parent
        while above is not None and above is not top and above.tag:
            if self._matches(above, chain, k - 1, top):
                return True
            if chain[k][0] == ">":
                return False
            above = above.parent
        return False

    def find(self, top: Node) -> list[Node]:
        return [n for n in top.below() if any(self._matches(n, c, len(c) - 1, top) for c in self.choices)]


def records(html: str | None, base: str, fields: list[dict]) -> list[dict[str, str]]:
    """One record for each element of the base selector; a field is the first element of its own selector below, as text or attribute.

    fields: name, selector, type (text or attribute) and attribute; a field that is not there is left out.
    """
    out = []
    for top in Selector(base).find(tree(html)):
        row = {}
        for f in fields:
            found = Selector(f["selector"]).find(top) if f.get("selector") else [top]
            if found and f.get("type", "text") == "text":
                row[f["name"]] = found[0].text()
            elif found and f["attribute"] in found[0].attrs:
                row[f["name"]] = found[0].attrs[f["attribute"]]
        out.append(row)
    return out


def by_schema(pages: DataFrame, key: str, schema: dict, html: str = "html") -> DataFrame:
    """(key, pos, a column for each field): records that a schema {baseSelector, fields} extracts."""
    base, fields = schema["baseSelector"], schema["fields"]
    Selector(base)

    @F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: records(t, base, fields))

    found = pages.select(key, F.posexplode(run(html)).alias("pos", "__r"))
    return found.select(key, "pos", *[F.col("__r")[f["name"]].alias(f["name"]) for f in fields])


def by_xpath(df: DataFrame, column: str, **fields: str) -> DataFrame:
    """df with a text for each XPath expression over well-formed markup; null where nothing is found."""
    return df.withColumns({name: F.nullif(F.xpath_string(F.col(column), F.lit(path)), F.lit("")) for name, path in fields.items()})


def selected_texts(pages: DataFrame, key: str, selectors: dict[str, str], html: str = "html", references: bool = True) -> DataFrame:
    """(key, name -> text): for each named selector the texts of its elements, joined by newlines; page parsed once.

    references: whether character references are decoded; else they stand as they are written.
    """
    names = list(selectors)

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        found = [Selector(selectors[n]) for n in names]

        def one(t):
            top = tree(t, references)
            return ["\n".join(x for x in (n.text() for n in s.find(top)) if x) for s in found]

        return texts.map(one)

    return pages.select(key, run(html).alias("__t")).select(key, *[F.col("__t")[k].alias(n) for k, n in enumerate(names)])


def with_fallbacks(pages: DataFrame, key: str, primary: str, fallbacks: list[str], keywords: list[str], html: str = "html", references: bool = True) -> DataFrame:
    """(key, method, content): the primary selector's text if it is not blank; else of the fallbacks, in order, the first whose text has a keyword section, and that section.

    Pages for which nothing is found have method and content null.
    """
    names = {"primary": primary} | {f"fallback_{k}": s for k, s in enumerate(fallbacks, 1)}
    found = selected_texts(pages, key, names, html, references)
    tries = found.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("priority"), F.lit(n).alias("method"), F.col(n).alias("text")) for k, n in enumerate(names)])).alias("t")).select(key, "t.*")
    sections = keyword_section(tries.withColumn("__k", F.struct(key, "priority")), "__k", "text", keywords).select(F.col(f"__k.{key}").alias("s_key"), F.col("__k.priority").alias("s_priority"), "section")
    judged = tries.join(sections, (F.col(key) == F.col("s_key")) & (F.col("priority") == F.col("s_priority")))
    content = F.when(F.col("priority") == 0, F.col("text")).otherwise(F.col("section"))
    best = first_good(judged.select(key, "priority", "method", content.alias("content")), key, "priority", F.coalesce(F.trim("content") != "", F.lit(False)))
    return pages.select(key).join(best.select(key, "method", "content"), key, "left")
