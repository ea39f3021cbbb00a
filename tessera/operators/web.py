"""Pages: cleaning, links, images, crawl frontier, fallback selection. Input is a table of pages already fetched."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from .cleaning import held

EXCLUDED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def without_tags(html: Column, tags: tuple[str, ...] = EXCLUDED) -> Column:
    """Elements of these tags go, with what they hold."""
    for tag in tags:
        html = F.regexp_replace(html, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", " ")
    return html


def visible_text(html: Column) -> Column:
    """Text without markup and comments, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def blocks(html: Column, least_words: int = 3) -> Column:
    """Texts between block tags that have at least `least_words` words."""
    cut = F.split(html, "(?i)</?(?:p|div|h[1-6]|li|ul|ol|article|section|table|tr|blockquote|body|main)\\b[^>]*>")
    texts = F.transform(cut, visible_text)
    return F.filter(texts, lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != "")) >= least_words)


def pruned(html: Column, threshold: float = 0.45, least_words: int = 5) -> Column:
    """Blocks in which text without links is at least `threshold` of all text, and that have enough words."""
    cut = F.split(html, "(?i)</?(?:p|div|h[1-6]|li|ul|ol|article|section|table|tr|blockquote|body|main)\\b[^>]*>")
    scored = F.transform(cut, lambda b: F.struct(visible_text(b).alias("text"), F.length(visible_text(F.regexp_replace(b, "(?is)<a\\b[^>]*>.*?</a>", " "))).alias("own")))
    good = F.filter(scored, lambda s: (s["own"] >= threshold * F.length(s["text"])) & (F.size(F.filter(F.split(s["text"], " "), lambda w: w != "")) >= least_words))
    return F.transform(good, lambda s: s["text"])


def contents(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds cleaned_html, raw_text and fit_text beside the html."""
    cleaned = without_tags(F.col(html))
    return pages.withColumns({"cleaned_html": cleaned, "raw_text": visible_text(F.col(html)), "fit_text": F.array_join(pruned(cleaned), "\n")})


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)<a\\b[^>]*?\\shref=\"([^\"]*)\""), F.lit(1))


def image_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)<img\\b[^>]*?\\ssrc=\"([^\"]*)\""), F.lit(1))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


def absolute(url: Column, link: Column) -> Column:
    """A link as an address: with scheme as it is, from the root on the page's host, else beside the page."""
    root = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    base = F.regexp_extract(url, "^([^?#]*/)", 1)
    return F.when(F.rlike(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), link).when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(url, "^([a-zA-Z]+:)", 1), link)).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(F.concat(base, link))


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, href, target, internal): links of each page in order; internal if they stay on its host."""
    found = pages.select(key, F.col(url).alias("__u"), F.posexplode(hrefs(F.col(html))).alias("pos", "href"))
    found = found.withColumn("target", absolute(F.col("__u"), F.col("href")))
    return found.select(key, "pos", "href", "target", F.coalesce(host(F.col("target")) == host(F.col("__u")), F.lit(False)).alias("internal"))


def on_domains(df: DataFrame, url: str, allowed: list[str] | None = None, blocked: list[str] | None = None) -> DataFrame:
    h = host(F.col(url))
    if allowed:
        df = df.where(h.isin([d.lower() for d in allowed]))
    return df.where(h.isNull() | ~h.isin([d.lower() for d in blocked])) if blocked else df


def matches_glob(url: Column, pattern: str) -> Column:
    return F.like(url, F.lit(pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")))


def keyword_relevance(url: Column, keywords: list[str], weight: float = 0.7) -> Column:
    """weight times the share of keywords that the address contains."""
    low = F.lower(url)
    hits = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k))
    return F.size(hits) / F.lit(len(keywords)) * weight


def crawl_frontier(edges: DataFrame, start: DataFrame, max_depth: int = 2, per_page: int | None = None, score: str | None = None) -> DataFrame:
    """(url, depth): least depth at which links from the start pages reach an address.

    edges: source, target and, with per_page, a score by which only so many links of a page are followed.
    """
    if per_page:
        w = Window.partitionBy("source").orderBy(F.col(score).desc(), "target")
        edges = edges.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_page)
    edges = edges.select("source", "target").distinct()
    seen = start.select("url", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, max_depth + 1):
        found = front.join(edges, front.url == edges.source).select(F.col("target").alias("url")).distinct()
        front = found.join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth"))
        seen = seen.union(front)
    return seen


def best_first_crawl(edges: DataFrame, start: DataFrame, score: str = "score", max_depth: int = 3, max_pages: int = 100, at_once: int = 10) -> DataFrame:
    """(url, depth, score, visit): pages in the order in which a crawl visits them that always follows its best open links.

    edges: source, target, internal links only, and a score of the target. Each round takes the `at_once` best open addresses (ties by
    address) and opens the links on them; an address is opened once, at the least depth and by the best score of the
    round that finds it. Only a round's few addresses pass through one queue; the tables of all seen and open ones stay
    distributed. It ends with max_pages visits or when nothing is open.
    """
    edges = edges.select("source", "target", F.col(score).alias("score"))
    open_ = start.select("url", F.lit(0).alias("depth"), F.lit(0.0).alias("score")).distinct()
    seen, visited, n = open_.select("url"), None, 0
    while n < max_pages:
        best = held(open_.orderBy(F.col("score").desc(), "url").limit(min(at_once, max_pages - n)))
        row = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "url"))
        taken = best.count()
        if not taken:
            break
        visits = best.select("url", "depth", "score", (row + n).alias("visit"))
        visited = visits if visited is None else visited.union(visits)
        n += taken
        found = best.where(F.col("depth") < max_depth).select(F.col("url").alias("source"), "depth").join(edges, "source")
        found = found.groupBy(F.col("target").alias("url")).agg((F.min("depth") + 1).alias("depth"), F.max("score").alias("score"))
        found = held(found.join(seen, "url", "left_anti"))
        seen = held(seen.union(found.select("url")))
        open_ = held(open_.join(best.select("url"), "url", "left_anti").unionByName(found))
    return visited


def crawl_statistics(crawled: DataFrame) -> DataFrame:
    """Pages and mean score by depth; no rows for no pages."""
    return crawled.groupBy("depth").agg(F.count(F.lit(1)).alias("n_pages"), F.avg("score").alias("mean_score")).orderBy("depth")


def parent_section(url: Column) -> Column:
    """First path segment, behind an optional version or docs prefix; null without any."""
    return F.nullif(F.regexp_extract(url, "^[a-zA-Z]+://[^/]+/(?:v/(?:docs|[0-9]+(?:[.][0-9]+)*)/)?([^/?#]+)", 1), F.lit(""))


def keyword_section(df: DataFrame, key: str, column: str, keywords: list[str], header_after: int = 10) -> DataFrame:
    """(key, section): lines from the first that holds a keyword; a ## line ends it once more than `header_after` are kept.

    Lines with a keyword are kept wherever they stand before that end.
    """
    lines = F.split(column, "\n")
    has = lambda line: F.array_max(F.array(*[F.contains(F.upper(line), F.lit(k.upper())).cast("int") for k in keywords])) == 1
    folded = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("on"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept")),
        lambda acc, line: F.when(acc["done"], acc)
        .when(has(line), F.struct(F.lit(True).alias("on"), F.lit(False).alias("done"), F.concat(acc["kept"], F.array(line)).alias("kept")))
        .when(~acc["on"], acc)
        .when(F.startswith(line, F.lit("##")) & (F.size(acc["kept"]) > header_after), F.struct(F.lit(True).alias("on"), F.lit(True).alias("done"), acc["kept"].alias("kept")))
        .otherwise(F.struct(F.lit(True).alias("on"), F.lit(False).alias("done"), F.concat(acc["kept"], F.array(line)).alias("kept"))),
    )
    return df.select(key, F.when(F.size(folded["kept"]) > 0, F.array_join(folded["kept"], "\n")).alias("section"))


def first_good(candidates: DataFrame, key: str, priority: str, good: Column, methods: str = "method") -> DataFrame:
    """Of each key's candidates the good one of least priority."""
    w = Window.partitionBy(key).orderBy(priority, methods)
    return candidates.where(good).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def with_failures(urls: DataFrame, results: DataFrame, url: str = "url") -> DataFrame:
    """A row for every address; those without a result are failures with an error."""
    joined = urls.join(results.withColumn("__found", F.lit(True)), url, "left")
    return joined.withColumn("success", F.coalesce("success", F.lit(False))).withColumn("error", F.when(F.col("__found").isNull(), F.coalesce("error", F.lit("no result"))).otherwise(F.col("error"))).drop("__found")


def run_summary(results: DataFrame, seconds: float) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("n_urls"), F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failed"), (F.count(F.lit(1)) / F.lit(seconds)).alias("urls_per_second"))


def preview(c: Column, longest: int = 300) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("..."))).otherwise(c)


class Markup(HTMLParser):
    """Text and attributes with their character references decoded, or all as they are written."""

    def __init__(self, references: bool = True):
        super().__init__(convert_charrefs=True)
        self.references = references

    def read(self, html: str | None) -> None:
        # what stands for an ampersand is decoded to it, and no other reference is left
        self.feed((html or "") if self.references else (html or "").replace("&", "&amp;"))
        self.close()

    def written(self, data: str) -> str:
        """Scripts and styles have no references, so nothing is decoded there."""
        return data if self.references or self.cdata_elem not in self.CDATA_CONTENT_ELEMENTS else data.replace("&amp;", "&")


class _Select(Markup):
    """Elements that a simple selector (tag, #id, .class, tag.class) matches: their text and attributes."""

    def __init__(self, selector: str, references: bool = True):
        super().__init__(references)
        self.tag, self.mark = (selector, "")
        for sign in "#.":
            if sign in selector:
                self.tag, self.mark = selector.split(sign)[0], sign + selector.split(sign, 1)[1]
        self.depth, self.found = [], []

    def _hit(self, tag: str, attrs: dict) -> bool:
        if self.tag and tag != self.tag:
            return False
        if self.mark.startswith("#"):
            return attrs.get("id") == self.mark[1:]
        return not self.mark or self.mark[1:] in (attrs.get("class") or "").split()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self._hit(tag, attrs):
            self.found.append({"text": [], "attrs": attrs})
            if tag not in VOID:
                self.depth.append([tag, 1, self.found[-1]])
                return
        for d in self.depth:
            if d[0] == tag and tag not in VOID:
                d[1] += 1

    def handle_endtag(self, tag):
        for d in self.depth:
            if d[0] == tag:
                d[1] -= 1
        self.depth = [d for d in self.depth if d[1] > 0]

    def handle_data(self, data):
        for d in self.depth:
            d[2]["text"].append(self.written(data))


def select_elements(html: str | None, selector: str, references: bool = True) -> list[dict[str, str]]:
    parser = _Select(selector, references)
    parser.read(html)
    return [{"text": " ".join("".join(f["text"]).split()), **{k: v or "" for k, v in f["attrs"].items()}} for f in parser.found]


def by_selector(pages: DataFrame, key: str, selector: str, html: str = "html", references: bool = True) -> DataFrame:
    """(key, pos, fields): the elements that a simple selector matches; fields: text and attributes.

    references: whether character references are decoded; else they stand as they are written.
    """

    @F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: select_elements(t, selector, references))

    return pages.select(key, F.posexplode(run(html)).alias("pos", "fields"))


def seed_urls(*sources: DataFrame, pattern: str | None = None, url: str = "url") -> DataFrame:
    """Distinct addresses of all sources, those of a glob only if one is given."""
    out = sources[0].select(url)
    for s in sources[1:]:
        out = out.union(s.select(url))
    out = out.distinct()
    return out.where(matches_glob(F.col(url), pattern)) if pattern else out


def sitemap_urls(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """Every <loc> text of sitemaps, trimmed."""
    found = F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()"))
    return maps.select(F.explode(found).alias("url")).select(F.trim("url").alias("url"))


#: Hosts of social networks that a crawl can leave out.
SOCIAL = ("facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "pinterest.com", "tiktok.com", "youtube.com")


def kept_links(found: DataFrame, external: bool = False, social: bool = False) -> DataFrame:
    """Links from `links`, without external ones and those to social networks unless they are asked for."""
    out = found if external else found.where("internal")
    h = F.regexp_replace(host(F.col("target")), "^www[.]", "")
    return out if social else out.where(h.isNull() | ~h.isin(list(SOCIAL)))


def of_content_type(df: DataFrame, column: str = "content_type", wanted: str = "text/html") -> DataFrame:
    """Rows of a content type, whatever its parameters."""
    return df.where(F.lower(F.trim(F.substring_index(column, ";", 1))) == wanted)


def adaptive_crawl(edges: DataFrame, start: DataFrame, terms: DataFrame, wanted: list[str], top: int = 3, confidence: float = 0.7, gain: float = 0.05, most: int = 20) -> DataFrame:
    """(url, depth) by rounds that follow each page's best links until the pages found cover the wanted terms.

    edges: source, target, score; terms: url, term. A round ends the crawl when the share of wanted terms that its pages
    have reaches the confidence, grows by less than the gain, or `most` pages are reached. Only counts come to the driver.
    """
    seen, depth, before = start.select("url", F.lit(0).alias("depth")), 0, 0.0
    while True:
        covered = seen.join(terms.where(F.col("term").isin(wanted)), "url").agg(F.count_distinct("term")).first()[0] / max(1, len(wanted))
        if covered >= confidence or depth and covered - before < gain or seen.count() >= most:
            return seen.orderBy("depth", "url").limit(most)
        before, depth = covered, depth + 1
        seen = crawl_frontier(edges, start, depth, top, "score")
