"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

Three states of a node: AROUND (a container of main text and other things), MAIN, OTHER.
Below AROUND anything may stand, below MAIN only MAIN and OTHER, below OTHER only OTHER. Trees
give each node the probabilities of its states, from subtree density, attribute tokens, depth,
place and siblings; the labelling with the highest likelihood that obeys the rule is found
bottom-up, level by level, for a batch of pages at once. The text blocks of MAIN nodes are kept.

Pages carry no labels. The trees learn from a bounded sample of pages, as they are (the
article element marks the main text) and rewritten: their pieces of text are laid out anew
with other elements, classes, side matter and reader comments, so that the trees can't lean on
one element alone.
"""

from __future__ import annotations

import functools
import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .bpe import slices
from .common import bounded_batches, table
from .dom import GROUPS, MARK, Nodes

AROUND, MAIN, OTHER = range(3)
#: Bounds of the training sample: pages, and code points of a page.
SAMPLE_ROWS, SAMPLE_LENGTH = 150, 50_000
#: Rewritten layouts of each sampled page.
LAYOUTS = 3
#: Bytes of pages that are parsed at once.
SLICE_BYTES = 1 << 20

#: Kinds of elements that are features of a node, and, where marked, of what it stands in.
KINDS = (
    ("article",), ("main",), ("section",), ("div", "center", "dd", "dt", "details"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6", "hgroup", "legend", "summary"), ("ul", "ol", "dl", "menu", "dir"), ("li",),
    ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog", "search"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("pre", "blockquote", "figure", "figcaption"), ("address",), ("#root", "html", "body"),
)
_KIND_OF = {tag: k for k, tags in enumerate(KINDS) for tag in tags}


class Batch:
    """The nodes of a batch of pages as arrays."""

    def __init__(self, pages: list[str | None]) -> None:
        nodes = Nodes()
        for i, page in enumerate(pages):
            nodes.add(i, page)
        self.nodes, self.count = nodes, len(pages)
        self.page, self.parent, self.depth = (np.array(x, np.int64) for x in (nodes.pages, nodes.parents, nodes.depths))
        self.kind, self.bits = np.array([_KIND_OF[t] for t in nodes.tags], np.int64), np.array(nodes.bits, np.int64)
        self.block_node, self.block_size = np.array(nodes.block_nodes, np.int64), np.array([len(t) for t in nodes.block_texts], np.int64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))

    def upwards(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = own.copy()
        for level in reversed(self.levels[1:]):
            np.add.at(out, self.parent[level], out[level])
        return out

    def downwards(self, bits: np.ndarray) -> np.ndarray:
        """The bits of all nodes that a node stands in."""
        out = np.zeros_like(bits)
        for level in self.levels[1:]:
            out[level] = out[self.parent[level]] | bits[self.parent[level]]
        return out

    def features(self) -> np.ndarray:
        n, texts = len(self.page), self.nodes.block_texts
        marks = np.array([t.count(".") + t.count(",") + t.count("?") + t.count("!") for t in texts], float)
        spaces = np.array([t.count(" ") + 1 for t in texts], float)
        rights = np.array(["©" in t for t in texts], float)
        summed = lambda x: np.bincount(self.block_node, weights=x, minlength=n)
        own, links = summed(self.block_size), summed(np.array(self.nodes.block_links, float))
        size, linked, marked, words, right, nodes, blocks = (self.upwards(x) for x in (own, links, summed(marks), summed(spaces), summed(rights), np.ones(n), summed(np.ones(len(texts)))))
        whole = np.maximum(size[np.flatnonzero(self.parent < 0)][self.page], 1)
        # The place of a node's text in the page: what the blocks before its first node have.
        before = np.concatenate([[0], np.cumsum(own)])[:-1]
        start = (before - before[np.flatnonzero(self.parent < 0)][self.page]) / whole
        up = np.maximum(self.parent, 0)
        inner = self.parent >= 0
        children = np.bincount(self.parent[inner], minlength=n)
        place = self._places()
        same = self.kind * (n + 1) + self.parent + 1
        _, which, alike = np.unique(same, return_inverse=True, return_counts=True)
        previous, following = self._beside(size)
        per = lambda a, b: a / np.maximum(b, 1)
        columns = [
            np.log1p(size), size / whole, per(linked, size), np.log1p(nodes), np.log1p(per(size, nodes)), np.log1p(own), per(own, size), per(marked, size) * 100, per(size, words), np.log1p(words),
            right > 0, np.log1p(per(size, blocks)), self.depth, start, start + size / whole, place, per(place, children[up]), children[up], children, per(alike[which], children[up]),
            per(size, per(size[up], children[up])), per(size, size[up]), np.log1p(previous), np.log1p(following), per(linked[up], size[up]), np.log1p(per(size[up], nodes[up])),
        ]
        inside_tags, inside_bits = self.downwards(1 << self.kind), self.downwards(self.bits)
        columns += [self.kind == k for k in range(len(KINDS))]
        columns += [(inside_tags >> k) & 1 for k in range(len(KINDS) - 1)]
        columns += [(self.bits >> k) & 1 for k in range(len(GROUPS))] + [(inside_bits >> k) & 1 for k in range(len(GROUPS))]
        return np.stack([np.asarray(c, float) for c in columns], axis=1)

    def _places(self) -> np.ndarray:
        """The number of each node among its siblings."""
        order = np.argsort(self.parent, kind="stable")
        parents = self.parent[order]
        first = np.searchsorted(parents, parents)
        out = np.empty(len(order), float)
        out[order] = np.arange(len(order)) - first
        return out

    def _beside(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sizes of the siblings before and after each node; 0: none."""
        order = np.argsort(self.parent, kind="stable")
        alike = self.parent[order][1:] == self.parent[order][:-1]
        previous, following = np.zeros(len(order)), np.zeros(len(order))
        previous[order[1:]] = np.where(alike, size[order[:-1]], 0)
        following[order[:-1]] = np.where(alike, size[order[1:]], 0)
        return previous, following

    def decoded(self, scores: np.ndarray) -> np.ndarray:
        """The states of all nodes: the highest sum of scores of those that obey the rule. Nodes without text don't count."""
        weight = self.upwards(np.bincount(self.block_node, minlength=len(self.page))) > 0
        best = np.where(weight[:, None], scores, 0.0)
        for level in reversed(self.levels):
            # What a node adds for each state of its parent: the best of the states that may stand below it.
            own = best[level]
            below = np.stack([own.max(1), np.maximum(own[:, MAIN], own[:, OTHER]), own[:, OTHER]], axis=1)
            inner = self.parent[level] >= 0
            np.add.at(best, self.parent[level][inner], below[inner])
        states = np.full(len(self.page), AROUND, np.int64)
        for level in self.levels:
            above = np.where(self.parent[level] >= 0, states[np.maximum(self.parent[level], 0)], AROUND)
            allowed = np.arange(3)[None, :] >= above[:, None]
            states[level] = np.where(allowed, best[level], -np.inf).argmax(1)
        return states

    def kept(self, states: np.ndarray) -> list[str]:
        """The text of each page: its blocks in MAIN nodes."""
        out: list[list[str]] = [[] for _ in range(self.count)]
        for k in np.flatnonzero(states[self.block_node] == MAIN) if len(self.block_node) else ():
            out[self.page[self.block_node[k]]].append(self.nodes.block_texts[k])
        return ["\n\n".join(x) for x in out]

    def marked(self) -> np.ndarray:
        """The states that a training page's marks say. Where none stands above, a node with marked main text below is around it."""
        main = np.array([m == "main" for m in self.nodes.marks], float)
        around = self.upwards(main) > 0
        states = np.full(len(self.page), OTHER, np.int64)
        for level in self.levels:
            for i in level:
                mark, up = self.nodes.marks[i], self.parent[i]
                if up >= 0 and states[up] != AROUND:
                    states[i] = OTHER if mark == "other" else states[up]
                else:
                    states[i] = {"main": MAIN, "other": OTHER}.get(mark, AROUND if around[i] else OTHER)
        return states


def by_article(page: str) -> str:
    """The page with marks where article elements begin."""
    return page.replace("<article", f'<article {MARK}="main"')


class _Pieces:
    """The texts of a page: those of its article, and the short ones around it. Without an article, long blocks count as its."""

    def __init__(self, page: str) -> None:
        batch = Batch([by_article(page)])
        states = batch.marked()[batch.block_node] if len(batch.block_node) else np.zeros(0)
        texts, links = batch.nodes.block_texts, batch.nodes.block_links
        found = bool((states == MAIN).any())
        inside = [bool(s == MAIN) if found else len(t) >= 80 and not k for t, k, s in zip(texts, links, states, strict=True)]
        own = [t for t, k in zip(texts, inside, strict=True) if k] or ["Text."]
        self.title, self.paragraphs = own[0], own[1:] or own
        self.others = [t for t, k in zip(texts, inside, strict=True) if not k] or ["Home"]


#: What the rewritten pages' elements are called: words of the token groups, alone and in compounds.
_NAMES = {
    "root": ("article", "content", "post", "entry-content", "article-body", "post-content", "story-body", "main-content", "articleBody", "blogpost", "prose", "text", ""),
    "nav": ("menu", "nav", "main-nav", "navbar", "site-navigation", "breadcrumbs", "pagination", "nav-links", ""),
    "header": ("header", "masthead", "site-header", "topbar", "page-banner", ""),
    "footer": ("footer", "site-footer", "colophon", "page-footer", "bottom", ""),
    "side": ("sidebar", "side", "widget", "content-sidebar", "right-rail", "secondary", ""),
    "notice": ("cookie-notice", "notice", "consent-banner", "alert", "gdpr", "popup", "announcement"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "post-ad", "ad-content"),
    "form": ("newsletter", "login-form", "subscribe", "search", "contact-form", ""),
    "comment": ("comments", "comment-list", "reader-comments", "post-comments", "responses", "replies", "discussion", "disqus_thread"),
    "share": ("share", "social", "share-buttons", "post-share", "follow-us"),
    "related": ("related", "related-posts", "recommended", "more-stories", "popular", "article-related"),
}


class _Layout:
    """A page laid out anew from its pieces, by draws."""

    def __init__(self, pieces: _Pieces, others: list[str], draw: random.Random) -> None:
        self.pieces, self.others, self.draw = pieces, others, draw

    def some(self, share: float) -> bool:
        return self.draw.random() < share

    def named(self, group: str, tags: tuple[str, ...], inner: str, mark: str = "") -> str:
        """An element with a name of the group; one of the plain tags always has one."""
        tag = self.draw.choice(tags)
        name = self.draw.choice(_NAMES[group])
        if tag in ("div", "section", "ul", "ol") and not name and group != "root":
            name = _NAMES[group][0]
        where = self.draw.choice(("class", "class", "id"))
        named = f' {where}="{name}"' if name and (tag in ("div", "section", "ul", "ol", "p") or self.some(0.5)) else ""
        return f'<{tag}{named} {MARK}="{mark}">{inner}</{tag}>' if mark else f"<{tag}{named}>{inner}</{tag}>"

    def words(self, most: int) -> str:
        return html.escape(" ".join(self.draw.choice(self.others).split()[: self.draw.randint(1, most)]))

    def links(self, most: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/">{self.words(4)}</a></li>' for _ in range(self.draw.randint(2, most))) + "</ul>"

    def other(self, group: str) -> str:
        """An element that isn't main text."""
        text = lambda tag="p", most=25: f"<{tag}>{self.words(most)}</{tag}>" if self.some(0.7) else self.words(most)
        if group == "nav":
            return self.named(group, ("nav", "nav", "div", "ul"), self.links(8), "other")
        if group == "header":
            return self.named(group, ("header", "header", "div"), self.draw.choice(("<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<h1>{}</h1>")).format(self.words(5)) + (self.other("nav") if self.some(0.5) else ""), "other")
        if group == "footer":
            return self.named(group, ("footer", "footer", "div"), self.draw.choice(("&copy; {}", "<p>&copy; {}</p>", "<p>{}</p>", "{}")).format(self.words(12)) + (self.links(4) if self.some(0.3) else ""), "other")
        if group == "side":
            return self.named(group, ("aside", "div"), f"<h3>{self.words(4)}</h3>" + text(most=40) + (self.links(6) if self.some(0.6) else ""), "other")
        if group == "form":
            return self.named(group, ("form", "form", "div"), f"<label>{self.words(5)}</label><input name=a><button>{self.words(2)}</button>" + (text() if self.some(0.5) else ""), "other")
        if group == "comment":
            each = "".join(self.draw.choice(("<li>{}</li>", "<p>{}</p>", '<div class="comment"><p>{}</p></div>', '<div class="comment"><h4>{}</h4><p>{}</p></div>')).format(self.words(3), self.words(60)).replace("{}", "") for _ in range(self.draw.randint(1, 6)))
            return self.named(group, ("div", "section", "ol", "ul"), (f"<h3>{self.words(3)}</h3>" if self.some(0.5) else "") + each, "other")
        if group in ("share", "related"):
            return self.named(group, ("div", "section", "ul") if group == "related" else ("div", "ul"), (f"<h3>{self.words(3)}</h3>" if self.some(0.5) else "") + self.links(5), "other")
        return self.named(group, ("div", "div", "section", "p") if group == "notice" else ("div", "div", "aside"), text(most=30), "other")

    def paragraph(self, text: str) -> str:
        inner = html.escape(text)
        if self.some(0.15):
            inner = f"<b>{inner}"
        elif self.some(0.2):
            head, _, rest = inner.partition(" ")
            inner = f'{head} <a href="/x">{rest[:30]}</a>{rest[30:]}' if "&" not in rest[:36] else inner
        form = self.draw.random()
        if form < 0.7:
            return f"<p>{inner}" + ("</p>" if self.some(0.8) else "<br>")
        if form < 0.78:
            return f"<div>{inner}</div>"
        if form < 0.84:
            return f"<blockquote>{inner}</blockquote>"
        if form < 0.9:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in inner.split(". ")) + "</ul>"
        if form < 0.95:
            return f"<h2>{html.escape(' '.join(text.split()[:5]))}</h2><p>{inner}</p>"
        return f"<figure><figcaption>{html.escape(' '.join(text.split()[:12]))}</figcaption></figure><p>{inner}</p>"

    def page(self) -> str:
        own = self.pieces.paragraphs[: self.draw.choice((1, 2, 4, 8, 30))]
        if self.some(0.25):  # short articles
            own = [" ".join(p.split()[: self.draw.randint(1, 6)]) for p in own]
        body = [f"<h1>{html.escape(self.pieces.title)}</h1>"] * self.some(0.85) + [self.paragraph(p) for p in own]
        for group, share in (("ad", 0.3), ("share", 0.2), ("related", 0.15), ("form", 0.15), ("notice", 0.1), ("nav", 0.1)):
            if self.some(share):
                body.insert(self.draw.randint(1, len(body)), self.other(group))
        if self.some(0.2):
            body.append(self.other("comment"))
        tags = self.draw.choice((("article",), ("article",), ("main",), ("div",), ("div",), ("section",)))
        main = self.named("root", tags, "".join(body), "main")
        if tags == ("article",) and self.some(0.3):
            main = f"<main>{main}</main>"
        parts = [self.other(g) for g, share in (("notice", 0.3), ("header", 0.7), ("nav", 0.7), ("ad", 0.4)) if self.some(share)]
        rest = [self.other(g) for g, share in (("related", 0.3), ("side", 0.5), ("form", 0.3), ("comment", 0.5), ("ad", 0.3), ("footer", 0.8)) if self.some(share)]
        inner = "".join([*parts, main, *rest])
        for name in self.draw.choice(((), (), ("wrapper",), ("container", "page"), ("site", "row", "col"))):
            inner = f'<div class="{name}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{html.escape(self.pieces.title)}</title></head><body>{inner}</body></html>"


def shortened(page: str, draw: random.Random) -> str:
    """The page with a few words in place of its article: a heading and one or two paragraphs."""
    before, _, rest = page.partition("<article")
    article, end, after = rest.partition("</article>")
    words = Batch([article.partition(">")[2]]).nodes.block_texts or ["Text."]
    few = lambda: html.escape(" ".join(draw.choice(words).split()[: draw.randint(1, 5)]))
    return f'{before}<article {MARK}="main"><h1>{few()}</h1>' + f"<p>{few()}</p>" * draw.randint(1, 2) + end + after


def training_pages(pages: list[str], layouts: int = LAYOUTS) -> list[str]:
    """Marked pages: those with an article as they are and shortened, and each laid out anew."""
    out = []
    pieces = [_Pieces(p) for p in pages] or [_Pieces("")]
    for i, (page, own) in enumerate(zip(pages or [""], pieces, strict=True)):
        if "<article" in page:
            out += [by_article(page), shortened(page, random.Random(i))]
        beside = pieces[(i + 1) % len(pieces)]
        for k in range(layouts):
            # Comments and side matter are prose too: another page's article gives them words.
            out.append(_Layout(own, own.others + beside.others + beside.paragraphs[:5], random.Random(f"{i}:{k}")).page())
    return out


def fitted(pages: list[str]) -> BoostedTrees:
    """The trees of a sample of pages. No pages: trees of invented ones."""
    batch = Batch(training_pages(pages))
    return BoostedTrees(batch.features(), batch.marked(), 3)


def trained(pages: DataFrame, html_col: str = "html") -> BoostedTrees:
    """The trees of the different pages with the smallest hashes, SAMPLE_ROWS of up to SAMPLE_LENGTH code points.

    The hashes are chosen first, so that no more pages come to the driver, whatever the number of partitions.
    """
    some = pages.select(F.col(html_col).alias("html")).where((F.length("html") > 0) & (F.length("html") <= SAMPLE_LENGTH)).withColumn("h", F.xxhash64("html"))
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).collect()]
    return fitted([r.html for r in some.where(F.col("h") <= max(least)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()] if least else [])


def texts_of(pages: list[str | None], model: BoostedTrees) -> list[str]:
    batch = Batch(pages)
    return batch.kept(batch.decoded(model.log_probabilities(batch.features())))


def _extracted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(texts_of(some.column(1).to_pylist(), model.value), pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A block is the text between two boundaries of block elements; its references are decoded
    and its white space is one blank. Null and empty html: empty text. Null ids and urls and
    repeated rows are kept; very long pages are parsed whole, one at a time. No rows: no rows.
    Other columns are left out, whatever their names.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    given = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), F.col(url_col).alias("url"))
    kind = {f.name: f.dataType.simpleString() for f in given.schema}
    got = given.mapInArrow(functools.partial(_extracted, model=spark.sparkContext.broadcast(model)), f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return got.withColumn("n_chars", F.char_length("text").cast("long"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, trained(pages))


#: What the tables' pages ask for: they have one article element, of headings and paragraphs, and these references.
_SQL_REFERENCES = (("&quot;?", '"'), ("&#x27;", "''"), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&"))
_sql_text = "regexp_replace(b, '<[^>]*>', ' ', 'g')"
for _pattern, _mark in _SQL_REFERENCES:
    _sql_text = f"regexp_replace({_sql_text}, '{_pattern}', '{_mark}', 'g')"
OP13_SQL = f"""
WITH cut AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS a FROM pages),
blocks AS (SELECT r, unnest(string_split_regex(a, '</?(p|h[1-6])>')) AS b, generate_subscripts(string_split_regex(a, '</?(p|h[1-6])>'), 1) AS k FROM cut),
plain AS (SELECT r, k, trim(regexp_replace({_sql_text}, '\\s+', ' ', 'g')) AS t FROM blocks),
joined AS (SELECT r, string_agg(t, chr(10) || chr(10) ORDER BY k) AS t FROM plain WHERE t <> '' GROUP BY r)
SELECT page_id, url, coalesce(t, '') AS text, length(coalesce(t, ''))::BIGINT AS n_chars FROM cut LEFT JOIN joined USING (r)
"""
