"""Main text of web pages: site templates found by their recurrence, and page furniture by its markup.

The article is looked for first: ``article`` or ``main`` elements, or the innermost element
that holds most of the page's text. Subtrees around it, and in it those that group blocks
(but not its paragraphs, headings, items or quotes, nor one that holds most of its text),
are hashed (tag, attributes that name it, its texts and children). Spark counts each hash's
distinct pages per host; subtrees that stand on many pages of a host are its template and
are deleted, together with menus, headers, footers, sidebars, notices, adverts, forms,
comments and code, by tag, role and names. What is left of the article is the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, staged

#: A template subtree stands on so many distinct pages of its host, whatever the host's size.
MANY_PAGES = 4
#: Up to so many (host, hash) pairs the templates are broadcast (8 bytes each); beyond, joined by page.
BROADCAST_PAIRS = 1_000_000

_TEXT = re.compile(r"[^<]+")
_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of a tag; quoted values may hold a '>'.
_INSIDE = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_FURNITURE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "search", "datalist", "optgroup", "fieldset"} | _RAW
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "status"}
#: Words of class names and ids that call an element a piece of furniture, and words that may stand beside them.
_NAMED = re.compile(
    r"ads?|adverts?|advertis\w*|adsense|adslot|banners?|promos?|promotions?|sponsor\w*|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscri\w*|signup|login|paywall|sidebar|menus?|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|comments?|commentlist|disqus|reply|replies|respond|share|sharing|social|related|recommend\w*|widgets?|skiplink|toolbar|pagination|pager|search",
    re.I,
)
_BESIDE = set("a area articles bar big block bottom box btn button buttons buttonset buy cell center col column columns container content desktop end first fixed float floating global group holder home icon icons inline inner input item items js label large last left line link links list local main me media message middle min mini mobile module more msg my new note number o on one outer page pane panel placeholder post posts primary right row secondary section sign site small sticky story tabs tag tags target text the title to tool tools top two unit up us view wide wrap wrapper form feed heading section".split())
#: Tags that hold an article's prose, and those that a heading may stand in by a name.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "figcaption", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "address"}
#: Of a section's ids, which are often what a table of contents points to, only these call it furniture.
_SECTION_ID = re.compile(r"comments?|commentlist|disqus|replies|respond|related|newsletter|sidebar|ads?", re.I)
_LAYOUT = re.compile(r"(?:^|[_-])(?:has|have|no|not|with|without|is)[_-]", re.I)
_KEEP = {"html", "body", "main", "article"}


class Node:
    __slots__ = ("tag", "attributes", "parts")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.parts = tag, attributes, []


def parse(page: str) -> Node:
    """A tree of a page: implied ends as browsers do it for paragraphs, items and cells; unclosed and stray tags are tolerated.

    Work grows with the page's length alone: open elements are found by tag, not by a walk up
    the tree, and after the first tag whose quotes don't end, tags end at the next '>'.
    """
    root = Node("#")
    stack, blocks, places = [root], [0], {}  # open elements; which of them are no inline ones; places of each tag
    at, n, last, quotes = 0, len(page), page.rfind(">"), True

    def close(i: int) -> None:
        for node in stack[i:]:
            places[node.tag].pop()
        del stack[i:]
        while blocks[-1] >= i:
            blocks.pop()

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < n:
        if page[at] != "<" or at > last:
            m = _TEXT.match(page, at) if at <= last else None
            text = m[0] if m else page[at:]
            stack[-1].parts.append(entities.unescape(text) if "&" in text else text)
            at += len(text)
            continue
        if page.startswith(("<!", "<?"), at) and (m := _ASIDE.match(page, at)):
            if m[1] is not None:
                stack[-1].parts.append(m[1])
            at = m.end()
            continue
        m = _TAG.match(page, at)
        if not m:
            stack[-1].parts.append("<")
            at += 1
            continue
        inside = m.end()
        end = _INSIDE.match(page, inside) if quotes else None
        if end:
            at = end.end()
        else:
            quotes = False
            at = page.index(">", inside) + 1
        tag, named = m[2].lower(), page[inside : at - 1]
        if m[1]:
            i = nearest([tag])
            if i and (tag not in _INLINE or i > blocks[-1]):
                close(i)
            continue
        if tag in _CLOSES_P and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in _SIBLINGS:
            ends, scope = _SIBLINGS[tag]
            i = nearest(ends)
            if i > nearest(scope - ends):
                close(i)
        node = Node(tag, named)
        stack[-1].parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in _VOID and not (named.endswith("/") and tag not in _INLINE and tag not in _CLOSES_P):
            places.setdefault(tag, []).append(len(stack))
            if tag not in _INLINE:
                blocks.append(len(stack))
            stack.append(node)
    return root


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


def named_so(name: str, heading: bool = False) -> bool:
    """Whether a class name or an id calls its element a piece of furniture.

    All of its words must speak of furniture or go with it: 'share-buttons' does, 'notice-period' doesn't.
    'has-sidebar' and the like speak of a layout, 'post-header' of the article's own heading.
    """
    if _LAYOUT.search(name):
        return False
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"side[-_]bar", "sidebar", re.sub(r"skip[-_]link", "skiplink", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))) if w]
    if not words or heading and {"header", "masthead"} & set(words) and not any(_NAMED.fullmatch(w) for w in words if w not in ("header", "masthead")):
        return False
    if "header" in words and {"post", "article", "entry", "story"} & set(words):
        words.remove("header")
    return any(map(_NAMED.fullmatch, words)) and all(_NAMED.fullmatch(w) or w in _BESIDE for w in words)


def furniture(node: Node, wrapper: bool = False) -> bool:
    """Whether a subtree is no part of an article, by its tag and naming attributes; a wrapper of the article is not judged by names."""
    if node.tag in _FURNITURE:
        return True
    if node.tag in _KEEP and node.tag != "article" or not node.attributes.strip(" /"):
        return False
    a = attributes(node.attributes)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in _ROLES:
        return True
    if wrapper:
        return False
    names, own = a.get("class", "").split(), a.get("id", "")
    if node.tag == "article":
        return bool(re.search(r"comment|repl(?:y|ies)|\bads?\b|sponsor|promo", f"{' '.join(names)} {own}", re.I))
    heading = re.fullmatch("h[1-6]", node.tag) is not None
    if any(named_so(x, heading) for x in names):
        return True
    # ids of headings and sections are what links point to
    return bool(own) and not heading and (_SECTION_ID.fullmatch(own) is not None if node.tag == "section" else named_so(own))


def squeeze(text: str) -> str:
    return " ".join(text.split())


def hashes(root: Node) -> list[tuple[Node, int]]:
    """Each node below and the root with its subtree's hash, children first."""
    out: list[tuple[Node, int]] = []
    start = lambda node: (node, iter(node.parts), xxhash.xxh3_64(f"{node.tag}\n{squeeze(node.attributes)}".encode()))
    stack = [start(root)]
    while stack:
        node, parts, h = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if text := squeeze(part):
                    h.update(b"\1" + text.encode("utf-8", "replace"))
            else:
                stack.append(start(part))
                break
        else:
            stack.pop()
            value = h.intdigest()
            if stack:
                stack[-1][2].update(b"\2" + value.to_bytes(8, "little"))
            out.append((node, value - (1 << 63)))
    return out


def _block(node: Node) -> bool:
    tag = node.tag
    return tag not in _INLINE and tag not in _VOID and tag not in _RAW and tag not in _KEEP and tag not in ("#", "head")


class Article:
    """A parsed page's article: its top elements, and which subtrees may be a template of the site."""

    def __init__(self, root: Node):
        self.root, self.wrappers, self.gone_at = root, set(), {}
        self.tops = self.found()
        if not self.tops:  # the names of the elements around it may have hidden it
            self.wrappers, self.gone_at = self.holders(), {}
            self.tops = self.found()
        self.sizes = self.measured()
        self.region = self.tops or [self.innermost()]

    def gone(self, node: Node) -> bool:
        if id(node) not in self.gone_at:
            self.gone_at[id(node)] = furniture(node, id(node) in self.wrappers)
        return self.gone_at[id(node)]

    def holders(self) -> set[int]:
        """Elements above an article or main."""
        out: set[int] = set()
        stack = [(self.root, iter(self.root.parts))]
        while stack:
            for part in stack[-1][1]:
                if not isinstance(part, str):
                    stack.append((part, iter(part.parts)))
                    break
            else:
                node, _ = stack.pop()
                if stack and (node.tag in ("article", "main") or id(node) in out):
                    out.add(id(stack[-1][0]))
        return out

    def below(self, top: Node, tag: str) -> list[Node]:
        """The outermost live elements of a tag, in page order."""
        out, stack = [], [iter(top.parts)]
        while stack:
            for part in stack[-1]:
                if not isinstance(part, str) and not self.gone(part):
                    if part.tag == tag:
                        out.append(part)
                    else:
                        stack.append(iter(part.parts))
                        break
            else:
                stack.pop()
        return out

    def found(self) -> list[Node]:
        """Articles; mains where there are none, or where articles hold the smaller part of them."""
        articles, mains = self.below(self.root, "article"), self.below(self.root, "main")
        if articles and mains:
            inside = [x for m in mains for x in self.below(m, "article")]
            sizes = self.measured()
            if len(inside) == len(articles) and 2 * sum(sizes[id(x)] for x in inside) < sum(sizes[id(m)] for m in mains):
                return mains
        return articles or mains

    def measured(self) -> dict[int, int]:
        """Characters of each live element's text."""
        sizes, stack = {}, [(self.root, iter(self.root.parts))]
        sizes[id(self.root)] = 0
        while stack:
            node, parts = stack[-1]
            for part in parts:
                if isinstance(part, str):
                    sizes[id(node)] += len(squeeze(part))
                elif not self.gone(part):
                    sizes[id(part)] = 0
                    stack.append((part, iter(part.parts)))
                    break
            else:
                stack.pop()
                if stack:
                    sizes[id(stack[-1][0])] += sizes[id(node)]
        return sizes

    def innermost(self) -> Node:
        """The innermost element that groups blocks and holds most of the text of each one around it."""
        node = self.root
        while True:
            large = [p for p in node.parts if not isinstance(p, str) and 2 * self.sizes.get(id(p), 0) > self.sizes[id(node)] and p.tag not in _PROSE and p.tag not in _INLINE and p.tag not in ("ul", "ol", "dl", "table")]
            if not large:
                return node
            node = large[0]

    def candidates(self) -> list[Node]:
        """Live subtrees that may be a template: blocks around the article, and in it those that group blocks and hold no more than half of it."""
        out, own = [], {id(x) for x in self.region}
        most = sum(self.sizes[id(x)] for x in self.region)
        stack = [(x, True) for x in self.tops] if self.tops else [(self.root, self.root is self.region[0])]
        while stack:
            node, inside = stack.pop()
            for part in node.parts:
                if isinstance(part, str) or self.gone(part):
                    continue
                within = inside or id(part) in own
                if _block(part) and id(part) not in own and 2 * self.sizes[id(part)] <= most and not (inside and part.tag in _PROSE):
                    out.append(part)
                stack.append((part, within))
        return out

    def text(self, templates: set[int]) -> str:
        """The article's blocks without the elements of these ids, each with single spaces, joined by empty lines."""
        blocks: list[str] = []
        held: list[str] = []

        def flush() -> None:
            if text := squeeze("".join(held)):
                blocks.append(text)
            held.clear()

        for top in self.tops or [self.root]:
            stack = [(top, iter(top.parts))]
            while stack:
                node, parts = stack[-1]
                for part in parts:
                    if isinstance(part, str):
                        held.append(part)
                    elif part.tag == "br":
                        held.append(" ")
                    elif id(part) in templates or self.gone(part):
                        if part.tag not in _INLINE:
                            flush()
                    else:
                        if part.tag not in _INLINE:
                            flush()
                        stack.append((part, iter(part.parts)))
                        break
                else:
                    stack.pop()
                    if stack and node.tag not in _INLINE:
                        flush()
            flush()
        return "\n\n".join(blocks)


def page_parts(page: str) -> tuple[Article, int, list[tuple[Node, int]]]:
    """A page's article, the whole page's hash, and the subtrees that may be a template with theirs."""
    root = parse(page)
    found = hashes(root)
    article = Article(root)
    of = {id(node): value for node, value in found}
    return article, found[-1][1], [(node, of[id(node)]) for node in article.candidates()]


def page_hashes(page: str) -> tuple[int, list[int]]:
    """The whole page's hash and those of the subtrees that may be a template."""
    _, whole, parts = page_parts(page)
    return whole, sorted({value for _, value in parts})


def page_text(page: str, templates: frozenset[int]) -> str:
    """The article's text without subtrees of these hashes."""
    article, _, parts = page_parts(page)
    return article.text({id(node) for node, value in parts if value in templates})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text; a null or odd url counts as one host of its own. Repeated
    pages count once toward a host's templates, so copies of an article aren't a template, and paragraphs
    that articles share aren't either. Pages of
    any length and depth are read whole. Repeated and null page_ids are rows like others, other columns
    of ``pages`` are not looked at, and an empty table gives no rows.
    """
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://([^/?#]*)", 1))
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), host.alias("host"), F.xxhash64(host).alias("site"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_hashes(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.list_(pa.int64()))], names=["site", "sum", "page", "parts"])

    sums = base.select("site", F.md5("html").alias("sum"), "html")
    seen, seen_path = staged(sums.mapInArrow(describe, "site long, sum string, page long, parts array<long>"), "subtrees")
    distinct = seen.groupBy("site", "page").agg(F.first("parts").alias("parts"))
    often = distinct.select("site", F.explode("parts").alias("part")).groupBy("site", "part").agg(F.count("*").alias("n"))
    templates, templates_path = staged(often.where(F.col("n") >= MANY_PAGES).select("site", "part"), "templates")
    names = ["page_id", "url", "text", "n_chars"]
    schema = "page_id long, url string, text string, n_chars long"

    def rows(b: pa.RecordBatch, out: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=names)

    if templates.count() <= BROADCAST_PAIRS:
        drop_path(spark, seen_path)
        # a pair as one number: the part's hash, turned by the host's
        keys = templates.select(F.col("site").bitwiseXOR(F.col("part")).alias("key")).toArrow().column(0).combine_chunks()
        held = spark.sparkContext.broadcast(np.unique(np.asarray(keys, dtype=np.int64)))
        drop_path(spark, templates_path)

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for b in batches:
                out = []
                for page, site in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    article, _, parts = page_parts(page)
                    marked: set[int] = set()
                    if len(known) and parts:
                        mine = np.fromiter((v for _, v in parts), np.int64, len(parts)) ^ np.int64(site)
                        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                        marked = {id(parts[i][0]) for i in np.flatnonzero(known[at] == mine).tolist()}
                    out.append(article.text(marked))
                yield rows(b, out)

        return base.select("page_id", "url", "html", "site").mapInArrow(texts, schema)

    # each page's own templates: bounded by the page, however many its host has
    hits = seen.dropDuplicates(["site", "sum"]).select("site", "sum", F.explode("parts").alias("part")).join(templates, ["site", "part"])
    own, _ = staged(hits.groupBy("site", "sum").agg(F.collect_list("part").alias("templates")), "page-templates")
    drop_path(spark, seen_path, templates_path)

    def texts_of_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(b, [page_text(page, frozenset(own or ())) for page, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])

    return base.withColumn("sum", F.md5("html")).join(own, ["site", "sum"], "left").select("page_id", "url", "html", "templates").mapInArrow(texts_of_own, schema)
