"""Main text of web pages by deducing each host's template.

A page is read as tokens: elements, told apart by their path of structural tags with class and id, and blocks of text under
them. Over the pages of a host every token has an occurrence vector, how often it is on each page; tokens that share a
vector form an equivalence class. A class is large if it has two tokens or more, one of them an element, and valid if each
is at most once on a page and its pages hold several articles (or it is the host's most frequent one): copies of an article
share its tokens too, but are no template. The elements of the large valid classes are the template, and nest by their
paths. An element outside of it, and its text, belong to the slot of the template element around it.

A text is repeated if it is in a class of the template, or in several articles: pages of equal main text count as one article.
From a slot that is mostly repeated only the repeated blocks go, so an article stays, on its copies as well. Slots that are
mostly links go, and so do menus, forms, adverts, comment sections and so on; what is left is extracted. Marked articles
and names of classes limit where slots are looked at.

Vectors are compared by fingerprints (exclusive or of hashes of page and count), which aggregate like counts, so no
task ever holds the pages of a host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelink.llm.shared import named, small_batches, unnamed

# Kinds of elements and words in class and id names, by their meaning in HTML and common use.
RAW = "script style noscript template svg math iframe object textarea select option title head".split()
INLINE = "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr big strike center nobr".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK_TEXT = "p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address tr thead tbody tfoot summary".split()
CHROME = "nav footer aside form menu dialog button fieldset".split()
CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login "
    "search comment comments disqus reply replies respond discussion share sharing social related recommended widget widgets toolbar pagination pager skip "
    "copyright legal tracking".split()
)
CONTENT_WORDS = {"article", "articlebody", "content", "main", "post", "entry", "story", "body"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url) -> str:
    m = _HOST.match(url) if isinstance(url, str) else None
    return m[1].lower() if m else ""


class Node:
    """An open structural element."""

    __slots__ = ("tag", "label", "path", "chrome", "hinted", "content")

    def __init__(self, tag: str, label: str, parent: Node | None, chrome: bool, hinted: bool, content: int):
        self.tag, self.label = tag, label
        self.path = (parent.path if parent else ()) + (label,)
        self.chrome, self.hinted, self.content = chrome, hinted, content


def _name_words(names: str) -> set[str]:
    """Words of class, id and role names; a name like no-sidebar says nothing, and an article's header is no site header."""
    out: set[str] = set()
    for name in names.lower().split():
        words = re.split(r"[^a-z]+", name)
        if words[0] in ("no", "with", "without", "has", "is"):
            continue
        found = set(words) - {""}
        out |= found - {"header"} if found & {"article", "entry", "post", "story"} else found
    return out


def _node(tag: str, attributes: str, parent: Node) -> Node:
    found = {m[0].lower(): (m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    words = _name_words(f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}")
    inside = parent.content > 0
    hinted = parent.hinted or bool(words & CHROME_WORDS)
    chrome = parent.chrome or tag in CHROME or (tag == "header" and not inside) or "hidden" in found or found.get("aria-hidden") == "true"
    chrome = chrome or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
    main = 3 if tag == "article" or found.get("itemprop", "").lower() == "articlebody" else 2 if tag == "main" or found.get("role") == "main" else 1 if words & CONTENT_WORDS and tag not in ("html", "body") else 0
    label = tag + "".join("." + x for x in sorted(found.get("class", "").split())) + ("#" + re.sub(r"\d+", "0", found["id"]) if found.get("id") else "")
    return Node(tag, label, parent, chrome, hinted, max(parent.content, main))


def parse(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Blocks of text (element, text, characters inside links) in page order, and the structural elements.

    Text directly under an element, with its inline markup, is a block until the next block tag or line break. Elements
    that are not closed end with their parent; a paragraph ends the one before it.
    """
    root = Node("html", "html", None, False, False, 0)
    stack, nodes, blocks, text = [root], [], [], []
    links = linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        block = " ".join(entities.unescape("".join(text)).split())
        if block:
            blocks.append((stack[-1], block, linked))
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text.append(raw)
        if links:
            linked += len(raw)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        closing = bool(m[1])
        if tag in RAW:
            if tag == "head":
                continue
            if not closing and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else (end if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if tag in VOID or tag in BLOCK_TEXT or tag in ("html", "body"):
            links = 0
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        else:
            node = _node(tag, m[3], stack[-1])
            nodes.append(node)
            if not m[3].rstrip().endswith("/"):
                stack.append(node)
    flush()
    return blocks, nodes


HOT_HOSTS, SALTS = 200, 64


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _path(node: Node) -> int:
    return _hash("\x00".join(node.path))


TOKENS = "host string, path long, parent long, text long, n int, chars long, linked long, page long, article long"


def _article(blocks: list[tuple[Node, str, int]]) -> int:
    """What copies of an article have in common: the element with the most text in what may be the article, links aside."""
    size: dict[tuple, list] = {}
    for node, text, linked in _shown(blocks):
        found = size.setdefault(node.path, [0, []])
        found[0] += len(text) - min(linked, len(text))
        found[1].append(text)
    return _hash("\x00".join(max(size.values(), key=lambda x: x[0])[1])) if size else 0


def _tokens(pages: DataFrame) -> DataFrame:
    """Element tokens (text null, n times on the page) and text tokens (chars, linked) of all pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, page in zip(batch["page_id"].array, batch["url"].array, batch["html"].array):
                if not isinstance(page, str):
                    continue
                host, page_hash = host_of(url), _hash(f"{page_id}\x00{url}")
                blocks, nodes = parse(page)
                article = _article(blocks)
                counts: dict[int, int] = {}
                parents: dict[int, int] = {}
                for node in nodes:
                    p = _path(node)
                    counts[p] = counts.get(p, 0) + 1
                    if p not in parents:
                        parents[p] = _hash("\x00".join(node.path[:-1]))
                out += [(host, p, parents[p], None, n, 0, 0, page_hash, article) for p, n in counts.items()]
                texts: dict[tuple[int, int], list[int]] = {}
                for node, text, linked in blocks:
                    t = texts.setdefault((_path(node), _hash(text)), [0, 0])
                    t[0] += len(text)
                    t[1] += min(linked, len(text))
                out += [(host, p, 0, t, 1, chars, linked, page_hash, article) for (p, t), (chars, linked) in texts.items()]
            if out:
                columns = dict(zip((c.split()[0] for c in TOKENS.split(", ")), zip(*out)))
                yield pd.DataFrame(columns | {"text": pd.array(columns["text"], "Int64")})  # by way of floats hashes would be rounded

    return pages.select("page_id", "url", "html").mapInPandas(run, TOKENS)


def deduce(pages: DataFrame, least_pages: int = 2) -> DataFrame:
    """Templates: (host, slots), for every element on several pages its path, parent, class, and the text directly in it.

    chars, shared and linked are characters: all, those of repeated texts (see above), and those in links; texts are the
    repeated ones; single are texts in a class with elements whose pages hold one article, which count for the host's most
    frequent class alone. large and varied tell if the element's class is large and if its pages hold several articles.
    """
    tokens = _tokens(pages).groupBy("host", "path", "text").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("class"), F.count("*").alias("pages"), F.min("article").alias("lo"), F.max("article").alias("hi"),
        F.max("n").alias("most"), F.max("parent").alias("parent"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
    )
    # Tokens of one page, and elements that repeat on a page, are in no class; they go along with their path.
    alone = (F.col("pages") < least_pages) | (F.col("most") > 1)
    element, several = F.col("text").isNull() & (F.col("pages") >= least_pages), F.col("lo") < F.col("hi")
    paths = tokens.withColumn("class", F.when(alone, F.xxhash64("path")).otherwise(F.col("class"))).groupBy("host", "class", "path", alone.alias("alone")).agg(
        F.count("*").alias("tokens"), F.max(F.when(element, F.col("pages"))).alias("on"), F.max(F.when(element, F.col("parent"))).alias("parent"),
        F.max("pages").alias("pages"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.collect_list(F.when(~alone & F.col("text").isNotNull(), F.struct("text", "chars", several.alias("several")))).alias("texts"),
    )
    of = Window.partitionBy("host", "class", "alone")
    classes = paths.withColumns({
        "large": ~F.col("alone") & (F.sum("tokens").over(of) > 1) & (F.count("on").over(of) > 0), "varied": F.min("lo").over(of) < F.max("hi").over(of),
    })
    repeated = F.when(F.col("large") & F.col("varied"), F.col("texts")).otherwise(F.filter("texts", lambda t: t["several"]))
    single = F.when(F.col("large") & ~F.col("varied"), F.col("texts")).otherwise(F.filter("texts", lambda t: F.lit(False)))
    total = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + t["chars"])
    slots = classes.withColumns({"repeated": repeated, "single": single}).groupBy("host", "path").agg(
        F.max(F.when(F.col("on").isNotNull(), F.struct(F.col("on").alias("pages"), "parent", "class", "large", "varied"))).alias("own"),
        F.sum("chars").alias("chars"), F.sum(total(F.col("repeated"))).alias("shared"), F.sum("linked").alias("linked"),
        F.flatten(F.collect_list(F.transform("repeated", lambda t: t["text"]))).alias("texts"),
        F.flatten(F.collect_list(F.transform("single", lambda t: F.struct(t["text"].alias("text"), t["chars"].alias("chars"), F.col("pages").alias("pages"))))).alias("single"),
    )
    rows = slots.where("own IS NOT NULL").select("host", F.struct("path", "own.*", "chars", "shared", "linked", "texts", "single").alias("slot"))
    return rows.groupBy("host").agg(F.collect_list("slot").alias("slots"))


TEMPLATE = "elements array<long>, slots array<long>, repeated array<double>, linked array<double>, texts array<long>"


def _key(path: int, text: int) -> int:
    return (((path * 0x9E3779B97F4A7C15) ^ text) & (2**64 - 1)) - 2**63


def resolve(slots) -> tuple:
    """TEMPLATE of a host's slots: template elements; shares by slot, which goes by its template element; keys of the texts that go."""
    known = {s["path"]: s for s in slots}
    top = max((s["pages"] for s in slots if s["large"]), default=0)
    elements = {p for p, s in known.items() if s["large"] and (s["varied"] or s["pages"] == top)}
    sums, texts = {}, {}
    for p, s in known.items():
        at = p
        while at in known and at not in elements:
            at = known[at]["parent"]
        if not s["chars"] or at not in elements:
            continue
        single = [t for t in s["single"] if t["pages"] == top]
        total = sums.setdefault(at, [0, 0, 0])
        for k, n in enumerate((s["chars"], s["shared"] + sum(t["chars"] for t in single), s["linked"])):
            total[k] += n
        texts.setdefault(at, []).extend(_key(p, int(t)) for t in [*s["texts"], *(t["text"] for t in single)])
    repeated = [shared / chars for chars, shared, _ in sums.values()]
    gone = [t for at, share in zip(sums, repeated) if share > 0.5 for t in texts[at]]
    return list(elements), list(sums), repeated, [linked / chars for chars, _, linked in sums.values()], gone


class Template:
    """A resolved template, for lookups."""

    def __init__(self, elements=(), slots=(), repeated=(), linked=(), texts=()):
        self.elements, self.texts = set(elements), set(texts)
        self.shares = dict(zip(slots, zip(repeated, linked)))

    def slot(self, node: Node) -> tuple[float, float] | None:
        """(repeated, linked) of the slot that a node is in, if it is inside the template."""
        for n in range(len(node.path), 0, -1):
            p = _hash("\x00".join(node.path[:n]))
            if p in self.elements:
                return self.shares.get(p)
        return None


def _shown(blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks that tags and names leave: none of the site's, and of those in marked articles, if there are any."""
    shown = [b for b in blocks if not b[0].chrome]
    left = [b for b in shown if not b[0].hinted] or shown  # names may mislead, so they never take everything
    level = max((b[0].content for b in left), default=0)
    return [b for b in left if b[0].content == level]


def main_text(page: str, template: Template) -> str:
    """The article's blocks."""
    left = _shown(parse(page)[0])
    if not left:
        return ""
    # Inside the marked article only elements of their own, further in, can be part of the site.
    marked = left[0][0].content > 0
    outer = min(len(b[0].path) for b in left) if marked else 0
    kept, cache = [], {}
    for block in left:
        node = block[0]
        if node not in cache:
            cache[node] = (_path(node), template.slot(node) if len(node.path) > outer else None)
        p, slot = cache[node]
        if slot is None or not (slot[1] > (0.8 if marked else 0.5) or (slot[0] > 0.5 and _key(p, _hash(block[1])) in template.texts)):
            kept.append(block)
    return " ".join(b[1] for b in (kept or left))


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of pages (page_id, url, html): page_id, url, text and n_chars.

    A null or empty html gives an empty text. Pages with a null or malformed url share a nameless host; pages without
    page_id are extracted too. Repeated rows get equal texts and count as one article; an empty table gives no rows; other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    small_batches(pages.sparkSession)
    pages = named(pages.select("page_id", "url", "html"), "page_id")
    rows = pages.withColumn("host", host)
    # At most HOT_HOSTS hosts can hold so large a share of the pages; theirs are dealt to salts, and the templates copied.
    large = rows.groupBy("host").count().where(F.col("count") > max(pages.count() / HOT_HOSTS, 100)).select("host", F.lit(SALTS).alias("salts"))
    salted = rows.join(F.broadcast(large), "host", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("salts")), F.lit(0)).cast("int"))
    columns = [c.split()[0] for c in TEMPLATE.split(", ")]

    def resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(host, *resolve(slots)) for host, slots in zip(batch["host"].array, batch["slots"].array)], columns=["host", *columns])

    templates = deduce(pages).mapInPandas(resolved, f"host string, {TEMPLATE}").join(F.broadcast(large), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    joined = salted.join(templates.select("host", "salt", *columns), ["host", "salt"], "left").select("page_id", "nameless", "url", "html", *columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            host, template = None, Template([])
            for page, url, *found in zip(batch["html"].array, batch["url"].array, *(batch[c].array for c in columns)):
                if host_of(url) != host:
                    host, template = host_of(url), Template(*found) if found[0] is not None else Template()
                texts.append(main_text(page, template) if isinstance(page, str) else "")
            yield pd.DataFrame({"page_id": batch["page_id"].to_numpy(), "nameless": batch["nameless"].to_numpy(), "url": batch["url"].array, "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    return unnamed(joined.mapInPandas(run, "page_id long, nameless boolean, url string, text string, n_chars long"), "page_id")
