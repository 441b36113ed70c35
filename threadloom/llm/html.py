"""HTML extraction: the main text of pages, with site templates removed by counting element subtrees.

Pages are parsed to element trees. Elements that never hold article text (scripts, menus, headers and footers of
the page, sidebars, forms, and boxes whose class, id or role names an advert, notice, comment or share list) go by
name; inside the article only blocks whose class marks adverts, share lists or reader comments do. Templates go by
count, inside the article too: every block that holds text is hashed (tags, attributes' names and text), and those on
more than ``MIN_PAGES`` different pages of a host are deleted, however large the host; copies of a page are one page.
Inside the article a count alone decides nothing, since authors repeat themselves: only boxes go, that is containers
with a class, id or role of their own and containers of links alone. Headings, paragraphs, list items and bare containers of prose
stay, on however many pages they stand.
If a page has an ``article`` or ``main`` element, its text is the main text; else the body's.

Pages and subtrees are made distinct by both and counts combine before their shuffle, so neither a host with a third
of all pages nor a subtree on all of them is many rows in a task. The recurring keys are few next to the pages; up to
``BROADCAST_KEYS`` of them go to all workers, beyond that they are joined to the pages' own subtree keys and gathered
per page (bounded by the page).

Text: character references decoded, white space inside a block one space, trimmed, blocks in page order joined by
a line feed, nothing dropped or capped. Null html is empty and gives an empty text; unclosed and stray tags are
repaired as browsers do for paragraphs, list items and table cells. Rows may repeat and ids may be null; columns not in
``keep`` don't matter, and none of those may be called ``text``. Parsing takes time in proportion to the page,
whatever is in it: open elements are found by name, and no part of a tag is read twice.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

MIN_PAGES = 5
BROADCAST_KEYS = 2_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe nav aside footer form button select textarea svg canvas object embed dialog menu input label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img picture".split())
#: An opening tag of the key closes the open elements named, up to the nearest of the second group.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of a class, id or role that name a box beside the article.
BESIDE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"sidebars?|side-?bar|aside|widgets?|related|recommend\w*|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|comment\w*|disqus\w*|repl(?:y|ies)|respond|"
    r"share|sharing|social|footer|site-?header|masthead|complementary|contentinfo|search|login)(?:$|[^a-z])"
)
#: Elements of ``DROPPED`` whose text stays inside an article.
KEPT_INSIDE = frozenset("label button textarea fieldset dialog".split())
#: Inside an article these containers can be templates, if they have a name or hold links alone.
CONTAINERS = frozenset("div section ul ol dl figure table center".split())
#: Inside an article boxes go only if they are one of these elements with such a class, whole.
BOXES = frozenset("div section ul ol dl p figure table center".split())
BOX_CLASS = re.compile(
    r"(?:ads?|adsense|adsbygoogle|advert|advertisement|advertising|ad-?(?:box|banner|slot|unit|container|wrapper|label)|sponsored(?:-?content)?|"
    r"share|sharing|sharedaddy|addtoany|(?:share|social|sharing)-?(?:bar|box|buttons?|icons?|links?|list|tools|media)|"
    r"comments|comment-?(?:list|section|thread|respond|form)|comments-?(?:area|list|section|thread)|disqus(?:[-_]?thread)?)"
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>=]++|=)*+)>|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "kids", "classes")

    def __init__(self, tag: str, names: str = "", classes: str = ""):
        self.tag, self.names, self.kids, self.classes = tag, names, [], classes


#: Elements that an end tag of an inline element, paragraph or list item doesn't reach beyond.
BARRIERS = ("article", "main", "body", "table")
_RAW_ENDS = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW}


class _Open:
    """The open elements, with the places of each name and of blocks among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element with one of these names; 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        """Closes the element at a place and all within it."""
        for node in self.nodes[place:]:
            self.places[node.tag].pop()
        del self.nodes[place:]
        while self.blocks[-1] >= place:
            self.blocks.pop()


def parse(source: str) -> Node:
    """The element tree; children are nodes and (still encoded) strings."""
    root = Node("#root")
    opened = _Open(root)
    at, n = 0, len(source)
    find = TOKEN.search
    while at < n:
        m = find(source, at)
        kids = opened.nodes[-1].kids
        if m is None:
            kids.append(source[at:])
            break
        if m.start() > at:
            kids.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<":
                kids.append("&lt;")
            elif m[0].startswith("<![CDATA["):
                kids.append(entities.escape(m[0][9:].removesuffix("]]>"), False))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                kids.append(Node("br"))
                continue
            place = opened.last(tag)
            if place and not ((tag in INLINE or tag in ("p", "li")) and opened.last(*BARRIERS) > place):
                opened.close(place)
            continue
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            place = opened.last(*closed)
            if place > opened.last(*within):
                opened.close(place)
        if tag in ENDS_P and opened.nodes[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        names = classes = ""
        if m[3] and ("class" in m[3] or "id" in m[3] or "role" in m[3] or "hidden" in m[3]):
            given = ATTRIBUTE.findall(m[3])
            names = " ".join((b or c or d).lower() if a.lower() in ("class", "id", "role") else "#hidden" if a.lower() == "hidden" else "" for a, b, c, d in given)
            classes = next(((b or c or d).lower() for a, b, c, d in given if a.lower() == "class"), "")
        node = Node(tag, names.strip(), classes)
        opened.nodes[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            end = _RAW_ENDS[tag].search(source, at)
            node.kids.append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        opened.push(node)
    return root


def article_tags(root: Node) -> tuple[str, ...]:
    """The elements that are the article: ``main`` only on pages without ``article``, else it holds what lies beside one."""
    return ("article",) if any(True for _ in _find(root, ("article",))) else ("article", "main")


def beside(node: Node, inside: bool, in_article: bool) -> bool:
    """Whether an element goes by its name: inside the article only clear boxes do. ``inside``: in article or main."""
    if in_article and node.tag in KEPT_INSIDE:
        return "#hidden" in node.names
    if node.tag in DROPPED or (node.tag == "header" and not inside):
        return True
    if node.tag in ("article", "main", "body", "html") or not node.names:
        return False
    if in_article:
        return "#hidden" in node.names or (node.tag in BOXES and any(BOX_CLASS.fullmatch(c) for c in node.classes.split()))
    return "#hidden" in node.names or BESIDE.search(node.names) is not None


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(host: str, digest: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(host.encode(), digest & (2**64 - 1))


def subtrees(root: Node, host: str) -> dict[int, int]:
    """Key by ``id`` of each text-holding element that can go as a template and isn't gone by name.

    Outside the article these are blocks, and inline elements whose parent is a block without text of its own: an inline
    element within a sentence is part of it however often it recurs. Inside it they are ``CONTAINERS`` that are boxes: with a
    class, id or role, or with all their text in links. An article and what holds one never go.
    """
    import xxhash

    found: dict[int, int] = {}
    digests: dict[int, int] = {}
    # bottom-up without recursion: html can nest deeper than Python's stack
    own = article_tags(root)
    order, stack = [], [(root, False, False, False)]
    while stack:
        node, inside, in_article, alone = stack.pop()
        if node.tag != "#root" and beside(node, inside, in_article):
            continue
        inside = inside or node.tag in ("article", "main")
        in_article = in_article or node.tag in own
        order.append((node, node.tag not in INLINE or (alone and not inside), in_article))
        bare = node.tag not in INLINE and not any(isinstance(k, str) and k.strip() for k in node.kids)
        stack.extend((k, inside, in_article, bare) for k in node.kids if isinstance(k, Node))
    holds: set[int] = set()  # articles and their ancestors
    prose: set[int] = set()  # elements with text that isn't in a link
    for node, apart, in_article in reversed(order):
        if node.tag in ("article", "main") or any(id(k) in holds for k in node.kids):
            holds.add(id(node))
            continue
        parts, text = [node.tag, node.names], False
        for k in node.kids:
            if isinstance(k, str):
                plain = WHITE.sub(" ", k).strip()
                if plain:
                    parts.append(plain)
                    text = True
                    prose.add(id(node))
            elif id(k) in digests:
                parts.append(str(digests[id(k)]))
                text = True
                if id(k) in prose and k.tag != "a":
                    prose.add(id(node))
        if text and node.tag not in ("#root", "html", "body"):
            digests[id(node)] = digest = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
            if apart and (not in_article or (node.tag in CONTAINERS and (node.names or id(node) not in prose))):
                found[id(node)] = _key(host, digest)
    return found


def main_text(root: Node, keys: dict[int, int], recurring) -> str:
    """Blocks of the article (or body) in order, without what goes by name and what recurs."""
    has_article = any(True for _ in _find(root, ("article", "main")))
    blocks: list[str] = []
    run: list[str] = []

    def close():
        text = WHITE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    # entries: (node, inside an article or main, inside the article) to open, or None to close a block
    own = article_tags(root)
    stack: list = [(root, False, False)]
    while stack:
        item = stack.pop()
        if item is None:
            close()
            continue
        node, inside, in_article = item
        if isinstance(node, str):
            if inside or not has_article:
                run.append(node)
            continue
        if node.tag != "#root" and beside(node, inside, in_article):
            if node.tag not in INLINE:
                close()
            continue
        if id(node) in keys and keys[id(node)] in recurring:
            if node.tag not in INLINE:
                close()
            continue
        if node.tag == "br":
            run.append(" ")
            continue
        inside = inside or node.tag in ("article", "main")
        in_article = in_article or node.tag in own
        block = node.tag not in INLINE and node.tag not in ("label", "button")
        if block:
            close()
            stack.append(None)
        stack.extend((k, inside, in_article) for k in reversed(node.kids))
    close()
    return "\n".join(blocks)


def _find(root: Node, tags: tuple[str, ...]):
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in tags:
            yield node
        stack.extend(k for k in node.kids if isinstance(k, Node))


def template_keys(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(key, page), one row per page and distinct subtree. Keys include the host. Pages are told apart by their main
    text, so copies of a page count once, whatever their address and the templates around them."""
    import xxhash

    def run(rows):
        for place, source in rows:
            root = parse(source or "")
            keys = set(subtrees(root, host_of(place)).values())
            page = xxhash.xxh64_intdigest(main_text(root, {}, ()).encode("utf-8", "surrogatepass")) if keys else 0
            for key in keys:
                yield int(np.uint64(key).view(np.int64)), int(np.uint64(page).view(np.int64))

    return map_rows(pages.select(url, html), run, "key bigint, page bigint")


def recurring_keys(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(key): the subtrees that recur on a host."""
    counts = template_keys(pages, url, html).distinct().groupBy("key").count()
    return counts.where(F.col("count") > min_pages).select("key")


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The ``keep`` columns and ``text``, one row per page."""
    spark = pages.sparkSession
    keys = cut(recurring_keys(pages, url, html))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keep) + "text string"
    kept = [F.col(f"`{k}`") for k in keep]
    if keys.count() <= broadcast_keys:
        # at most broadcast_keys numbers, sorted: 8 bytes each in a worker
        shared = spark.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy().view(np.uint64)))

        def run(rows):
            known = shared.value
            for *names, place, source in rows:
                root = parse(source or "")
                own = subtrees(root, host_of(place)) if len(known) else {}
                wanted = np.fromiter(own.values(), np.uint64, len(own))
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                yield (*names, main_text(root, own, set(wanted[known[at] == wanted].tolist()) if len(own) else ()))

        return map_rows(pages.select(*kept, F.col(url).alias("_u"), F.col(html).alias("_h")), run, schema)

    page = F.xxhash64(F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit("")))

    def pairs(rows):
        for uid, place, source in rows:
            for key in set(subtrees(parse(source or ""), host_of(place)).values()):
                yield uid, int(np.uint64(key).view(np.int64))

    own = map_rows(pages.select(page.alias("uid"), url, html), pairs, "uid bigint, key bigint")
    hits = own.join(keys, "key", "left_semi").groupBy("uid").agg(F.collect_set("key").alias("_k"))
    joined = pages.select(*kept, F.col(url).alias("_u"), F.col(html).alias("_h"), page.alias("_p")).join(hits, F.col("_p") == F.col("uid"), "left")

    def run_joined(rows):
        for *names, place, source, found in rows:
            root = parse(source or "")
            recurring = {k & (2**64 - 1) for k in found or ()}
            yield (*names, main_text(root, subtrees(root, host_of(place)) if recurring else {}, recurring))

    return map_rows(joined.select(*kept, "_u", "_h", "_k"), run_joined, schema)


def op8_html(spark, sf_dir: str) -> DataFrame:
    from .common import tables

    out = extract(tables(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
