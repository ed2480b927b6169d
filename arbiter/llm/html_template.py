"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: element paths with the classes on them, and blocks of text at their paths. Over all pages
of a host, tokens with the same occurrence vector (how often each page has them) form an equivalence class.
A class that most of the host's pages have, of at least two tokens, is valid; a block of several words has
as many. Classes nest by the paths of their tokens, not by their order in the pages, and the nested valid
classes are the host's template. What lies between template tokens are slots; template blocks on three
pages at least are left out of them, unless they are most of a page's main text, as on pages that are
near copies of each other. The main text is what fills the slots of one element of the template, the content element:
``article`` or ``main`` if the template has one, else the deepest element that holds most of the text that isn't the template's.
Slots in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
aren't content. A page without its host's content element is read by the same rule on its own.

Occurrence vectors are never held: a class is known by sums of keyed hashes, which map tasks add up per
host first, so a host with a third of all pages costs each task one row per token. Null HTML counts as
empty and gives an empty text; a null URL, or one without a host, goes to the host ''. Repeated pages are
extracted each and count once in vectors. Very long pages are read whole. An empty table gives an empty
result; columns beyond id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded
from .url_filter import host_of

# Elements by their public definitions (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
NOT_CONTENT = frozenset("nav header footer aside form dialog menu button select option fieldset label head".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "title", "summary", "figcaption"}
# Words of classes, ids and roles of what isn't an article (fixed values).
SIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion promotions banner banners cookie cookies consent gdpr notice notices alert sidebar sidebars side rail widget widgets menu menus nav navbar navigation navi topnav breadcrumb breadcrumbs crumbs header masthead topbar footer foot colophon comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login search searchbox pagination pager popup modal overlay skip toc banner contentinfo complementary form".split()
)
# First words of layout names, which say what a page has and not what an element is.
LAYOUT = frozenset("has have no not non without with is hide hides show shows toggle js".split())
# Of those above, what may be longer than the article it belongs to.
TALK = frozenset("comment comments commentlist disqus reply replies respond related recommended".split())
# Elements that aren't content, but may be wrapped around a page.
WRAPS = frozenset(("form", "fieldset"))
ROOTS = frozenset(("html", "body", "article", "main"))
SEMANTIC = ("article", "main")

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?P<self>/?)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)


def _marks(attrs: str) -> tuple[str, int]:
    """Class and id words in order, and how far they say that the element isn't content.

    3: a name or role is a whole word of ``SIDE``. 2, 1: it is compounded with one, of ``TALK`` or not. 0: neither.
    """
    if not attrs.strip():
        return "", 0
    found = {a.lower(): x or y or z or "" for a, x, y, z in _ATTR.findall(attrs)}
    name = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    mark = 0
    for n in [*name, *found.get("role", "").lower().split()]:
        words = [w for w in re.split(r"[^a-z]+", n) if w]
        if len(words) == 1:
            mark = max(mark, 3 * (words[0] in SIDE))
        elif words and words[0] not in LAYOUT:
            mark = max(mark, 2 if TALK.intersection(words) else not SIDE.isdisjoint(words))
    return ".".join(re.sub(r"\d+", "#", n) for n in name), int(mark)


def _sides(up: list[int], tags: list[str], hard: list[bool], marks: list[int], size: list[int]) -> list[bool]:
    """Of each element, in page order, whether it lies in something that isn't content; 0 is the page.

    A mark is no proof: an element that holds the article, or most of the page's text, is content.
    """
    n = len(up)
    under = hard[:]
    for k in range(1, n):
        under[k] = hard[k] or under[up[k]]
    mass = [0 if u else m for u, m in zip(under, size, strict=True)]
    for k in range(n - 1, 0, -1):
        mass[up[k]] += mass[k]

    def spread() -> list[bool]:
        off = under[:]
        for k in range(1, n):
            off[k] = off[k] or off[up[k]] or marks[k] > 0
        return off

    marks = [0 if m == 1 and 2 * x > mass[0] else m for m, x in zip(marks, mass, strict=True)]
    off = spread()
    articles = [k for k in range(1, n) if tags[k] in SEMANTIC and mass[k] and not under[k]]
    if articles and all(off[k] for k in articles):
        k = max(articles, key=lambda k: (mass[k], -k))
        while k:
            marks[k], k = 0, up[k]
        return spread()
    if not articles and mass[0] and not any(m for m, o in zip(size, off, strict=True) if not o):
        marks = [0 if 2 * x > mass[0] else m for m, x in zip(marks, mass, strict=True)]
        return spread()
    return off


def read(page: str):
    """Yields ``("open", path, side)`` and ``("text", path, text, side, block)`` of a page, in order.

    ``path`` is a tuple of the open elements, each with its class and id words; ``side`` tells that it lies
    in something that isn't content; ``block`` counts block boundaries so far.
    """
    stack: list[tuple[str, int]] = []
    path: tuple[str, ...] = ()
    node, block, at, n = 0, 0, 0, len(page)
    events: list[tuple] = []
    up, tags, hard, marked, size = [0], [""], [False], [0], [0]

    def pop_to(depth: int) -> None:
        nonlocal path, node
        del stack[depth:]
        path = path[:depth]
        node = stack[-1][1] if stack else 0

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            events.append(("text", path, text, node, block))
            size[node] += len(text.strip())
        if not m:
            break
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if m["close"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag in BLOCKS:
                block += 1
            if depth is not None:
                pop_to(depth)
            continue
        if tag in BLOCKS:
            block += 1
            same = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}.get(tag)
            for k in range(len(stack) - 1, -1, -1):
                if tag in CLOSES_P and stack[k][0] == "p" or same and stack[k][0] in same:
                    pop_to(k)
                    break
                if stack[k][0] in BLOCKS - {"p"}:
                    break
        if tag in VOID:
            continue
        name, mark = _marks(m["attrs"] or "")
        token = f"{tag}.{name}" if name else tag
        up.append(node)
        tags.append(tag)
        hard.append(tag in NOT_CONTENT - WRAPS)
        marked.append(0 if tag in ROOTS else max(mark, int(tag in WRAPS)))
        size.append(0)
        new = len(up) - 1
        events.append(("open", (*path, token), new))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, new))
        path, node = (*path, token), new
    sides = _sides(up, tags, hard, marked, size)
    for e in events:
        yield (*e[:2], sides[e[2]]) if e[0] == "open" else (*e[:3], sides[e[3]], e[4])


def _key(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


# Tokens of text, at the end of their path: no other token has a line break. The mark tells a word from a block of several.
ONE, MANY = "\n1", "\n2"
LEAST_PAGES = 3


def _plain(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _text_key(text: str) -> int:
    return _key(text) - 2**63


def tokens_of(page: str) -> tuple[dict[tuple, int], dict[tuple, int]]:
    """How often each path opens and each block of text stands at its path, and how much content text is below each path or in each block."""
    opens: dict[tuple, int] = {}
    mass: dict[tuple, int] = {}
    blocks: dict[int, list[tuple[tuple, str]]] = {}
    for event in read(page):
        path = event[1]
        if event[0] == "open":
            opens[path] = opens.get(path, 0) + 1
        elif not event[3]:
            blocks.setdefault(event[4], []).append((path, event[2]))
    for parts in blocks.values():
        if not (text := _plain([t for _, t in parts])):
            continue
        # A block is where its parts all are.
        path = parts[0][0]
        for other, t in parts[1:]:
            if t.strip():
                path = path[: next((k for k, (x, y) in enumerate(zip(path, other, strict=False)) if x != y), min(len(path), len(other)))]
        token = (*path, f"{ONE if ' ' not in text else MANY}{_text_key(text)}")
        opens[token] = opens.get(token, 0) + 1
        for k in range(1, len(token) + 1):
            mass[token[:k]] = mass.get(token[:k], 0) + len(text)
    return opens, mass


_COUNTED = "host string, token string, low long, high long, pages long, total long, mass long"
_NAMES = ["host", "token", "low", "high", "pages", "total", "mass"]
_KINDS = (pa.string(), pa.string(), *[pa.int64()] * 5)


def _count(batches):
    """Each task's sums per host and token."""
    sums: dict[tuple[str, str], list[int]] = {}

    def flush():
        rows = [(h, t, *v) for (h, t), v in sums.items()]
        sums.clear()
        for at in range(0, len(rows), 20_000):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 20_000], strict=True), _KINDS, strict=True)], names=_NAMES)

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = page or ""
            whose = hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            opens, mass = tokens_of(page)
            opens[()] = 1
            for path, n in opens.items():
                h = _key(f"{whose} {n}")
                s = sums.setdefault((host, "/".join(path)), [0] * 5)
                s[0] += h & 0xFFFFFFFF
                s[1] += h >> 32
                s[2] += 1
                s[3] += n
                s[4] += mass.get(path, 0)
        if len(sums) > 200_000:
            yield from flush()
    yield from flush()


def template(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """Valid classes of every host: ``host, token, vector, pages, total, mass, class_size, host_pages``.

    ``vector`` identifies the class; ``token`` is an element path, whose prefixes nest it in others, or a block
    of text by its key. A page that a host has several times counts once.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).dropDuplicates(["host", "html"])
    sums = rows.mapInArrow(_count, _COUNTED).groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in _NAMES[2:]))
    # Most texts are a page's own and go before anything is dealt by host.
    sums = sums.where(~F.contains("token", F.lit("\n")) | (F.col("pages") >= LEAST_PAGES))
    of_host = W.partitionBy("host", "low", "high", "pages", "total")
    root = F.max(F.when(F.col("token") == "", F.col("pages"))).over(W.partitionBy("host"))
    sums = sums.withColumn("host_pages", root).withColumn("class_size", F.sum(F.when(F.contains("token", F.lit(MANY)), 2).otherwise(1)).over(of_host))
    valid = sums.where((F.col("token") != "") & (F.col("pages") >= support * F.col("host_pages")) & (F.col("class_size") >= 2))
    return valid.select("host", "token", F.xxhash64("low", "high", "pages", "total").alias("vector"), "pages", "total", "mass", "class_size", "host_pages")


def content_elements(classes: DataFrame) -> DataFrame:
    """``host, content``: of each host's template, the element whose slots are the main text.

    What counts is the text that the template itself doesn't have: its blocks are taken off every element they lie in.
    """
    is_text = F.contains("token", F.lit("\n"))
    parts = F.split("token", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    fixed = classes.where(is_text & (F.size(parts) > 1)).select("host", F.explode(above).alias("token"), "mass").groupBy("host", "token").agg(F.sum("mass").alias("fixed"))
    classes = classes.where(~is_text).join(fixed, ["host", "token"], "left").withColumn("mass", F.col("mass") - F.coalesce("fixed", F.lit(0)))
    tags = F.transform(F.split("token", "/"), lambda x: F.split(x, r"\.")[0])
    tag, depth = F.element_at(tags, -1), F.size(tags)
    of_host = W.partitionBy("host")
    # Articles go before main if they hold most of its text; those within another count with it.
    outer = F.size(F.filter(tags, lambda x: x == tag)) == 1
    text_of = lambda kind: F.coalesce(F.sum(F.when((tag == kind) & outer, F.col("mass"))).over(of_host), F.lit(0))
    classes = classes.withColumn("most", F.max("mass").over(of_host)).withColumn("articles", 2 * text_of("article") > text_of("main"))
    rank = F.when(tag == "article", F.when(F.col("articles"), 2).otherwise(0)).when(tag == "main", 1).otherwise(0)
    # An element without text of its pages isn't content; without article or main, the deepest that holds most of it.
    fit = classes.where((F.col("mass") > 0) & ((rank > 0) | ((F.col("mass") > 0.5 * F.col("most")) & (F.col("total") == F.col("pages")))))
    key = F.struct(rank.alias("rank"), F.when(rank > 0, F.col("mass")).otherwise(depth).alias("by"), F.when(rank > 0, -depth).otherwise(F.col("mass")).alias("then"), F.col("token"))
    return fit.groupBy("host").agg(F.max(key)["token"].alias("content"))


def template_texts(classes: DataFrame) -> DataFrame:
    """``host, texts``: keys of the blocks of each host's template."""
    key = F.substring(F.element_at(F.split("token", "\n"), -1), 2, 20).cast("long")
    return classes.where(F.contains("token", F.lit("\n"))).groupBy("host").agg(F.collect_set(key).alias("texts"))


def slots(page: str, content: str | None, texts: frozenset[int] = frozenset()) -> list[str]:
    """The texts that fill the content element's slots, a string per block, in page order; ``texts`` are the template's."""
    want = tuple(content.split("/")) if content else None
    found: list[tuple[tuple, str, int]] = []
    seen: set[tuple] = set()
    mass: dict[tuple, int] = {}
    for event in read(page):
        path = event[1]
        if event[0] == "open":
            if not event[2]:
                seen.add(path)
        elif not event[3]:
            found.append((path, event[2], event[4]))
    if want not in seen:
        want = None
    tag = lambda p: p[-1].split(".")[0]
    # Elements of the template's kind, wherever they stand: pages may have several.
    kind = tag(want) if want else None
    if not want:
        held = {k: sum(len(text.strip()) for path, text, _ in found if any(x.split(".")[0] == k for x in path)) for k in SEMANTIC}
        kind = "article" if 2 * held["article"] > held["main"] else "main" if held["main"] else None
    if kind in SEMANTIC:
        inside = lambda p: any(x.split(".")[0] == kind for x in p)
    elif want:
        inside = lambda p: p[: len(want)] == want
    else:
        for path, text, _ in found:
            for k in range(1, len(path) + 1):
                mass[path[:k]] = mass.get(path[:k], 0) + len(text.strip())
        best = max(mass.values(), default=0)
        deepest = max((p for p, m in mass.items() if 2 * m > best and tag(p) in BLOCKS - {"p", "li", "td", "br"}), key=len, default=())
        inside = lambda p: p[: len(deepest)] == deepest
    blocks: dict[int, list[str]] = {}
    for path, text, block in found:
        if inside(path):
            blocks.setdefault(block, []).append(text)
    every = [t for t in map(_plain, blocks.values()) if t]
    own = [t for t in every if _text_key(t) not in texts] if texts else every
    return own if 2 * sum(map(len, own)) >= sum(map(len, every)) else every


def page_slots(pages: DataFrame) -> DataFrame:
    """``page_id, url, blocks``: of every page, the blocks of its main text."""
    work = Workspace(pages.sparkSession, "html_template")
    classes = work.save(template(pages))
    chosen = work.save(content_elements(classes).join(template_texts(classes), "host", "full"))
    most = chosen.agg(F.max(F.coalesce(F.size("texts"), F.lit(0)))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(bounded(chosen, 400 + 8 * max(most, 0)), "host", "left").select("page_id", "url", "html", "content", "texts")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cells = zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
                texts = [slots(p or "", c, frozenset(t or ())) for p, c, t in cells]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.list_(pa.string()))], names=["page_id", "url", "blocks"])

    return rows.mapInArrow(run, "page_id long, url string, blocks array<string>")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    text = F.array_join("blocks", " ")
    return page_slots(pages).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
