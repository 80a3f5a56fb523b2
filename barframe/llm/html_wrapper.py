"""HTML extraction by wrapper induction.

All distinct pages of a host are parsed. A page is a list of blocks with text of their own, each with the
path of signatures (tag, class and id, digits aside) to it; blocks of one path are aligned, like
siblings one by one. What is counted is the number of pages with a block, for every layout (pages of the
same tree of structural nodes) and for the whole host. A block that more than SHARED of the pages have
word for word, and LEAST at least if it is not of links alone, is template; all other blocks are slots.
Counts add up in partial aggregations, so no page is left out and no task holds a host.

Every page is then read through its host's wrapper. A block stays unless it is template, stands in a
part that its tag or a word of its class marks as navigation, advert, footer, sidebar, form or
comments (NOT_CONTENT), or holds only links and lies outside the content region. The region of a
layout is the deepest container around all its slots with text that is no link; no share of the
text decides. A class word that may also name an article part (MAYBE_CONTENT) gives way where the
texts of the part differ from page to page. A host with one distinct page has no slots: there both
kinds of words count.

Where template blocks would take more than COPIES of a layout's text, its pages are near copies of
one article: nothing of it is template.

Wrappers are one row per host; pages meet them in a join whose side Spark broadcasts only when
its file is small, otherwise it splits the hot hosts.

Defined cases: a null or empty page gives an empty text; a null url is a host of its own; repeated
pages count once in the induction and give repeated results; unclosed and stray tags follow the
nesting rules of HTML; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.session import written

SHARED = 0.5  # of the pages that have a template block
LEAST = 3  # pages with a template block; two of links alone
COPIES = 0.8  # of the text; with more of it in common, pages are copies of an article
DEPTH = 64  # steps of a path that a region is told by

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
SKIP = RAW | set("head nav footer aside form button select template svg math canvas object audio video dialog menu search".split())
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote", "html"}
PHRASING_OPEN = BLOCK - {"br", "option"}
# An opening tag ends the innermost open one of these, up to the given limits.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead"}, {"table"}),
}
# Words in class, id or role that name parts other than the article.
NOT_CONTENT = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation breadcrumb breadcrumbs sidebar "
    "aside footer masthead comment comments comment-list disqus reply replies pagination pager skip-link site-header "
    "page-header complementary contentinfo".split()
)
# Words that name such parts unless their text differs from page to page.
MAYBE_CONTENT = set(
    "banner promo promotion menu cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended respond widget toolbar search topbar header".split()
)
STRUCTURE = {"body", "main", "article", "section", "div", "aside", "header", "footer", "nav", "form"}
ATTRIBUTES = re.compile(r"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "sig", "other", "children", "parent")

    def __init__(self, tag: str, sig: str = "", other: int = 0, parent: Node | None = None):
        self.tag, self.sig, self.other, self.parent = tag, sig or tag, other, parent
        self.children: list[Node | str] = []


def _signature(tag: str, attributes: str) -> tuple[str, int]:
    """Tag with class and id, digits aside; whether this names a part other than the article: 2, or
    1 for a word that may also name a part of it."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, 0
    sig, other = tag, 0
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("hidden", "aria-hidden"):
            other = 2 if name == "hidden" or value == "true" else other
            continue
        words = value.split()
        parts = {p for w in words for p in (w, *re.split(r"[-_]", w))}
        # On the article's own containers a word such as "has-sidebar" says nothing.
        if tag not in ("article", "main", "body", "html"):
            other = max(other, 2 * (not NOT_CONTENT.isdisjoint(parts)), not MAYBE_CONTENT.isdisjoint(parts))
        if name != "role":
            sig += ("." if name == "class" else "#") + DIGITS.sub("0", " ".join(sorted(words)))
    return sig, other


def parse(text: str) -> Node:
    root = Node("#root")
    at, n, node = 0, len(text), root
    lower = None
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            node.children.append(text[at:lt])
        if lt >= n:
            break
        nxt = text[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            if text.startswith("<!--", lt):
                end = text.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = text.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name = TAG_NAME.match(text, lt + 1 + closing)
        if not name:
            if closing:
                end = text.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                node.children.append("<")
                at = lt + 1
            continue
        tag = name[0].lower()
        rest = ATTRIBUTES.match(text, name.end())
        end = rest.end() if rest else text.find(">", name.end()) + 1 or n
        attributes = text[name.end():end - 1]
        at = end
        if closing:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in PHRASING_OPEN:  # a block ends an open paragraph
            up = node
            while up is not root and up.tag != "p" and (up.tag not in PHRASING_OPEN):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in ENDS:
            ends, limits = ENDS[tag]
            up = node
            while up is not root and up.tag not in limits:
                if up.tag in ends:
                    node = up.parent
                    if tag != "tr":
                        break
                up = up.parent
        sig, other = _signature(tag, attributes)
        made = Node(tag, sig, other, node)
        node.children.append(made)
        if tag in RAW:
            lower = text.lower() if lower is None else lower
            stop = lower.find(f"</{tag}", at) if len(lower) == n else text.find(f"</{tag}", at)
            if stop < 0:
                at = n
            else:
                close = text.find(">", stop)
                at = n if close < 0 else close + 1
        elif tag not in VOID and not attributes.endswith("/") or tag in CONTAINERS:
            node = made
    return root


def kids(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


def boilerplate(node: Node) -> int:
    """2 for a part other than the article, 1 where only a doubtful word says so, else 0."""
    if node.tag == "header":
        up = node.parent
        while up is not None:
            if up.tag in ("article", "main"):
                return node.other
            up = up.parent
        return 2
    return 2 if node.tag in SKIP else node.other


def squeezed(text: str) -> str:
    return " ".join(entities.unescape(text).split())


class Folded:
    """A node whose like neighbours are folded into one; `size` counts nodes, text is all own text."""

    __slots__ = ("sig", "tag", "skip", "text", "link", "children", "size")

    def __init__(self, nodes: list[Node], linked: bool = False):
        first = nodes[0]
        self.sig, self.tag, self.skip = first.sig, first.tag, bool(boilerplate(first))
        linked = linked or first.tag == "a"
        self.text = " ".join(filter(None, (squeezed(c) for n in nodes for c in n.children if isinstance(c, str))))
        self.link = linked
        runs: list[list[Node]] = []
        for n in nodes:
            for k in kids(n):
                if k.tag in RAW or k.tag in VOID:
                    continue
                same = [r for r in runs if r[0].sig == k.sig] if len(nodes) > 1 else runs[-1:]
                if same and same[-1][0].sig == k.sig:
                    same[-1].append(k)
                else:
                    runs.append([k])
        self.children = [Folded(r, linked) for r in runs]
        self.size = 1 + sum(c.size for c in self.children)


def matched(a: Folded, b: Folded, memo: dict) -> int:
    """The size of the largest simple tree matching of a and b."""
    if a.sig != b.sig:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        row = [0] * (len(b.children) + 1)
        for x in a.children:
            new = [0]
            for j, y in enumerate(b.children):
                new.append(max(new[j], row[j + 1], row[j] + matched(x, y, memo)))
            row = new
        memo[key] = row[-1] + 1
    return memo[key]


@dataclass(slots=True)
class Line:
    path: int  # key of `names`
    names: tuple[str, ...]  # signatures from the root to the block, the first DEPTH of them
    text: str
    link: bool  # all of the block's own text
    doubtful: bool  # in a part that a doubtful word names
    block: int  # number of the block in the page
    key: int = 0  # of the block's own text
    size: int = 0


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_sig_key = lru_cache(65_536)(_key)


def _below(path: int, sig: str) -> int:
    return (((path * 0x9E3779B97F4A7C15) ^ _sig_key(sig)) + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def read(top: Node, alone: bool) -> tuple[list[Line], int]:
    """The lines of a page outside the parts that are surely not the article, and the key of its
    layout. With `alone` doubtful words count as sure ones."""
    out: list[Line] = []
    held: list[tuple[str, bool]] = []
    layout: set[int] = set()

    def flush(path: int, names: tuple[str, ...], number: int, doubtful: bool) -> None:
        if held:
            text = squeezed("".join(t for t, _ in held))
            if text:
                link = all(linked for t, linked in held if t.strip())
                out.append(Line(path, names, text, link, doubtful, number))
            held.clear()

    # A stack of its own, as pages may nest deeper than Python calls. An entry: children, whether this
    # is a block, path and names, those of the nearest block, whether in a link, in a doubtful part.
    stack: list = [(iter(top.children), False, 0, (), (0, (), 0), False, False)]
    made = 0
    while stack:
        children, block, path, names, of, link, doubtful = stack[-1]
        for c in children:
            if isinstance(c, str):
                held.append((c, link))
                continue
            inner = c.tag in BLOCK
            named = boilerplate(c)
            key = _below(path, c.sig) if c.tag not in VOID else path
            if c.tag in STRUCTURE:
                layout.add(key)
            if named > 1 or named and alone:
                if inner:
                    flush(*of, doubtful)
                continue
            if inner:
                flush(*of, doubtful)
            void = c.tag in VOID
            below = (*names, c.sig) if len(names) < DEPTH and not void else names
            made += 1
            stack.append((
                iter(c.children), inner, key, below, (key, below, made) if inner and not void else of,
                link or c.tag == "a", doubtful or bool(inner and named),
            ))
            break
        else:
            stack.pop()
            if block or not stack:
                flush(*of, doubtful)
    own: dict[int, list[Line]] = defaultdict(list)
    for x in out:
        own[x.block].append(x)
    for members in own.values():
        key, link = _key("\n".join(x.text for x in members)), all(x.link for x in members)
        size = sum(len(x.text) for x in members)
        for x in members:
            x.key, x.link, x.size = key, link, size
    return out, _key(",".join(map(str, sorted(layout)))) or 1


def blocks(nodes: list[Node], drop: list[tuple[int, int]]) -> list[str]:
    """The lines of nodes without those of the given paths and texts."""
    return [x.text for n in nodes for x in read(n, True)[0] if not drop or (x.path, x.key) not in drop]


def region(first: tuple[str, ...], last: tuple[str, ...]) -> list[str]:
    """The deepest container around all paths between the least and the greatest one."""
    out = []
    for a, b in zip(first, last, strict=False):
        if a != b:
            break
        out.append(a)
    while out and re.split(r"[.#]", out[-1])[0] not in CONTAINERS:
        out.pop()
    return out


def within(names: tuple[str, ...], regions: list[list[str]]) -> bool:
    return not regions or any(list(names[:len(r)]) == r for r in regions)


def induce(pages: list[str]) -> dict | None:
    """The wrapper of pages of one host; None for a single page. wrappers() makes the same of tables."""
    parsed = [read(parse(p), False) for p in sorted(set(pages))]
    if len(parsed) < 2:
        return None
    levels: dict[int, list[list[Line]]] = defaultdict(list)
    for lines, layout in parsed:
        levels[layout].append(lines)
        levels[0].append(lines)
    drop: set[tuple[int, int]] = set()
    regions: dict[int, list[str]] = {}
    for level, members in levels.items():
        if len(members) < 2:
            continue
        each = [{(x.path, x.key): x for x in lines} for lines in members]
        found = Counter(k for lines in each for k in lines)
        one = {k: x for lines in each for k, x in lines.items()}
        same = {k for k, n in found.items() if n > SHARED * len(members) and n >= (2 if one[k].link else LEAST)}
        plain = lambda keys: sum(found[k] * one[k].size for k in keys if not one[k].link)
        if plain(same) > COPIES * plain(one):
            same = set()
        drop |= same
        slots = [one[k].names for k in one if k not in same and not one[k].link and not one[k].doubtful]
        if slots:
            regions[level] = region(min(slots), max(slots))
    doubtful = defaultdict(list)
    for lines in levels[0]:
        for path, key in {(x.path, x.key) for x in lines if x.doubtful and not x.link}:
            doubtful[path].append(key)
    return {
        "path": regions.get(0, []), "regions": _inner(list(regions.items())), "drop": [list(k) for k in sorted(drop)],
        "keep": sorted(p for p, keys in doubtful.items() if len(set(keys)) > SHARED * len(keys)),
    }


def _inner(regions: list[tuple[int, list[str]]]) -> list[list[str]]:
    """Those of the layouts, or that of the host (level 0) if no layout has one."""
    return [list(r) for r in sorted({tuple(r) for level, r in regions if level} or {tuple(r) for _, r in regions})]


def extract(page: str | None, wrapper: dict | None) -> str:
    if not page:
        return ""
    root = parse(page)
    if wrapper is None:
        lines, _ = read(root, True)
        slots = [x.names for x in lines if not x.link]
        regions = [region(min(slots), max(slots))] if slots else []
        return "\n".join(x.text for x in lines if not x.link or within(x.names, regions))
    drop, keep = wrapper["drop"], wrapper["keep"]
    drop = drop if isinstance(drop, set) else {tuple(k) for k in drop}
    regions = wrapper["regions"]
    return "\n".join(
        x.text for x in read(root, False)[0]
        if (not x.doubtful or x.path in keep and not x.link) and (not x.link or within(x.names, regions))
        and (x.path, x.key) not in drop
    )


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


LINES = "array<struct<path:bigint,text:bigint,size:int,link:boolean,doubtful:boolean>>"
PAGE_LINES = f"host string, page binary, layout bigint, size bigint, lines {LINES}, paths array<struct<path:bigint,names:string>>"
STEP = "\x01"  # sorts before all characters of a signature


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per row of pages that has html: its distinct lines as keys, and the names of their paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for at, text in zip(b["host"], b["html"], strict=True):
                lines, layout = read(parse(text), False)
                one = {(x.path, x.key): x for x in lines}
                size = sum(x.size for x in one.values() if not x.link)
                rows = [{"path": p, "text": t, "size": x.size, "link": x.link, "doubtful": x.doubtful} for (p, t), x in one.items()]
                paths = {x.path: STEP.join(n.replace(STEP, " ") for n in x.names) for x in one.values()}
                page = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
                out.append((at, page, layout, size, rows, [{"path": p, "names": n} for p, n in paths.items()]))
            yield pd.DataFrame(out, columns=["host", "page", "layout", "size", "lines", "paths"])

    given = pages.filter(F.length("html") > 0).select(host(F.col("url")).alias("host"), "html")
    return given.mapInPandas(run, PAGE_LINES)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of the hosts with at least two distinct pages. Level 0 is the host,
    the others are its layouts."""
    distinct = written(page_lines(pages).dropDuplicates(["host", "page"]), "page-lines")
    levels = distinct.withColumn("level", F.explode(F.array("layout", F.lit(0).cast("long"))))
    sizes = levels.groupBy("host", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1")
    sizes = written(sizes, "page-levels")
    each = levels.select("host", "level", F.explode("lines").alias("l")).select("host", "level", "l.path", "l.text", F.col("l.size").alias("chars"), "l.link", "l.doubtful")
    by_line = each.groupBy("host", "level", "path", "text").agg(
        F.count(F.lit(1)).alias("found"), F.max("chars").alias("chars"), F.max("link").alias("link"), F.max("doubtful").alias("doubtful")
    )
    by_line = written(by_line, "page-line-counts")
    level, plain = ["host", "level"], F.when(F.col("link"), 0).otherwise(F.col("found") * F.col("chars"))
    same = by_line.filter("found > 1").join(sizes, level).filter(F.col("found") > SHARED * F.col("n")).filter(F.col("link") | (F.col("found") >= LEAST))
    same = written(same.select(*level, "path", "text", "found", "link", plain.alias("plain"), "size"), "page-same")
    copies = same.groupBy(*level).agg(F.sum("plain").alias("plain"), F.max("size").alias("size")).filter(F.col("plain") > COPIES * F.col("size"))
    same = written(same.join(copies.select(*level), level, "left_anti"), "page-template")
    # A path has slots where it has more lines than template ones.
    taken = same.filter("not link").groupBy(*level, "path").agg(F.sum("found").alias("taken"))
    paths = by_line.filter("not link and not doubtful").groupBy(*level, "path").agg(F.sum("found").alias("found"))
    slots = paths.join(taken, [*level, "path"], "left").filter("found > coalesce(taken, 0)").select(*level, "path")
    names = distinct.select("host", F.explode("paths").alias("p")).groupBy("host", "p.path").agg(F.first("p.names").alias("names"))
    ends = slots.join(sizes.select(*level), level, "left_semi").join(names, ["host", "path"]).groupBy(*level).agg(F.min("names").alias("a"), F.max("names").alias("b"))
    ends = ends.groupBy("host").agg(F.collect_list(F.struct("level", "a", "b")).alias("ends"))
    texts = by_line.filter("level = 0 and doubtful and not link").groupBy("host", "path").agg(F.count(F.lit(1)).alias("texts"), F.sum("found").alias("found"))
    keep = texts.filter(F.col("texts") > SHARED * F.col("found")).groupBy("host").agg(F.collect_list("path").alias("keep"))
    drop = same.groupBy("host").agg(F.collect_set(F.struct("path", "text")).alias("drop"))
    hosts = sizes.filter("level = 0").select("host")

    @F.pandas_udf("string")
    def made(ends: pd.Series, drop: pd.Series, keep: pd.Series) -> pd.Series:
        out = []
        for e, d, k in zip(ends, drop, keep, strict=True):
            found = [(x["level"], region(x["a"].split(STEP), x["b"].split(STEP))) for x in ([] if e is None else e)]
            out.append(json.dumps({
                "path": dict(found).get(0, []), "regions": _inner(found), "drop": sorted([int(x["path"]), int(x["text"])] for x in ([] if d is None else d)),
                "keep": sorted(map(int, [] if k is None else k)),
            }))
        return pd.Series(out, dtype=object)

    rows = hosts.join(ends, "host", "left").join(drop, "host", "left").join(keep, "host", "left")
    return rows.select("host", made("ends", "drop", "keep").alias("wrapper"))


def main_text(page: Column, wrapper: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str | None, dict | None] = {}
        for html, by in batches:
            out = []
            for h, w in zip(html, by, strict=True):
                if w not in known:
                    known.clear() if len(known) > 1000 else None
                    made = json.loads(w) if isinstance(w, str) else None
                    known[w] = made and made | {"drop": {tuple(k) for k in made["drop"]}, "keep": set(made["keep"])}
                out.append(extract(h, known[w]))
            yield pd.Series(out, index=html.index, dtype=object)

    return run(page, wrapper)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    by_host = written(wrappers(pages), "wrappers").withColumnRenamed("host", "_host")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("_own"))
    joined = rows.join(by_host, F.col("_own") == F.col("_host"), "left")
    made = joined.select("page_id", "url", main_text(F.coalesce("html", F.lit("")), F.col("wrapper")).alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
