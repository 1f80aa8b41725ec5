"""Main text of web pages by wrapper induction over the pages of a host.

A page becomes a tree of its block elements with its runs of text as leaves. Per host up to
``REFERENCES`` pages with text, of different shapes, are references: of each shape the page with
the smallest page_id, common shapes first. Simple tree matching aligns every page with each of
them, and a leaf that most of the aligned pages share, word for word, is template. What varies
is content, unless its place says otherwise: menus, footers, forms, adverts and the like vary
from page to page too. Pages with the very texts of the reference are no evidence, since in
them everything is constant.

Alignment needs tree shape and text hashes only: skeletons of some hundred bytes per page.
Pages are parsed once; what may be content is written beside the skeletons. References and
templates, a few rows per host, are sent to all tasks where they were counted to be few;
otherwise they meet the pages in a join by host, each host dealt to several tasks.
"""

from __future__ import annotations

import html
import re
import sys
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.shared import materialised, sized

# HTML's elements by how they are laid out.
BLOCKS = set("""address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td
tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "button", "xmp")
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "legend", "summary"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
          "option": {"option"}}
HOLDS = {"ul", "ol", "menu", "dl", "table", "select", "article", "main", "body", "div", "section", "nav", "aside", "footer"}

# Places that are not the article, by element and by the words of class, id and role.
ASIDE = set("nav footer aside form menu dialog select fieldset head search".split())
ASIDE_WORDS = set("""ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments
consent contentinfo cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice
notices notification outbrain overlay pager pagination popup promo promoted promotion recommended related replies reply
respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget
widgets""".split())
OUTSIDE_WORDS = {"header", "masthead", "topbar", "complementary", "side"}
MAIN = {"article", "main"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# A leaf is template if this share of the host's aligned pages have it, and so many of them.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3
REFERENCES = 3
# Texts of at most so many siblings are looked up; numbers that are kept to be used again.
# Neither changes a result.
RARE, MOST_KEPT = 8, 500_000
FEW_ROWS, FEW_NODES, PARTS = 100_000, 500_000, 32


class Tree:
    """Nodes in page order: parent, name ('#' for text), text, whether aside, whether in the main part, share of linked text."""

    def __init__(self, source: str | None):
        self.parent, self.name, self.text, self.aside, self.main, self.linked = [-1], ["root"], [""], [False], [False], [0.0]
        self._open, self._buffer, self._links, self._in_link = [0], [], 0, False
        for token in TOKEN.finditer(source or ""):
            text = token["text"]
            if text is not None:
                self._buffer.append(text)
                self._links += len(text) if self._in_link else 0
            elif token["tag"]:
                tag = token["tag"].lower()
                if tag in BLOCKS:
                    self._flush()
                    self._end(tag) if token["close"] else self._start(tag, token["rest"])
                elif tag == "br":
                    self._buffer.append(" ")
                elif tag == "a":
                    self._in_link = not token["close"]
        self._flush()

    def _add(self, name: str, text: str, aside: bool, main: bool, linked: float) -> int:
        up = self._open[-1]
        for column, value in ((self.parent, up), (self.name, name), (self.text, text), (self.aside, self.aside[up] or aside),
                              (self.main, self.main[up] or main), (self.linked, linked)):
            column.append(value)
        return len(self.name) - 1

    def _flush(self):
        if self._buffer:
            raw = "".join(self._buffer)
            text = " ".join(html.unescape(raw).split())
            if text:
                self._add("#", text, False, False, self._links / len(raw))
            self._buffer, self._links = [], 0

    def _start(self, tag: str, rest: str):
        closes = CLOSES.get(tag)
        for depth in range(len(self._open) - 1, 0, -1):
            name = self.name[self._open[depth]]
            if name == "p" and tag in CLOSES_P or closes and name in closes:
                del self._open[depth:]
            elif name in HOLDS:
                break
        if tag == "hr":
            return
        inside = self.main[self._open[-1]] or tag in MAIN
        aside = tag in ASIDE or tag == "header" and not inside
        if not aside and tag not in ("html", "body", *MAIN) and ("=" in rest):
            words = {w.lower() for m in NAMED.finditer(rest) for w in PART.findall(m[1] or m[2] or m[3] or "")}
            aside = bool(words & ASIDE_WORDS) or not inside and bool(words & OUTSIDE_WORDS)
        self._open.append(self._add(tag, "", aside, tag in MAIN, 0.0))

    def _end(self, tag: str):
        for depth in range(len(self._open) - 1, 0, -1):
            if self.name[self._open[depth]] == tag:
                del self._open[depth:]
                return
            if self.name[self._open[depth]] in ("article", "main", "nav", "footer", "aside") and tag in ("p", "div", "li", "section"):
                return

    def paths(self) -> list[int]:
        """A hash of the element names above each node, and its own."""
        out: list[int] = []
        for i, name in enumerate(self.name):
            out.append(xxhash.xxh3_64_intdigest(name, out[self.parent[i]] if i else 0))
        return out

    def hashes(self) -> list[int]:
        return [xxhash.xxh3_64_intdigest(t) if t else 0 for t in self.text]


def leaves(tree: Tree, paths: list[int], hashes: list[int]) -> list[tuple[int, int, str]]:
    """Path, hash and text of the leaves that are content by their place."""
    has_main = any(m and not a and n == "#" for m, a, n in zip(tree.main, tree.aside, tree.name))
    return [(paths[i], hashes[i], text) for i, text in enumerate(tree.text) if tree.name[i] == "#" and not tree.aside[i]
            and (tree.main[i] if has_main else tree.linked[i] < 0.9)]


def kept_text(tree: Tree, template: set[tuple[int, int]]) -> str:
    """The content leaves, two line feeds between them."""
    return "\n\n".join(text for path, hash_, text in leaves(tree, tree.paths(), tree.hashes()) if (path, hash_) not in template)


class Skeleton:
    def __init__(self, parents: list[int], paths: list[int], hashes: list[int]):
        self.paths, self.hashes = paths, hashes
        self.children: list[list[int]] = [[] for _ in parents]
        depths = [0] * len(parents)
        for i, parent in enumerate(parents):
            if i:
                self.children[parent].append(i)
                depths[i] = depths[parent] + 1
        self.depth = max(depths, default=0)


class Kinds:
    """The subtrees of a reference, and of pages beside it, by kind; and what kinds weigh against each other.

    Subtrees of one kind are alike in elements, shape and texts, but that all texts of pages
    which the reference has nowhere are -1: they make no difference to a weight. So pages of
    one shape have few kinds, and what was worked out for one page holds for the next.
    """

    def __init__(self, base: Skeleton):
        self.base, self.number = base, {text: n for n, text in enumerate({*base.hashes} - {0}, 1)}
        self.known: dict[tuple, int] = {}
        self.path, self.text, self.kids, self.some, self.full = [], [], [], [], []
        self.weights: dict[tuple[int, int], int] = {}
        self.lists: dict[tuple, _Siblings] = {}
        self.partners: dict[tuple, list[tuple[int, int]]] = {}
        self.of_base = self.of(base)

    def size(self) -> int:
        return len(self.known) + len(self.weights) + len(self.partners) + sum(len(y.at) * (1 + len(y.rows)) for y in self.lists.values())

    def kind(self, path: int, text: int, kids: tuple[int, ...]) -> int:
        key = (path, text, kids)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.path)
            self.path.append(path)
            self.text.append(text)
            self.kids.append(kids)
            self.some.append(text > 0 or any(self.some[k] for k in kids))
            self.full.append(1 + sum(self.full[k] for k in kids) if kids else 2)
        return found

    def of(self, page: Skeleton) -> list[int]:
        """The kind of each node's subtree."""
        out = [0] * len(page.paths)
        for i in range(len(out) - 1, -1, -1):
            text = page.hashes[i]
            out[i] = self.kind(page.paths[i], text and self.number.get(text, -1), tuple([out[c] for c in page.children[i]]))
        return out

    def texts(self, kind: int) -> set[int]:
        """The texts of the reference that a kind has."""
        out, todo = set(), [kind]
        while todo:
            kind = todo.pop()
            if self.text[kind] > 0:
                out.add(self.text[kind])
            todo.extend(k for k in self.kids[kind] if self.some[k])
        return out

    def without(self, kind: int, keep: set[int], none: int) -> int:
        """The kind with ``none`` for each of these texts, but for those to keep."""
        if not self.some[kind]:
            return kind
        text = self.text[kind]
        return self.kind(self.path[kind], none if text > 0 and text not in keep else text,
                         tuple([self.without(k, keep, none) for k in self.kids[kind]]))

    def siblings(self, y: tuple[int, ...]) -> _Siblings:
        if y not in self.lists:
            self.lists[y] = _Siblings(self, y)
        return self.lists[y]

    def weight(self, k: int, m: int) -> int:
        """Of the heaviest matching of a page's subtree and one of the reference."""
        if k == m:
            return self.full[k]
        if self.path[k] != self.path[m]:
            return 0
        x, y = self.kids[k], self.kids[m]
        if not x or not y:
            return 1
        total = self.weights.get((k, m))
        if total is None:
            begin, ends = alike(x, y)
            total = 1 + sum([self.full[c] for c in (*x[:begin], *x[len(x) - ends:])])
            x, y = x[begin:len(x) - ends], y[begin:len(y) - ends]
            if len(x) == 1 or len(y) == 1:
                total += max([self.weight(c, d) for c in x for d in y], default=0)
            elif x and y:
                total += int(table(x, self.siblings(y), len(x))[-1][-1])
            if len(self.weights) > MOST_KEPT:
                self.weights.clear()
            self.weights[k, m] = total
        return total

    def matched(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places in x and y of a heaviest matching in order, by the full table, of which some rows are held at once."""
        if len(x) == 1 or len(y) == 1:
            found = max([(self.weight(k, m), -p, -q) for p, k in enumerate(x) for q, m in enumerate(y)])
            return [(-found[1], -found[2])] if found[0] else []
        beside, step = self.siblings(y), isqrt(len(x))
        kept = table(x, beside, step)
        out, p, q = [], len(x), len(y)
        for start in range((len(x) - 1) // step * step, -1, -step):
            part = [row.tolist() for row in table(x[start:start + step], beside, 1, kept[start // step])]
            while p > start and q:
                here, above = part[p - start], part[p - start - 1]
                if here[q] == above[q]:
                    p -= 1
                elif here[q] == here[q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    out.append((p, q))
        return out

    def matching(self, page: Skeleton, kinds: list[int], i: int, j: int) -> list[tuple[int, int]]:
        """The pairs of nodes of a heaviest matching of a page's subtree and one of the reference.

        Subtrees that are alike at the beginnings or ends of two lists are partners in a heaviest one.
        """
        # Calls nest with the trees; frames of Python functions live on the heap, so only the
        # interpreter's own limit has to allow for them.
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 8 * max(page.depth, self.base.depth)))
        pairs, todo = [], [(i, j)] if self.path[kinds[i]] == self.path[self.of_base[j]] else []
        while todo:
            i, j = todo.pop()
            pairs.append((i, j))
            nodes, others = page.children[i], self.base.children[j]
            x, y = self.kids[kinds[i]], self.kids[self.of_base[j]]
            if (x, y) not in self.partners:
                begin, ends = alike(x, y)
                left, right = x[begin:len(x) - ends], y[begin:len(y) - ends]
                if len(left) == len(right) == 1:
                    middle = [(0, 0)] if self.path[left[0]] == self.path[right[0]] else []
                else:
                    middle = self.matched(left, right) if left and right else []
                self.partners[x, y] = [*((p, p) for p in range(begin)), *((begin + p, begin + q) for p, q in middle),
                                       *((len(x) - p, len(y) - p) for p in range(1, ends + 1))]
            todo += [(nodes[p], others[q]) for p, q in self.partners[x, y]]
        return pairs


class _Siblings:
    """A list of a reference's subtrees, against which kinds are weighed one by one."""

    def __init__(self, kinds: Kinds, y: tuple[int, ...]):
        self.kinds, self.each, self.rows = kinds, list(dict.fromkeys(y)), {}
        number = {m: n for n, m in enumerate(self.each)}
        self.at = np.array([number[m] for m in y])
        self.holders: dict[int, list[int]] = {}
        for n, m in enumerate(self.each):
            for text in kinds.texts(m):
                self.holders.setdefault(text, []).append(n)
        # Two subtrees without a rare text in common weigh what they would without their rare texts.
        self.common = {text for text, held in self.holders.items() if len(held) > RARE}
        plain = [kinds.without(m, self.common, -2) for m in self.each]
        self.plain = list(dict.fromkeys(plain))
        number = {m: n for n, m in enumerate(self.plain)}
        self.plain_at = np.array([number[m] for m in plain])
        self.plain_rows: dict[int, np.ndarray] = {}

    def row(self, k: int) -> np.ndarray:
        if k not in self.rows:
            kinds = self.kinds
            plain = kinds.without(k, self.common, -1)
            if plain not in self.plain_rows:
                if len(self.plain_rows) * len(self.plain) > MOST_KEPT:
                    self.plain_rows.clear()
                self.plain_rows[plain] = np.array([kinds.weight(plain, m) for m in self.plain], np.int64)
            out = self.plain_rows[plain][self.plain_at]
            for n in {n for text in kinds.texts(k) - self.common for n in self.holders.get(text, ())}:
                out[n] = kinds.weight(k, self.each[n])
            if (len(self.rows) + 1) * len(self.at) > MOST_KEPT:
                self.rows.clear()
            self.rows[k] = out[self.at]
        return self.rows[k]


def table(x, beside: _Siblings, step: int, first: np.ndarray | None = None) -> list[np.ndarray]:
    """Every ``step``-th row of the table of weights of the beginnings of two lists, and the last one."""
    last = np.zeros(len(beside.at) + 1, np.int64) if first is None else first
    kept = [last]
    for p, k in enumerate(x, 1):
        more = last[:-1] + beside.row(k)
        last = last.copy()
        np.maximum(last[1:], more, out=last[1:])
        np.maximum.accumulate(last, out=last)
        if p % step == 0 or p == len(x):
            kept.append(last)
    return kept


def alike(x, y) -> tuple[int, int]:
    """How many values two lists share at their beginnings, and then at their ends."""
    begin, ends, small = 0, 0, min(len(x), len(y))
    while begin < small and x[begin] == y[begin]:
        begin += 1
    while ends < small - begin and x[-1 - ends] == y[-1 - ends]:
        ends += 1
    return begin, ends


def aligned(a: Skeleton, b: Kinds) -> list[tuple[int, int]]:
    """The pairs of nodes that simple tree matching finds in a page and a reference, however deep they are."""
    return b.matching(a, b.of(a), 0, 0)


def matching(a: Skeleton, i: int, b: Skeleton, j: int) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two subtrees: its weight, and the pairs of nodes matched.

    Equal text weighs more than two leaves in like places. The matching is the heaviest,
    whatever the number of siblings.
    """
    kinds = Kinds(b)
    pairs = kinds.matching(a, kinds.of(a), i, j)
    return sum(1 + (not a.children[p] and not b.children[q] and a.hashes[p] == b.hashes[q]) for p, q in pairs), pairs


SKELETON = ("host string, page_id long, parents array<int>, paths array<long>, hashes array<long>, "
            "leaf_paths array<long>, leaf_hashes array<long>, leaf_texts array<string>")


def host_of() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def skeletons(pages: DataFrame) -> DataFrame:
    """A row per page, with its url and ``id``, the page_id as it came: the one time that pages are parsed.

    The texts of leaves that may be content are kept; templates read the other columns only.
    """
    given = {f.name: f.dataType.simpleString() for f in pages.select(F.col("page_id").alias("id"), "url").schema}
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string())]
    names = ["id", "url", *(f.split()[0] for f in SKELETON.split(", "))]

    def run(batches):
        signed = lambda values: np.array(values, np.uint64).view(np.int64).tolist()
        for batch in batches:
            host, page_id, source = (c.to_pylist() for c in batch.columns[2:])
            rows = []
            for one, number, text in zip(host, page_id, source):
                tree = Tree(text)
                paths, hashes = signed(tree.paths()), signed(tree.hashes())
                found = leaves(tree, paths, hashes)
                rows.append((one, number, tree.parent, paths, hashes, *([f[k] for f in found] for k in range(3))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds))], names)

    read = pages.select(F.col("page_id").alias("id"), "url", host_of().alias("host"), F.col("page_id").cast("long").alias("page_id"), "html")
    return materialised(read.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in given.items()) + ", " + SKELETON), "skeletons")


def templates(shapes: DataFrame) -> DataFrame:
    """Per host, the places and texts of its constant leaves; at most as many as the references have."""
    shapes = shapes.select("host", "page_id", "parents", "paths", "hashes")
    shape = F.xxhash64("paths").alias("shape")
    page = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.xxhash64("hashes").alias("print"))
    filled = shapes.where(F.exists("hashes", lambda h: h != 0))
    by_shape = filled.groupBy("host", shape).agg(F.min(page).alias("page"), F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("host").orderBy(F.col("n").desc(), "page", "shape"))
    enough = shapes.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") > TEMPLATE_PAGES)
    chosen = by_shape.withColumn("ref", place).where(F.col("ref") <= REFERENCES).join(enough, "host")
    chosen = materialised(chosen.select("host", "shape", "page", "ref"), "chosen")
    # Only the few chosen pages' trees are moved.
    references = filled.select("*", shape, page.alias("page")).join(sized(chosen, FEW_ROWS), ["host", "shape", "page"])
    references = references.groupBy("host", "ref").agg(*[F.any_value(c).alias(f"r_{c}") for c in ("parents", "paths", "hashes")])
    # At most REFERENCES trees in a row.
    tree = F.struct("ref", "r_parents", "r_paths", "r_hashes")
    references = materialised(references.groupBy("host").agg(F.collect_list(tree).alias("trees")), "references")

    def run(batches):
        names = ["host", "ref", "path", "hash", "n"]
        known: dict[str, list[tuple]] = {}
        for batch in batches:
            counts: dict[tuple, int] = {}
            if sum(k.size() for found in known.values() for _, k, _ in found) > MOST_KEPT:
                known.clear()
            for row, (host, parents, paths, hashes) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                if host not in known:
                    known[host] = [(t["ref"], Kinds(Skeleton(t["r_parents"], t["r_paths"], t["r_hashes"])), [h for h in t["r_hashes"] if h])
                                   for t in batch.column(4)[row].as_py()]
                page, texts = Skeleton(parents, paths, hashes), [h for h in hashes if h]
                for ref, kinds, others in known[host]:
                    if texts == others:
                        continue
                    base = kinds.base
                    same = [j for i, j in aligned(page, kinds) if base.hashes[j] and hashes[i] == base.hashes[j]]
                    for key in {(host, ref, 0, 0), *((host, ref, base.paths[j], base.hashes[j]) for j in same)}:
                        counts[key] = counts.get(key, 0) + 1
            if counts:
                columns = [*zip(*counts), list(counts.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)

    columns = ["host", "parents", "paths", "hashes", "trees"]
    nodes = F.aggregate("trees", F.lit(0), lambda n, t: n + F.size(t["r_parents"]))
    if references.select(F.coalesce(F.sum(nodes), F.lit(0))).first()[0] <= FEW_NODES:
        # Pages of a host come one after the other, so that a task makes its references ready once.
        joined = shapes.sortWithinPartitions("host").join(F.broadcast(references), "host")
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
        joined = shapes.withColumn("part", F.pmod(F.xxhash64("page_id", "hashes"), F.lit(PARTS)).cast("int")).join(
            references.select("*", parts), ["host", "part"])
    counted = materialised(joined.select(*columns).mapInArrow(run, "host string, ref long, path long, hash long, n long").groupBy("host", "ref", "path", "hash").agg(
        F.sum("n").alias("n")), "leaves")
    pages = counted.where("path = 0 AND hash = 0").select("host", "ref", F.col("n").alias("pages"))
    constant = counted.where(f"hash <> 0 AND n >= {TEMPLATE_PAGES}").join(pages, ["host", "ref"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    return materialised(constant.groupBy("host").agg(F.collect_set(F.struct("path", "hash")).alias("template")), "templates")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty html gives an empty text. Pages without a readable host are a host of
    their own; hosts of up to ``TEMPLATE_PAGES`` pages have no template. Of references with
    one page_id, the one with the smaller hash is taken.
    """
    parsed = skeletons(pages)
    found = templates(parsed)
    if found.select(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0] <= FEW_ROWS:
        found = F.broadcast(found)
    joined = parsed.select("id", "url", "host", "leaf_paths", "leaf_hashes", "leaf_texts").join(found, "host", "left").select(
        "id", "url", "host", "leaf_paths", "leaf_hashes", "leaf_texts", "template")

    def run(batches):
        known: dict[str, set] = {}
        for batch in batches:
            texts = []
            if sum(map(len, known.values())) > MOST_KEPT:
                known.clear()
            for row, (host, paths, hashes, leaf_texts) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:6]))):
                if host not in known:
                    known[host] = {(t["path"], t["hash"]) for t in batch.column(6)[row].as_py() or []}
                template = known[host]
                texts.append("\n\n".join([t for path, hash_, t in zip(paths, hashes, leaf_texts) if (path, hash_) not in template]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = parsed.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
