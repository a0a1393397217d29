"""HTML extraction by wrapper induction over the pages of a host.

1. Every page becomes a tree of blocks; inline markup joins its block's text. Runs of equal sibling shapes count as
   one slot, so a list or an article of any length has one shape.
2. A host's reference tree is its most frequent shape. All shapes of the host are aligned to it by simple tree
   matching (the largest common top-down mapping that keeps sibling order), once per shape and reference.
3. Over all distinct pages of the host each slot of the reference counts its texts exactly: a slot whose most frequent text is that of
   ``CONSTANT`` of the pages is template, the others are data, on a host of any size alike. The lowest node above all data slots that are not page furniture is the content region.
4. A page's text is what lies in the region of its host, by its own alignment, without furniture (menus, headers, footers,
   sidebars, notices, adverts, forms, comments) and without template slots outside an article.

Hosts with fewer than ``LEAST_PAGES`` distinct pages, and pages that do not align with the region, use their own article or
main element, else the body.

An element counts as furniture by its class or id only if one of these names as a whole says so (``related-posts``, not ``related-work``),
and never if it holds the page's main element or heading. A page that would have no text at all is read without these names.

Slot statistics are grouped aggregations, combined before the shuffle; the only thing that meets a page again is its host's wrapper.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_PAGES = 3
CONSTANT = 0.8    # share of pages with the same text from which a slot is template
TABLE = 4_000_000  # pairs of children beyond which the matching is found by halves, in memory that grows with one side only
MEMO = 1_000_000  # shapes and pairs that a task remembers

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter progress q ruby rb rp rt rtc s samp "
                    "small span strike strong sub sup time tt u var wbr input link meta base area col embed param source track nobr picture "
                    "audio video canvas map output").split())
FURNITURE = frozenset("nav footer aside form button select option dialog menu template svg object head datalist fieldset label legend".split())
FURNITURE_WORDS = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu "
                             "breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal newsletter subscribe share sharing "
                             "social related recommended comment comments commentlist respond toolbar pagination pager disclaimer "
                             "complementary contentinfo search alert dialog form").split())
HEADER_WORDS = frozenset("header masthead banner".split())
#: What a name may hold beside such a word.
NEUTRAL_WORDS = frozenset(("area bar block body bottom box button buttons col column container content entry global group inner item items left "
                           "link links list main module outer page panel post posts primary region right row secondary section site slot "
                           "text title top unit user widget wrap wrapper").split())
WHOLE = frozenset("html body main article".split())
#: What a start tag closes when it is the innermost open block.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}


class Node:
    __slots__ = ("label", "tag", "out", "parts", "shape", "slot")

    def __init__(self, tag: str, label: str, out: bool) -> None:
        self.tag, self.label, self.out = tag, label, out
        self.parts: list[Node | str] = []
        self.shape, self.slot = -1, -1


def _says(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id as a whole names one of ``words``, alone or with neutral words beside it."""
    parts = set(_WORD.findall(name))
    return bool(parts & words) and parts <= words | NEUTRAL_WORDS


def _is_furniture(tag: str, attributes: str, in_article: bool, names: bool = True) -> tuple[str, bool, bool]:
    """(label, whether the element and all in it is no content, whether only a name says so that its content can overrule)."""
    if tag in FURNITURE or (tag == "header" and not in_article):
        return tag, True, False
    if not attributes or tag in WHOLE:
        return tag, False, False
    words: set[str] = set()
    by_name = header = False
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        words.update(_WORD.findall(value))
        if names:
            for name in value.split():
                by_name |= _says(name, FURNITURE_WORDS)
                header |= not in_article and _says(name, HEADER_WORDS)
    return f"{tag}.{'-'.join(sorted(words))}" if words else tag, by_name or header, by_name and not header


def parse(page: str, names: bool = True) -> Node:
    """The tree of blocks of a page, broken markup included. Comments, scripts and the like leave nothing.

    Blocks may be nested to any depth. ``names`` says whether classes and ids can make an element furniture.
    """
    root = Node("html", "html", False)
    stack, articles = [root], 0
    is_open: dict[str, int] = {}
    unsure: list[Node] = []   # open elements that a name alone makes furniture
    at = 0

    def close(keep: int) -> None:
        nonlocal articles
        for n in stack[keep:]:
            is_open[n.tag] -= 1
            articles -= n.tag == "article"
            if unsure and unsure[-1] is n:
                unsure.pop()
        del stack[keep:]

    last = page.rfind(">") + 1   # no tag ends beyond, so none is looked for there
    while found := _TAG.search(page, at, last):
        if found.start() > at:
            stack[-1].parts.append(page[at:found.start()])
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                at = len(page)
            continue
        tag = found[2].lower()
        if found[1]:
            if is_open.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if k:
                    close(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at, last)
            at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            continue
        label, out, doubtful = _is_furniture(tag, found[3], articles > 0, names)
        if tag in INLINE and not (out and tag in ("a", "span")):
            stack[-1].parts.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            while stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ()):
                close(len(stack) - 1)
        if tag in ("main", "h1"):
            for n in unsure:
                n.out = False
            unsure.clear()
        node = Node(tag, label, out)
        stack[-1].parts.append(node)
        if tag != "hr" and not found[3].endswith("/"):
            stack.append(node)
            is_open[tag] = is_open.get(tag, 0) + 1
            articles += tag == "article"
            if doubtful:
                unsure.append(node)
    if at < len(page) and not re.match(r"<[a-zA-Z/!]", page[at:at + 2]):
        stack[-1].parts.append(page[at:].partition("<!--")[0])
    return root


class Pool:
    """Distinct trees, each by a number; equal trees have equal numbers."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []

    def number(self, label: str, children: tuple[int, ...]) -> int:
        found = self.numbers.setdefault((label, children), len(self.labels))
        if found == len(self.labels):
            self.labels.append(label)
            self.children.append(children)
            self.sizes.append(1 + sum(self.sizes[c] for c in children))
        return found


def shape(node: Node) -> str:
    """The shape below a node, runs of equal siblings once: ``label(child,child)``. Every node gets its number as ``shape``."""
    pool = Pool()
    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        now, ready = todo.pop()
        inner = [p for p in now.parts if not isinstance(p, str)] if not now.out else []
        if not ready:
            todo.append((now, True))
            todo += [(p, False) for p in inner]
            continue
        runs: list[int] = []
        for p in inner:
            if not runs or runs[-1] != p.shape:
                runs.append(p.shape)
        now.shape = pool.number(now.label, tuple(runs))
    out: list[str] = []
    open_: list[int | str] = [node.shape]
    while open_:
        token = open_.pop()
        if isinstance(token, str):
            out.append(token)
            continue
        out.append(pool.labels[token])
        if kids := pool.children[token]:
            out.append("(")
            open_.append(")")
            for k, c in enumerate(reversed(kids)):
                open_ += [",", c] if k else [c]
    return "".join(out)


def number_slots(node: Node) -> int:
    """Give every node the number of its slot, in the order of the shape; equal neighbours share slots. Returns how many."""
    count = 0
    todo: list[list[Node]] = [[node]]
    while todo:
        group = todo.pop()
        for n in group:
            n.slot = count
        count += 1
        if group[0].out:
            continue
        # Nodes of one slot have the same shape, so their children fall into the same runs.
        runs: list[list[Node]] = []
        for n in group:
            k, last = -1, None
            for p in n.parts:
                if isinstance(p, str):
                    continue
                if p.shape != last:
                    k, last = k + 1, p.shape
                if k == len(runs):
                    runs.append([])
                runs[k].append(p)
        todo += reversed(runs)
    return count


def tree(text: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of the slots of a shape, in its order."""
    labels: list[str] = []
    children: list[list[int]] = []
    above: list[int] = []
    for token in re.findall(r"[^(),]+|[()]", text):
        if token == "(":
            above.append(len(labels) - 1)
        elif token == ")":
            above.pop()
        else:
            # A node is under the last opened parenthesis.
            labels.append(token)
            children.append([])
            if above:
                children[above[-1]].append(len(labels) - 1)
    return labels, children


class Aligner:
    """Simple tree matching, with what it has found kept for the pages of one task.

    Scores belong to pairs of distinct trees, so the many equal parts of two pages are compared once, and equal trees not at all.
    """

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.pool = Pool()
        self.trees: dict[str, tuple[list[str], list[list[int]], list[int]]] = {}
        self.scores: dict[tuple[int, int], int] = {}
        self.found: dict[tuple[str, str], tuple[int, ...]] = {}

    def tree(self, text: str) -> tuple[list[str], list[list[int]], list[int]]:
        """Labels and children of the slots of a shape, and the number of the tree below each."""
        if text not in self.trees:
            labels, children = tree(text)
            numbers = [0] * len(labels)
            for slot in range(len(labels) - 1, -1, -1):
                numbers[slot] = self.pool.number(labels[slot], tuple(numbers[c] for c in children[slot]))
            self.trees[text] = labels, children, numbers
        return self.trees[text]

    def _table(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of distinct children, and the place of each child among them."""
        (ux, ix), (uy, iy) = np.unique(xs, return_inverse=True), np.unique(ys, return_inverse=True)
        labels = self.pool.labels
        table = np.zeros((len(ux), len(uy)), np.int64)
        by_label: dict[str, list[int]] = {}
        for j, y in enumerate(uy.tolist()):
            by_label.setdefault(labels[y], []).append(j)
        for i, x in enumerate(ux.tolist()):
            for j in by_label.get(labels[x], ()):
                table[i, j] = self.scores[x, int(uy[j])]
        return table, ix.ravel(), iy.ravel()

    @staticmethod
    def _last_row(table: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
        """Best totals of all ``ix`` with each beginning of ``iy``."""
        row = np.zeros(len(iy) + 1, np.int64)
        for i in ix.tolist():
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + table[i, iy]))
        return row

    def _pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the children that match in a best order-keeping matching."""
        begin = 0
        while begin < min(len(xs), len(ys)) and xs[begin] == ys[begin]:
            begin += 1
        end = 0
        while end < min(len(xs), len(ys)) - begin and xs[-1 - end] == ys[-1 - end]:
            end += 1
        out = [(k, k) for k in range(begin)] + [(len(xs) - k, len(ys) - k) for k in range(end, 0, -1)]
        a, b = xs[begin:len(xs) - end], ys[begin:len(ys) - end]
        if not a or not b:
            return out
        table, ix, iy = self._table(a, b)
        todo = [(0, len(ix), 0, len(iy))]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            if i0 == i1 or j0 == j1:
                continue
            if (i1 - i0) * (j1 - j0) > TABLE and i1 - i0 > 1:
                # Where a best matching crosses the middle row.
                half = (i0 + i1) // 2
                first = self._last_row(table, ix[i0:half], iy[j0:j1])
                second = self._last_row(table, ix[half:i1][::-1], iy[j0:j1][::-1])[::-1]
                cut = j0 + int(np.argmax(first + second))
                todo += [(i0, half, j0, cut), (half, i1, cut, j1)]
                continue
            rows = [np.zeros(j1 - j0 + 1, np.int64)]
            for i in ix[i0:i1].tolist():
                row = np.zeros_like(rows[-1])
                row[1:] = np.maximum.accumulate(np.maximum(rows[-1][1:], rows[-1][:-1] + table[i, iy[j0:j1]]))
                rows.append(row)
            i, j = i1 - i0, j1 - j0
            while i and j:
                own = table[ix[i0 + i - 1], iy[j0 + j - 1]]
                if own and rows[i][j] == rows[i - 1][j - 1] + own:
                    out.append((begin + i0 + i - 1, begin + j0 + j - 1))
                    i, j = i - 1, j - 1
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return sorted(out)

    def score(self, a: int, b: int) -> int:
        """Size of the largest top-down mapping of two trees of one label that keeps the order of siblings."""
        pool, todo = self.pool, [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.scores:
                todo.pop()
                continue
            xs, ys = pool.children[x], pool.children[y]
            if x == y or not xs or not ys:
                self.scores[x, y] = pool.sizes[x] if x == y else 1
                continue
            by_label: dict[str, set[int]] = {}
            for q in ys:
                by_label.setdefault(pool.labels[q], set()).add(q)
            open_ = [(p, q) for p in set(xs) for q in by_label.get(pool.labels[p], ()) if (p, q) not in self.scores]
            if open_:
                todo += open_
                continue
            pairs = self._pairs(xs, ys)
            self.scores[x, y] = 1 + sum(self.scores[xs[i], ys[j]] for i, j in pairs)
        return self.scores[a, b]

    def align(self, reference: str, other: str) -> tuple[int, ...]:
        """For each slot of ``other`` the slot of ``reference`` it matches, or -1."""
        if (reference, other) in self.found:
            return self.found[reference, other]
        if len(self.scores) + len(self.pool.labels) + sum(map(len, self.found.values())) > MEMO:
            self._forget()
        (la, ca, na), (lb, cb, nb) = self.tree(reference), self.tree(other)
        out = [-1] * len(lb)
        if la[0] == lb[0]:
            self.score(na[0], nb[0])
            todo = [(0, 0)]
            while todo:
                x, y = todo.pop()
                if na[x] == nb[y]:
                    # Slots are numbered from the root down, so equal trees have their slots in equal order.
                    size = self.pool.sizes[na[x]]
                    out[y:y + size] = range(x, x + size)
                    continue
                out[y] = x
                xs, ys = self.pool.children[na[x]], self.pool.children[nb[y]]
                if xs and ys:
                    todo += [(ca[x][i], cb[y][j]) for i, j in self._pairs(xs, ys)]
        self.found[reference, other] = tuple(out)
        return self.found[reference, other]


def align(reference: str, other: str) -> tuple[int, ...]:
    return Aligner().align(reference, other)


def blocks(node: Node, dropped: frozenset[int] = frozenset()) -> list[tuple[int, str]]:
    """(slot, text) of the blocks of content below a node in page order, white space evened out, no empty ones."""
    out: list[tuple[int, str]] = []
    held: list[str] = []

    def flush(slot: int) -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text and slot not in dropped:
            out.append((slot, text))

    todo: list[tuple[Node, int]] = [(node, 0)]
    while todo:
        now, at = todo.pop()
        parts = now.parts
        while at < len(parts):
            part = parts[at]
            at += 1
            if isinstance(part, str):
                held.append(part)
            elif part.out and part.tag in INLINE:
                continue
            else:
                flush(now.slot)
                if not part.out:
                    todo += [(now, at), (part, 0)]
                    break
        else:
            flush(now.slot)
    return out


def _outermost(node: Node, wanted: frozenset[str], slots: frozenset[int] | None = None) -> list[Node]:
    """Nodes with one of the tags (or slots) that are in no other such node and in no furniture, in page order."""
    out, todo = [], [node]
    while todo:
        now = todo.pop()
        if now.out:
            continue
        if (now.slot in slots) if slots is not None else (now.tag in wanted):
            out.append(now)
        else:
            todo += reversed([p for p in now.parts if not isinstance(p, str)])
    return out


def own_region(root: Node) -> list[Node]:
    return _outermost(root, frozenset(["article"])) or _outermost(root, frozenset(["main"])) or [root]


def region_of(labels: list[str], children: list[list[int]], data: list[int]) -> int:
    """The lowest slot above all ``data`` slots; only those in an article or main element if there are any."""
    parent = {c: p for p, cs in enumerate(children) for c in cs}

    def path(slot: int) -> list[int]:
        way = [slot]
        while way[-1] in parent:
            way.append(parent[way[-1]])
        return way[::-1]

    ways = [path(s) for s in data]
    for kind in ("article", "main"):
        if inside := [w for w in ways if any(labels[s].split(".")[0] == kind for s in w)]:
            ways = inside
            break
    common = ways[0]
    for way in ways[1:]:
        common = [a for a, b in zip(common, way) if a == b]
    return common[-1]


def extract(page: str, reference: str | None, region: int, template: list[int], aligner: Aligner | None = None) -> str:
    """The main text of a page under its host's wrapper; ``reference`` is None where there is none."""
    root = parse(page)
    found: list[Node] = []
    dropped: frozenset[int] = frozenset()
    if reference is not None:
        aligner = aligner or Aligner()
        own = shape(root)
        number_slots(root)
        mapped = aligner.align(reference, own)
        found = _outermost(root, frozenset(), frozenset(k for k, x in enumerate(mapped) if x == region))
        labels = aligner.tree(reference)[0]
        if not {"article", "main"} & {n.tag for n in found} and labels[region].split(".")[0] not in ("article", "main"):
            constant = set(template)
            dropped = frozenset(k for k, x in enumerate(mapped) if x in constant)
    text = " ".join(text for n in found or own_region(root) for _, text in blocks(n, dropped))
    if text:
        return text
    # Nothing but what names call furniture: then the names mean something else here.
    return " ".join(text for n in own_region(parse(page, names=False)) for _, text in blocks(n))


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, digest, hashes, sizes): the shape of each page, and the text of each slot as a hash."""
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = parse(page)
            own = shape(root)
            texts = [""] * number_slots(root)
            for slot, text in blocks(root):
                texts[slot] += f"{text}\n"
            hashes = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts]
            rows.append((host, own, xxhash.xxh64_intdigest("\0".join(texts)) - (1 << 63), hashes, [len(t) for t in texts]))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                                         names=["host", "shape", "digest", "hashes", "sizes"])


def _aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = Aligner()
    for batch in batches:
        mapped = [aligner.align(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(mapped, pa.list_(pa.int32()))], names=["host", "shape", "mapped"])


def _regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, reference, region, template) from the statistics of a host's slots."""
    for batch in batches:
        out: list[tuple] = []
        for host, reference, slots in zip(*(c.to_pylist() for c in batch.columns)):
            labels, children = tree(reference)
            varying = {s["slot"] for s in slots if s["chars"] and s["pages"] >= LEAST_PAGES and s["most"] < CONSTANT * s["pages"]}
            constant = sorted(s["slot"] for s in slots if s["chars"] and s["pages"] >= LEAST_PAGES and s["slot"] not in varying)
            if varying:
                out.append((host, reference, region_of(labels, children, sorted(varying)), constant))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                                         names=["host", "reference", "region", "template"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, reference, region, template) of every host with enough distinct pages, from (host, html)."""
    seen = pages.mapInArrow(_shapes, "host string, shape string, digest long, hashes array<long>, sizes array<long>")
    distinct = stored(seen.groupBy("host", "shape", "digest").agg(F.min("hashes").alias("hashes"), F.min("sizes").alias("sizes")), "shapes")
    shapes = distinct.groupBy("host", "shape").count()
    reference = shapes.groupBy("host").agg(F.max(F.struct("count", "shape"))["shape"].alias("reference"), F.sum("count").alias("pages"))
    reference = reference.filter(F.col("pages") >= LEAST_PAGES).select("host", "reference")
    mapped = (shapes.join(reference, "host").select("host", "reference", "shape")
              .mapInArrow(_aligned, "host string, shape string, mapped array<int>"))
    slots = (distinct.join(mapped, ["host", "shape"])
             .select("host", F.explode(F.arrays_zip("mapped", "hashes", "sizes")).alias("s")).filter("s.mapped >= 0")
             .groupBy("host", F.col("s.mapped").alias("slot"), "s.hashes").agg(F.count("*").alias("n"), F.sum("s.sizes").alias("chars"))
             .groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("most"), F.sum("chars").alias("chars")))
    # One entry per slot of a single tree.
    by_host = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "most", "chars")).alias("slots"))
    return reference.join(by_host, "host").select("host", "reference", "slots").mapInArrow(
        _regions, "host string, reference string, region int, template array<int>")


def main_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text, n_chars) of every row of (key, url, html).

    Null and empty html give an empty text. Null urls form one host. Repeated rows each come back and count once in statistics.
    """
    rows = pages.select(F.col(key).alias("_key"), "url", F.coalesce("html", F.lit("")).alias("html"), _host(F.col("url")).alias("host"))
    known = stored(wrappers(rows.select("host", "html")), "wrappers")
    met = rows.join(known, "host", "left").select("_key", "url", "html", "reference", "region", "template")
    kind = met.schema["_key"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            texts = [extract(p, r, -1 if n is None else n, t or [], aligner) for p, r, n, t in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["_key", "url", "text", "n_chars"])

    return met.mapInArrow(work, f"_key {kind}, url string, text string, n_chars long").withColumnRenamed("_key", key)


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
