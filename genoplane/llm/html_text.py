"""Main text of web pages by wrapper induction.

Every page is parsed into a tree of block elements. Neighbours of one shape become
one slot (a run of paragraphs, of list items), so a tree is as small as its page is
regular. Pages of a host whose outer elements are the same have one layout. In each
layout the smallest tree is the reference; every page of it is aligned with the
reference by simple tree matching, and Spark sums up by slot on how many pages it is,
how much of its text is links, and whether its structure is the same on all of them.

Constant nodes become template, varying slots content:

* a slot whose structure varies (more paragraphs here than there), and that is not
  mostly links, is content, and so is all of the element around it; the element is
  widened to an enclosing article or main, and to its parent as long as that is not
  the body and holds no menu;
* a slot outside of these is template if it is mostly links, or if its structure is
  the same on every page and it is no text element (paragraph, heading, table ...).
  Its texts may vary;
* a block (path and text) on at least MIN_PAGES different htmls of a host or of one
  of its sections, on SHARE of those that have its path and on LEAST_SHARE of all, is
  a constant. Inside of content (a content slot, or where nothing is known of a layout
  the outermost article elements) constants stay, so that headings and lines that
  articles share are not lost, unless they are mostly links.

The wrapper of a host is small: its references with their template and content slots,
and the keys of its constants. Each page is then aligned once more with the reference
of its layout (with that of the host's largest layout if its own has too few pages to
say), and the nodes of template slots and the constants go. Elements whose whole name
says what they are (nav, aside, form, a class "ad" or "user-comments", not
"ad-hoc-queries") go too. Ids of headings and other text elements are anchors and name
nothing; in articles and content slots those of sections name reader comments only.
Where nothing is known of a layout, the outermost article and main elements are the
content if they hold half of the text or more.

Counts are partial sums before the shuffle, so a hot host is spread over the tasks.
Wrappers are broadcast while their summed size is small, else joined by host, where
a skewed host can be split.

Defined cases. Null or empty html gives empty text. A null url has the empty host.
An unclosed tag or character reference at the end is dropped or kept as written.
Very long, very deep and very wide pages are read whole: no walk is recursive, and
all children are aligned by exact weights, whatever their number, in memory by the nodes
of one of the two lists. Only nodes of one label and depth are weighed against each other;
lists with over WEIGHED_CELLS pairs of nodes take the same weights from whole levels at
once, in time by these pairs. Equal alignments are told apart by one rule at every size.
Of references of one
size the one of least hash is taken, of layouts with as many pages the least.
Repeated rows give repeated results and count once; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_rules import split_url
from .workspace import over_texts, tidy, type_of, written

#: A constant is on this many different pages of a scope at least, on this share of those that have its path, and of all.
MIN_PAGES, SHARE, LEAST_SHARE = 3, 0.5, 0.1
#: A slot with this share of its text in links is a menu.
MENU_SHARE = 0.5
EVERY_PATH = 0
BROADCAST_BYTES = 8 << 20
#: Alignments of up to so many cells keep a table; of larger ones the first rows of up to PIECES pieces are kept, until they do.
TABLE_CELLS, PIECES = 1 << 22, 64
#: Lists of children are weighed pair by pair up to so many pairs of nodes under children of one label; larger ones level by level.
WEIGHED_CELLS = 1 << 18
#: Weights that are kept.
KNOWN_WEIGHTS = 500_000

#: Fixed sets of element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
INLINE = set("a abbr b bdi bdo br cite code data dfn em font i img kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
INVISIBLE = set("script style noscript template iframe svg head title object canvas audio video".split())
DROPPED = INVISIBLE | set("nav aside footer form button select textarea input menu dialog".split())
TEXT_ELEMENTS = set("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption table dl".split())
#: Fixed words: an element is not content if a class, id or role of it is made of these, and of NEUTRAL ones beside them.
NOT_CONTENT = set(
    "ad ads adbox advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar"
    " header masthead footer cookie cookies consent notice popup modal overlay newsletter subscribe share sharing social related"
    " recommended comment comments disqus respond reply replies login signup search toolbar widget pagination contentinfo complementary".split()
)
NEUTRAL = set("site page main global top bottom left right primary secondary box bar block area section container wrapper wrap inner outer list item items link links posts articles user reader form".split())
#: Of these, what names reader comments.
READER_COMMENTS = set("comment comments disqus respond reply replies".split())
_CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[-_]+")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Node:
    __slots__ = ("tag", "marks", "ids", "children", "parent", "label", "key", "in_article")

    def __init__(self, tag: str, marks: tuple[str, ...], parent: Node | None, ids: tuple[str, ...] = ()):
        #: marks are classes and roles.
        self.tag, self.marks, self.ids, self.children, self.parent = tag, marks, ids, [], parent
        self.label = "#".join([".".join([tag, *marks]), *ids])
        #: Of the labels from the root to here.
        self.key = xxhash.xxh64_intdigest(self.label.encode("utf-8", "surrogatepass"), parent.key if parent else 0)
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))

    @property
    def path(self) -> str:
        names, up = [], self
        while up is not None:
            names.append(up.label)
            up = up.parent
        return "/".join(reversed(names))


def _words(values: str) -> tuple[str, ...]:
    """The different words of attributes, without digits."""
    return tuple(sorted({x for t in values.split() if (x := _DIGITS.sub("", t).strip("-_"))}))


def parse(source: str) -> Node:
    """The tree of a page; children are nodes or decoded strings."""
    root = here = Node("", (), None)
    held = Counter()  # open elements by name
    at, end = 0, len(source)

    def leave(node: Node) -> Node:
        """Closes everything up to node; returns its parent."""
        up = here
        while True:
            held[up.tag] -= 1
            if up is node:
                return node.parent
            up = up.parent

    while at < end:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else end]
        if text:
            here.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name or not m[4] and at >= end:
            continue
        if m[1]:
            if held[name] > 0:
                up = here
                while up.tag != name:
                    up = up.parent
                here = leave(up)
            continue
        if name in _CLOSES_P and held["p"] > 0:
            up = here
            while up.parent is not None and (up.tag in INLINE or up.tag == "p"):
                if up.tag == "p":
                    here = leave(up)
                    break
                up = up.parent
        if name in _CLOSED_BY_SAME and (held[name] > 0 or name in ("dt", "dd") and held["dt"] + held["dd"] > 0):
            up = here
            while up.parent is not None and up.tag not in _CLOSED_BY_SAME[name]:
                if up.tag == name or name in ("dt", "dd") and up.tag in ("dt", "dd"):
                    here = leave(up)
                    break
                up = up.parent
        marks = ids = ()
        if m[3]:
            found = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(m[3])}
            if found:
                ids = _words(found.pop("id", ""))
                marks = _words(" ".join(found.values()))
        node = Node(name, marks, here, ids)
        here.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            here = node
            held[name] += 1
    return root


def is_boilerplate(node: Node, names: bool = True, in_content: bool = False) -> bool:
    """Whether a node's name says that it is not content; without names only what is never shown counts.

    Ids of text elements are anchors. So are, in an article or a content slot, those of
    sections (also as a div of that class), unless they name reader comments.
    """
    if not names:
        return node.tag in INVISIBLE
    if node.tag in DROPPED or node.tag == "header" and not node.in_article:
        return True
    ids = node.ids
    if node.tag in TEXT_ELEMENTS:
        ids = ()
    elif ids and (in_content or node.in_article) and (node.tag == "section" or node.tag == "div" and "section" in node.marks):
        ids = [x for x in ids if not READER_COMMENTS.isdisjoint(_PARTS.split(x))]
    quoted = node.tag == "blockquote" and (in_content or node.in_article)
    for mark in (*node.marks, *ids):
        parts = _PARTS.split(mark)
        says = [p for p in parts if p in NOT_CONTENT and not (quoted and p in READER_COMMENTS)]
        if says and all(p in NOT_CONTENT or p in NEUTRAL for p in parts) and not (node.in_article and set(says) == {"header"}):
            return True
    return False


def blocks(node: Node, gone=(), names: bool = True, content=()) -> list[tuple[int, str, bool]]:
    """(path key of the block element, text, whether it stands in one of the nodes (by id) content and is not mostly links).

    In page order, without boilerplate and the nodes (by id) gone; white space as one space, trimmed.
    """
    out: list[tuple[int, str, bool]] = []
    parts: list[str] = []
    where = [node.key]
    deep = links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((where[0], text, deep > 0 and linked < MENU_SHARE * len(text)))
        parts.clear()
        linked = 0

    todo: list = [iter([node])]
    owners: list[Node | None] = [None]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            closed = owners.pop()
            if closed is not None:
                if closed.tag not in INLINE:
                    flush()
                    where[0] = closed.parent.key if closed.parent else 0
                deep -= id(closed) in content
                links -= closed.tag == "a"
            continue
        if isinstance(child, str):
            parts.append(child)
            if links:
                linked += len(_SPACE.sub(" ", child).strip())
        elif child.tag in ("br", "img"):
            parts.append(" ")
        elif child is node or not (id(child) in gone or is_boilerplate(child, names, deep > 0)):
            if child.tag not in INLINE:
                flush()
                where[0] = child.key
            deep += id(child) in content
            links += child.tag == "a"
            todo.append(iter(child.children))
            owners.append(child)
    flush()
    return out


class Shapes:
    """Trees as numbers: a shape is a label and the shapes of its children. Weights of simple tree matching are kept by pair.

    Exact ones align lists of every size by these weights, and so do all pages of operator 8. Others
    estimate the weights of lists with over WEIGHED_CELLS pairs of nodes, in time by their children alone.
    """

    def __init__(self, exact: bool = False) -> None:
        self.exact = exact
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.names: dict[str, int] = {}
        self.labels: list[int] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def number(self, label: str, kids: tuple[int, ...]) -> int:
        at = self.numbers.get((label, kids))
        if at is None:
            at = self.numbers[label, kids] = len(self.labels)
            self.labels.append(self.names.setdefault(label, len(self.names)))
            self.kids.append(kids)
            self.sizes.append(1 + sum(self.sizes[k] for k in kids))
        return at

    def weight(self, a: int, b: int) -> int:
        """Nodes in the largest top-down alignment of two shapes that keeps order; 0 if their labels differ."""
        todo = [(a, b)]
        while todo:
            x, y = pair = todo[-1]
            if pair in self.known:
                todo.pop()
            elif x == y or self.labels[x] != self.labels[y]:
                self.known[pair] = self.sizes[x] if x == y else 0
                todo.pop()
            else:
                head, xs, ys = self.differing(self.kids[x], self.kids[y])
                need = [p for i, js in self.alike(xs, ys) for j in js if (p := (i, j)) not in self.known]
                if need:
                    todo += need
                else:
                    self.known[pair] = 1 + sum(map(self.sizes.__getitem__, head)) + int(self.scores(xs, ys)[-1])
                    todo.pop()
        return self.known[a, b]

    def likeness(self, x: int, y: int) -> int:
        """An estimate of the weight of two shapes of one label by their children alone: equal ones by size, others of one label as one."""
        if x == y:
            return self.sizes[x]
        mine, yours = Counter(self.kids[x]), Counter(self.kids[y])
        equal = mine & yours
        rest = [Counter(self.labels[k] for k in (kids - equal).elements()) for kids in (mine, yours)]
        return 1 + sum(self.sizes[k] * n for k, n in equal.items()) + (rest[0] & rest[1]).total()

    @staticmethod
    def differing(xs, ys):
        """(children that both lists share at their ends, the rest of each). A best alignment pairs equal heads and tails."""
        n, start, end = min(len(xs), len(ys)), 0, 0
        while start < n and xs[start] == ys[start]:
            start += 1
        while end < n - start and xs[-1 - end] == ys[-1 - end]:
            end += 1
        return [*xs[:start], *xs[len(xs) - end :]], xs[start : len(xs) - end], ys[start : len(ys) - end]

    def alike(self, xs, ys):
        """(x, the different ys of its label) for each different x that has any."""
        of: dict[int, list[int]] = {}
        for y in dict.fromkeys(ys):
            of.setdefault(self.labels[y], []).append(y)
        return [(x, of[self.labels[x]]) for x in dict.fromkeys(xs) if self.labels[x] in of]

    def _rows(self, xs, ys):
        """For each x its weights with all ys."""
        distinct, at = np.unique(np.asarray(ys, dtype=np.int64), return_inverse=True)
        place = {y: k for k, y in enumerate(distinct.tolist())}
        alike = dict(self.alike(xs, ys))

        def cells(size) -> int:
            return sum(size(x) * sum(map(size, js)) for x, js in alike.items())

        weigh = lambda x, y: self.sizes[x] if x == y else 1
        if cells(self.sizes.__getitem__) <= WEIGHED_CELLS:
            weigh = self.weight
        elif self.exact:
            by_level, held = _Levels(self, distinct.tolist()), {}
            for x in xs:
                row = held.get(x)
                if row is None:
                    row = by_level.weights(x)[at]
                    if (len(held) + 1) * len(row) <= TABLE_CELLS:
                        held[x] = row
                yield row
            return
        elif cells(lambda x: 1 + len(self.kids[x])) <= WEIGHED_CELLS:
            weigh = self.likeness
        kept: dict[int, np.ndarray] = {}
        for x in xs:
            row = kept.get(x)
            if row is None:
                row = np.zeros(len(distinct), dtype=np.int64)
                for y in alike.get(x, ()):
                    row[place[y]] = weigh(x, y)
                row = row[at]
                if (len(kept) + 1) * len(row) <= TABLE_CELLS:
                    kept[x] = row
            yield row

    def scores(self, xs, ys, table: list | None = None, row: np.ndarray | None = None) -> np.ndarray:
        """Best weight of all xs with each beginning of ys, after the row of what is before xs; table takes the rows before."""
        row = np.zeros(len(ys) + 1, dtype=np.int64) if row is None else row
        if len(ys):
            for w in self._rows(xs, ys):
                if table is not None:
                    table.append(row)
                new = np.maximum(row[1:], row[:-1] + w)
                row = np.concatenate([row[:1], np.maximum.accumulate(new)])
        if table is not None:
            table.append(row)
        return row

    def align(self, xs, ys) -> list[tuple[int, int]]:
        """Positions paired by a best alignment of two lists of shapes: of equal ones that which the whole table gives, read from its end."""
        if len(self.known) > KNOWN_WEIGHTS:
            self.known.clear()
        out, a, b, c, d = [], 0, len(xs), 0, len(ys)
        while a < b and c < d and xs[a] == ys[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and xs[b - 1] == ys[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        # Where each label occurs once a list, in one order, no weight is asked for: a chain of elements is walked once.
        mine, yours = ([self.labels[k] for k in kids] for kids in (xs[a:b], ys[c:d]))
        both = set(mine) & set(yours)
        left, right = ([k for k, label in enumerate(labels) if label in both] for labels in (mine, yours))
        if len(left) == len(both) and [mine[k] for k in left] == [yours[k] for k in right]:
            return sorted(out + [(a + i, c + k) for i, k in zip(left, right)])
        j, todo = d - c, [(a, b, np.zeros(d - c + 1, dtype=np.int64))]
        while todo and j:
            top, end, row = todo.pop()
            row = row[: j + 1]
            if (end - top) * j > TABLE_CELLS and end - top > 1:
                step = -(-(end - top) // min(PIECES, -(-(end - top) * j // TABLE_CELLS)))
                for at in range(top, end, step):
                    todo.append((at, min(at + step, end), row))
                    if at + step < end:
                        row = self.scores(xs[at : at + step], ys[c : c + j], row=row)
                continue
            table: list[np.ndarray] = []
            self.scores(xs[top:end], ys[c : c + j], table, row)
            i = end - top
            while i and j:
                here = table[i][j]
                if here == table[i - 1][j]:
                    i -= 1
                elif here == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((top + i, c + j))
        return sorted(out)


class _Levels:
    """The nodes under a list of shapes by depth, to weigh one shape with all of the list at once.

    Simple tree matching pairs nodes of one depth only. What is kept of a level are its different
    shapes, by label and number of kids (to the next power of two), so memory grows with their nodes.
    """

    def __init__(self, shapes: Shapes, ys: list[int]) -> None:
        self.shapes = shapes
        #: By depth: how many shapes, and by label (their places, places of their kids a level down, filled up with the place behind the last).
        self.levels: list[tuple[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]]] = []
        #: Weights by depth and shape, up to TABLE_CELLS numbers.
        self.kept: dict[tuple[int, int], np.ndarray] = {}
        self.room = TABLE_CELLS
        while ys:
            below = list(dict.fromkeys(k for y in ys for k in shapes.kids[y]))
            place = {k: n for n, k in enumerate(below)}
            groups: dict[tuple[int, int], list[int]] = {}
            for n, y in enumerate(ys):
                groups.setdefault((shapes.labels[y], (len(shapes.kids[y]) - 1).bit_length() if shapes.kids[y] else -1), []).append(n)
            of: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for (label, bits), members in groups.items():
                kids = np.full((len(members), 1 << bits if bits >= 0 else 0), len(below), dtype=np.int64)
                for n, y in enumerate(members):
                    mine = shapes.kids[ys[y]]
                    kids[n, : len(mine)] = [place[k] for k in mine]
                of.setdefault(label, []).append((np.array(members), kids))
            self.levels.append((len(ys), of))
            ys = below

    def weights(self, x: int) -> np.ndarray:
        """The weights of x with each shape of the list. Kids are added to their parent one by one, so a path of nodes is held."""
        labels, kids = self.shapes.labels, self.shapes.kids
        done = None  # the weights of the kid that was left last
        path: list[list] = [[x, 0, None]]  # shape, kids seen, best weights of these with each beginning of the kids of a group
        while path:
            frame = path[-1]
            shape, depth = frame[0], len(path) - 1
            size, of = self.levels[depth]
            groups = of.get(labels[shape], ())
            if done is not None:
                if frame[2] is None:
                    frame[2] = [np.zeros((len(k), k.shape[1] + 1), dtype=np.int64) for _, k in groups]
                for best, (_, k) in zip(frame[2], groups):
                    new = np.maximum(best[:, 1:], best[:, :-1] + done[k])
                    np.maximum.accumulate(new, axis=1, out=best[:, 1:])
                done = None
            mine, below = kids[shape], self.levels[depth + 1][1] if depth + 1 < len(self.levels) else {}
            if groups and below:
                while frame[1] < len(mine) and labels[mine[frame[1]]] not in below:
                    frame[1] += 1
                if frame[1] < len(mine):
                    kid = mine[frame[1]]
                    frame[1] += 1
                    done = self.kept.get((depth + 1, kid))
                    if done is None:
                        path.append([kid, 0, None])
                    continue
            done = np.zeros(size + 1, dtype=np.int64)
            for n, (members, _) in enumerate(groups):
                done[members] = 1 if frame[2] is None else 1 + frame[2][n][:, -1]
            if depth and len(done) <= self.room:
                self.kept[depth, shape] = done
                self.room -= len(done)
            path.pop()
        return done[:-1]


def kinds(node: Node) -> list:
    return [c for c in node.children if not isinstance(c, str) or c.strip()]


def _post_order(node: Node):
    todo = [(node, False)]
    while todo:
        n, done = todo.pop()
        if done:
            yield n
        else:
            todo.append((n, True))
            todo += [(c, False) for c in n.children if not isinstance(c, str)]


def tree_match(a: Node, b: Node) -> tuple[int, list]:
    """Simple tree matching: (size of the largest top-down alignment that keeps order, its pairs of text nodes).

    Pairs are (path, text of a, text of b). All children are aligned.
    """
    shapes, of = Shapes(exact=True), {}
    text = shapes.number("#text", ())
    number = lambda c: text if isinstance(c, str) else of[id(c)]
    for tree in (a, b):
        for n in _post_order(tree):
            of[id(n)] = shapes.number(n.label, tuple(number(c) for c in kinds(n)))
    root = lambda n: shapes.kids[of[id(n)]]
    head, xs, ys = shapes.differing(root(a), root(b))
    size = 1 + sum(map(shapes.sizes.__getitem__, head)) + int(shapes.scores(xs, ys)[-1])
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        mine, yours = kinds(x), kinds(y)
        below = []
        for i, j in shapes.align(root(x), root(y)):
            if isinstance(mine[i], str):
                pairs.append((x.path, mine[i], yours[j]))
            else:
                below.append((mine[i], yours[j]))
        todo += reversed(below)
    return size, pairs


class Slot:
    """A run of neighbouring block elements of one shape."""

    __slots__ = ("label", "kids", "nodes", "full", "chars", "link_chars", "shape")

    def __init__(self, label: str, kids: list[Slot], nodes: list, full: int, chars: int, link_chars: int):
        self.label, self.kids, self.nodes, self.full, self.chars, self.link_chars, self.shape = label, kids, nodes, full, chars, link_chars, -1

    @property
    def tag(self) -> str:
        return re.split("[.#]", self.label, maxsplit=1)[0]


def _merged(run: list[Slot]) -> Slot:
    """One slot of several of one shape: their members together, kid by kid. Merges from top to bottom without recursion."""
    if len(run) == 1:
        return run[0]

    def joined(slots: list[Slot]) -> Slot:
        full = xxhash.xxh64_intdigest(np.array([s.full for s in slots], dtype=np.uint64).tobytes())
        return Slot(slots[0].label, [], [n for s in slots for n in s.nodes], full, sum(s.chars for s in slots), sum(s.link_chars for s in slots))

    top = joined(run)
    top.shape = run[0].shape
    todo = [(top, run)]
    while todo:
        into, slots = todo.pop()
        for k in range(len(slots[0].kids)):
            parts = [s.kids[k] for s in slots]
            kid = joined(parts)
            kid.shape = parts[0].shape
            into.kids.append(kid)
            todo.append((kid, parts))
    return top


def skeleton(root: Node, shapes: Shapes) -> Slot:
    """The slots of a page. Inline elements belong to the block around them; their blocks are its children."""
    made: dict[int, tuple[list[Slot], int, int]] = {}
    for n in _post_order(root):
        if n.tag in INVISIBLE:
            continue
        kids: list[Slot] = []
        chars = links = 0
        for c in n.children:
            if isinstance(c, str):
                chars += len(c.strip())
            elif (got := made.pop(id(c), None)) is not None:
                kids += got[0]
                chars, links = chars + got[1], links + got[2]
        if n.tag in INLINE:
            made[id(n)] = kids, chars, chars if n.tag == "a" else links
            continue
        runs: list[list[Slot]] = []
        for k in kids:
            if runs and runs[-1][0].shape == k.shape:
                runs[-1].append(k)
            else:
                runs.append([k])
        full = xxhash.xxh64_intdigest(n.label.encode("utf-8", "surrogatepass") + np.array([k.full for k in kids], dtype=np.uint64).tobytes())
        # Runs are merged where their parent is done, so each slot takes part in as many merges as it has ancestors in runs.
        slot = Slot(n.label, [_merged(r) for r in runs], [n], full, chars, links)
        slot.shape = shapes.number(n.label, tuple(k.shape for k in slot.kids))
        made[id(n)] = [slot], chars, links
    return made[id(root)][0][0]


def slots_of(top: Slot) -> list[Slot]:
    """All slots, parents before their kids, in page order."""
    out, todo = [], [top]
    while todo:
        s = todo.pop()
        out.append(s)
        todo += reversed(s.kids)
    return out


def layout_of(top: Slot) -> int:
    """Of the labels of the outer slots: three levels, so html, body and what is in the body."""
    names, level = [], [top]
    for _ in range(4):
        names.append("|".join(s.label for s in level))
        level = [k for s in level for k in s.kids]
    return signed(xxhash.xxh64_intdigest("\n".join(names).encode("utf-8", "surrogatepass")))


def flat(top: Slot) -> str:
    """A reference as text: labels and numbers of kids, parents first."""
    return json.dumps([[s.label, len(s.kids)] for s in slots_of(top)], separators=(",", ":"))


def unflat(text: str, shapes: Shapes) -> list[Slot]:
    rows = json.loads(text)
    out = [Slot(label, [], [], 0, 0, 0) for label, _ in rows]
    open_slots: list[list] = []
    for s, (_, n) in zip(out, rows):
        if open_slots:
            open_slots[-1][0].kids.append(s)
            open_slots[-1][1] -= 1
        open_slots.append([s, n])
        while open_slots and not open_slots[-1][1]:
            open_slots.pop()
    for s in reversed(out):
        s.shape = shapes.number(s.label, tuple(k.shape for k in s.kids))
    return out


def matched(top: Slot, reference: list[Slot], shapes: Shapes) -> list[tuple[Slot, int]]:
    """(slot of a page, number of the reference's slot) for all pairs of the alignment."""
    numbers = {id(s): k for k, s in enumerate(reference)}
    out, todo = [], [(top, reference[0])]
    while todo:
        x, y = todo.pop()
        out.append((x, numbers[id(y)]))
        if x.shape == y.shape:
            todo += zip(x.kids, y.kids)
        else:
            todo += [(x.kids[i], y.kids[j]) for i, j in shapes.align([k.shape for k in x.kids], [k.shape for k in y.kids])]
    return out


def template_slots(reference: str, stats: dict[int, tuple]) -> tuple[list[int], list[int]] | None:
    """The numbers of the topmost template slots and of the topmost content slots; None if no slot varies, so that structure says nothing.

    stats: number -> (pages, whether the structure varies, whether the run's length varies, characters, characters in links).
    """
    slots = unflat(reference, Shapes())
    parent: dict[int, int] = {}
    numbers = {id(s): k for k, s in enumerate(slots)}
    for k, s in enumerate(slots):
        for kid in s.kids:
            parent[numbers[id(kid)]] = k
    menu = [k in stats and stats[k][3] > 0 and stats[k][4] >= MENU_SHARE * stats[k][3] for k in range(len(slots))]
    varies = [k in stats and stats[k][1] for k in range(len(slots))]
    named = [_named(s) for s in slots]
    for k in range(1, len(slots)):
        menu[k], named[k] = menu[k] or menu[parent[k]], named[k] or named[parent[k]]
    holds = list(menu)  # a menu or boilerplate at or under the slot
    for k in range(len(slots) - 1, 0, -1):
        holds[k] = holds[k] or named[k]
        holds[parent[k]] = holds[parent[k]] or holds[k]

    content = [False] * len(slots)
    for k, s in enumerate(slots):
        if not varies[k] or menu[k] or named[k] or not stats[k][3] or s.tag in ("", "html", "body"):
            continue
        if any(varies[numbers[id(x)]] and not menu[numbers[id(x)]] for x in s.kids):
            continue  # what varies is further down
        at = parent[k] if stats[k][2] else k
        while slots[at].tag not in ("", "html", "body") and slots[parent[at]].tag not in ("", "html", "body") and not any(holds[numbers[id(x)]] for x in slots[parent[at]].kids):
            at = parent[at]
        up = at
        while up:
            if slots[up].tag in ("article", "main"):
                at = up
            up = parent[up]
        if slots[at].tag in ("", "html", "body"):
            at = k  # text right in the body: its run alone
        content[at] = True
    if not any(content):
        return None
    inside, around = list(content), list(content)
    for k in range(1, len(slots)):
        inside[k] = inside[k] or inside[parent[k]]
    for k in range(len(slots) - 1, 0, -1):
        around[parent[k]] = around[parent[k]] or around[k]
    out: list[int] = []
    gone = [False] * len(slots)
    for k in range(1, len(slots)):
        if gone[parent[k]]:
            gone[k] = True
        elif not inside[k] and not around[k] and (menu[k] or k in stats and not varies[k] and slots[k].tag not in TEXT_ELEMENTS):
            gone[k] = True
            out.append(k)
    return out, [k for k in range(1, len(slots)) if content[k] and not inside[parent[k]]]


def _named(slot: Slot) -> bool:
    head, *ids = slot.label.split("#")
    tag, *marks = head.split(".")
    return is_boilerplate(Node(tag, tuple(marks), None, tuple(ids))) and tag != "header"


def key(path: int, text: str) -> int:
    return signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), path))


def entries(tree: Node) -> set[tuple[int, int]]:
    """(key of the path, key of path and text) of the blocks of a page; EVERY_PATH for the page itself."""
    return {(EVERY_PATH, EVERY_PATH)} | {(x, y) for path, text, _ in blocks(tree) for x, y in ((signed(path), signed(path)), (signed(path), key(path, text)))}


def is_constant(pages, of_path, of_scope):
    """Whether a block of so many pages is template, given the pages that have its path and all pages; numbers or columns."""
    return (pages >= MIN_PAGES) & (pages >= SHARE * of_path) & (pages >= LEAST_SHARE * of_scope)


def induce(sources: list[str]) -> dict:
    """The wrapper of pages of one host (and no section): keys of its constants, and its layouts by decreasing pages."""
    sources = list(dict.fromkeys(s for s in sources if s))
    shapes, trees = Shapes(exact=True), [parse(s) for s in sources]
    found = [entries(t) for t in trees]
    counts = Counter(e for page in found for e in page)
    constants = sorted(y for (x, y), n in counts.items() if x != y and is_constant(n, counts[x, x], len(found)))
    groups: dict[int, list[tuple[int, int, Slot]]] = {}
    for source, tree in zip(sources, trees):
        top = skeleton(tree, shapes)
        groups.setdefault(layout_of(top), []).append((len(slots_of(top)), key(0, source), top))
    layouts = []
    for layout, pages in groups.items():
        if len(pages) < MIN_PAGES:
            continue
        reference = flat(min(pages, key=lambda p: p[:2])[2])
        seen: dict[int, list[tuple]] = {}
        for *_, top in pages:
            for slot, number in matched(top, unflat(reference, shapes), shapes):
                seen.setdefault(number, []).append((slot.full, len(slot.nodes), slot.chars, slot.link_chars))
        stats = {k: (len(v), len({x[0] for x in v}) > 1, len({x[1] for x in v}) > 1, sum(x[2] for x in v), sum(x[3] for x in v)) for k, v in seen.items()}
        judged = template_slots(reference, stats)
        if judged is not None:
            layouts.append((-len(pages), layout, reference, *judged))
    return {"constants": constants, "layouts": [list(x[1:]) for x in sorted(layouts)]}


class Wrapper:
    """A host's wrapper, ready to use."""

    def __init__(self, spec: dict | None):
        spec = spec or {}
        self.constants = set(spec.get("constants") or ())
        self.shapes = Shapes(exact=True)
        self.layouts = {layout: (unflat(reference, self.shapes), set(gone), set(content)) for layout, reference, gone, content in spec.get("layouts") or ()}
        self.largest = next(iter(self.layouts), None)

    def parts(self, tree: Node) -> tuple[set[int], set[int]] | None:
        """ids of the nodes of template slots, and of content slots; None if no layout is known."""
        if self.largest is None:
            return None
        top = skeleton(tree, self.shapes)
        reference, *sets = self.layouts.get(layout_of(top)) or self.layouts[self.largest]
        pairs = matched(top, reference, self.shapes)
        gone, content = ({id(n) for slot, number in pairs if number in chosen for n in slot.nodes} for chosen in sets)
        return gone, content


def extract(source: str | None, wrapper: dict | Wrapper | None, names: bool = True) -> str:
    """The main text of a page: its blocks joined by one newline. Without names no element goes for what it is called."""
    if not source:
        return ""
    tree = parse(source)
    known = wrapper if isinstance(wrapper, Wrapper) else Wrapper(wrapper)
    parts = known.parts(tree)
    gone, content = parts or ((), ())

    def kept(node: Node, content) -> list[str]:
        return [text for path, text, safe in blocks(node, gone, names, content) if safe or not known.constants or key(path, text) not in known.constants]

    whole = kept(tree, content)
    if parts is not None:
        return "\n".join(whole)
    # Elements that hold less than half are teasers or such: the page's text is elsewhere.
    main = outermost(tree) if names else []
    if main and 2 * sum(len(text) for n in main for text in kept(n, ())) >= sum(map(len, whole)):
        articles = {id(n) for n in main if n.tag == "article"}
        if inside := [text for n in main for text in kept(n, articles)]:
            return "\n".join(inside)
    return "\n".join(whole)


def outermost(tree: Node) -> list[Node]:
    """The outermost article and main elements outside boilerplate, in page order."""
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main") or "main" in n.marks or "main" in n.ids:
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if not isinstance(c, str) and not is_boilerplate(c)]
    return out


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) for each host with constants or layouts. Scopes of constants are a host and each of its sections, the first part of longer paths."""
    rows = split_url(pages.select("page_id", "url", "html")).filter("length(html) > 0")
    rows = rows.withColumn("section", F.regexp_extract("path", r"(?s)^/([^/]+)/", 1))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for host, section, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shapes, tree = Shapes(), parse(source)
                top = skeleton(tree, shapes)
                held, every = entries(tree), slots_of(top)
                stats = np.array([(signed(s.full), len(s.nodes), s.chars, s.link_chars) for s in every], dtype=np.int64).tobytes()
                for column, value in zip(out, (host, section, key(0, source), layout_of(top), flat(top), stats, [x for x, _ in held], [y for _, y in held])):
                    column.append(value)
            kinds_of = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds_of)], names=["host", "section", "page", "layout", "tree", "stats", "on", "block"])

        return work

    read = written(over_texts(rows, ["host", "section", "html"], make, "host string, section string, page long, layout long, tree string, stats binary, on array<long>, block array<long>"), "page-trees")
    return written(_constants(read).join(_layouts(read), "host", "full_outer").select("host", F.to_json(F.struct("constants", "layouts")).alias("wrapper")), "wrappers")


def _constants(read: DataFrame) -> DataFrame:
    """(host, constants): the blocks that are template by their text."""
    scoped = read.select("host", "page", F.explode(F.array_distinct(F.array(F.lit(""), "section"))).alias("section"), F.arrays_zip("on", "block").alias("held"))
    held = scoped.select("host", "section", "page", F.explode("held").alias("x")).select("host", "section", F.col("x.on").alias("on"), F.col("x.block").alias("block"), "page")
    counts = held.groupBy("host", "section", "on", "block").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= MIN_PAGES)
    counts = written(counts, "blocks")
    totals = counts.filter(F.col("on") == F.col("block"))
    scopes = totals.filter(F.col("on") == EVERY_PATH).select("host", "section", F.col("n").alias("of_scope"))
    paths = totals.select("host", "section", "on", F.col("n").alias("of_path"))
    found = counts.filter(F.col("on") != F.col("block")).join(paths, ["host", "section", "on"]).join(scopes, ["host", "section"])
    found = found.filter(is_constant(F.col("n"), F.col("of_path"), F.col("of_scope")))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("block")).alias("constants"))


def _layouts(read: DataFrame) -> DataFrame:
    """(host, layouts): references and their template slots, from the alignment of every page with its layout's reference."""
    rank = F.struct(F.length("stats"), "page")
    groups = read.groupBy("host", "layout").agg(F.count_distinct("page").alias("n"), F.min_by("tree", rank).alias("reference")).filter(F.col("n") >= MIN_PAGES)
    groups = written(groups, "references")

    def make():
        shapes, known = Shapes(exact=True), {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal shapes
            out: tuple[list, ...] = tuple([] for _ in range(7))
            for host, layout, tree, stats, reference in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if len(shapes.known) > KNOWN_WEIGHTS or len(known) > 1000:
                    shapes = Shapes(exact=True)
                    known.clear()
                if reference not in known:
                    known[reference] = unflat(reference, shapes)
                every = unflat(tree, shapes)
                numbers = {id(s): k for k, s in enumerate(every)}
                values = np.frombuffer(stats, dtype=np.int64).reshape(-1, 4)
                pairs = matched(every[0], known[reference], shapes)
                mine = values[[numbers[id(s)] for s, _ in pairs]]
                for column, value in zip(out, ([host] * len(pairs), [layout] * len(pairs), [k for _, k in pairs], *mine.T.tolist())):
                    column += value
            types = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["host", "layout", "slot", "full", "members", "chars", "link_chars"])

        return work

    aligned = over_texts(read.join(groups.drop("n"), ["host", "layout"]), ["host", "layout", "tree", "stats", "reference"], make, "host string, layout long, slot int, full long, members long, chars long, link_chars long")
    stats = aligned.groupBy("host", "layout", "slot").agg(
        F.count("*").alias("n"),
        (F.min("full") != F.max("full")).alias("varies"),
        (F.min("members") != F.max("members")).alias("run_varies"),
        F.sum("chars").alias("chars"),
        F.sum("link_chars").alias("link_chars"),
    )
    # One row for each slot of a reference, however many pages it has.
    learned = stats.groupBy("host", "layout").agg(F.collect_list(F.struct("slot", "n", "varies", "run_varies", "chars", "link_chars")).alias("stats")).join(groups, ["host", "layout"])

    def judge(batches):
        for batch in batches:
            said = [template_slots(reference, {s["slot"]: tuple(s.values())[1:] for s in stats}) or (None, None) for stats, reference in zip(batch.column("stats").to_pylist(), batch.column("reference").to_pylist())]
            slots = [pa.array([x[k] for x in said], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "layout", "n", "reference")), *slots], names=["host", "layout", "n", "reference", "gone", "content"])

    judged = learned.mapInArrow(judge, "host string, layout long, n long, reference string, gone array<int>, content array<int>").filter("gone IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "layout", "reference", "gone", "content")))
    return judged.groupBy("host").agg(F.transform(ordered, lambda x: F.struct(x["layout"], x["reference"], x["gone"], x["content"])).alias("layouts"))


def from_json(text: str) -> dict:
    spec = json.loads(text)
    return {"constants": spec.get("constants"), "layouts": [list(x.values()) for x in spec.get("layouts") or ()]}


@tidy
def extract_pages(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    learned = wrappers(pages)
    if (learned.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= broadcast_bytes:
        learned = F.broadcast(learned)
    rows = split_url(pages.select("page_id", "url", "html")).join(learned, "host", "left")

    def make():
        known: dict[str | None, Wrapper] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for source, spec in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if spec not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[spec] = Wrapper(from_json(spec) if spec is not None else None)
                out.append(extract(source, known[spec], names))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return work

    return over_texts(rows, ["page_id", "url", "html", "wrapper"], make, f"page_id {type_of(pages, 'page_id')}, url string, text string, n_chars long")
