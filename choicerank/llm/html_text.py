"""Main text of web pages by wrapper induction: simple tree matching of the pages of a host.

A page becomes a tree of its blocks. Elements that say what they are (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, comments) are left out, and where a page has an article, the article is the page. Elements more than
``DEPTH`` levels down add their blocks to the one above. First the pages of a host are counted on which a text stands below
the same path of elements; only texts that reach the share of the pages go on, all others are content. Pages of a host with
the same sequence of blocks are copies and count as one. The trees of these texts are aligned by simple tree matching, child
by child, and folded into one wrapper: a tree of slots, each with its text and the pages it was seen on. Texts are only
aligned with equal ones, so that constant texts hold their places however much text that varies lies between them. Slots
seen on most pages of the host are template and are cut out, unless nothing of the host's pages varies at all.

What is shuffled are hashes of texts, and the trees of the texts that are frequent. Wrappers are folded in each task, and
folds of the same host are merged in two steps, so no task sees more of a host than its share of pages or a bounded number
of folds. Pages are not shuffled unless the table of wrappers that have template slots is too large to broadcast.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import Work, slices
from choicerank.llm.urls import host

#: Pages a template slot must have been seen on, and the share of the host's pages.
SUPPORT, SHARE = 5, 0.5
#: Hosts a task folds at a time, and parts into which the folds of a host are merged first.
HOSTS, PARTS = 2_000, 32
#: Levels of elements that are told apart; deeper ones lose their place in the tree, not their text.
DEPTH = 100

# Elements by their role in a page.
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby "
                    "s samp small span strike strong sub sup svg time tt u var wbr canvas audio video object math mi mn mo ms mrow "
                    "mtext msup msub msubsup mfrac msqrt mroot mfenced mstyle mpadded mphantom semantics annotation "
                    "g path text tspan circle ellipse rect polygon polyline defs use").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
LEFT_OUT = frozenset(("head script style noscript template textarea title iframe nav header footer aside form "
                      "button select input dialog menu noembed noframes").split())
NOISE = frozenset(("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
                   "cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
                   "popup promo promoted related reply replies respond share sharing sidebar skip social sponsor sponsored "
                   "subscribe teaser toolbar widget").split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: An open element of the key's kind ends where one of its values begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
        "th": {"td", "th", "tr"}, "option": {"option"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

Node = list  # [label, children]; a child is a node or a text


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def _is_noise(tag: str, given: dict[str, str]) -> bool:
    if tag in LEFT_OUT or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    if given.get("role", "").lower() in ROLES:
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    names = re.split(r"[^a-z]+", f"{given.get('class', '')} {given.get('id', '')}".lower())
    return not NOISE.isdisjoint(names)


def parse(source: str) -> Node:
    """The tree of blocks. Inline elements are part of their block's text; left-out elements are not in it."""
    root: Node = ["#page", []]
    stack: list[tuple[str, Node, bool]] = [("#page", root, True)]  # tag, block it adds to, shown
    opened: Counter[str] = Counter()
    at, deepest = 0, 1
    text: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                stack[-1][1][1].append(words)

    def close(depth: int) -> None:
        """Leave all elements from the given depth on."""
        while len(stack) > depth:
            tag, _, shown = stack[-1]
            if shown and tag not in INLINE:
                flush()
            opened[tag] -= 1
            stack.pop()

    def enter(tag: str, block: Node, shown: bool) -> None:
        opened[tag] += 1
        stack.append((tag, block, shown))

    size = len(source)
    while at < size:
        found = _TAG.search(source, at)
        begin = found.start() if found else size
        if begin > at and stack[-1][2]:
            text.append(source[at:begin])
        if not found:
            break
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if found[1] or found[4]:  # an end tag
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if stack[depth][0] not in INLINE and tag in INLINE:
                    break
            continue
        rest = found[3] or found[6] or ""
        if tag == "br" and stack[-1][2]:
            text.append(" ")
        if tag in VOID:
            if tag not in INLINE and stack[-1][2]:
                flush()
            continue
        given = _attributes(rest) if rest.strip(" /") else {}
        if tag not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the one before
                outer = stack[depth][0]
                if outer == "p" or tag in ENDS.get(outer, ()):
                    close(depth)
                    break
                if outer not in INLINE:
                    break
        block, shown = stack[-1][1], stack[-1][2]
        noise = not shown or _is_noise(tag, given)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if rest.rstrip().endswith("/") and tag not in INLINE and tag in LEFT_OUT:
            continue
        if noise:
            if shown and tag not in INLINE:
                flush()
            enter(tag, block, False)
        elif tag in INLINE:
            enter(tag, block, True)
        else:
            flush()
            names = " ".join(sorted(set(given.get("class", "").split())))
            if given.get("role", "").lower() == "main":
                tag_label = "main"
            else:
                tag_label = tag
            node: Node = [f"{tag_label}.{names}" if names else tag_label, []]
            block[1].append(node)
            enter(tag, node, True)
        deepest = max(deepest, len(stack))
    close(1)
    flush()
    return _shallow(_main(root)) if deepest >= DEPTH else _main(root)


def _main(root: Node) -> Node:
    """The outermost articles, else the outermost main elements, else the page."""
    for wanted in ("article", "main"):
        found: list[Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node[0].split(".")[0] == wanted:
                found.append(node)
            else:
                todo.extend(c for c in reversed(node[1]) if not isinstance(c, str))
        if any(_has_text(n) for n in found):
            return ["#page", found]
    return root


def _has_text(node: Node) -> bool:
    todo = [node]
    while todo:
        for child in todo.pop()[1]:
            if isinstance(child, str):
                return True
            todo.append(child)
    return False


def _shallow(root: Node) -> Node:
    """The same texts in the same order, at most ``DEPTH`` levels down: deeper ones move to the last element above them."""
    out: Node = [root[0], []]
    stack = [(out, iter(root[1]))]
    while stack:
        node, children = stack[-1]
        for child in children:
            if isinstance(child, str):
                node[1].append(child)
                continue
            inner = node
            if len(stack) < DEPTH:
                inner = [child[0], []]
                node[1].append(inner)
            stack.append((inner, iter(child[1])))
            break
        else:
            stack.pop()
    return out


# A slot is [label, pages, text, slots, place]; of an element, text tells whether other texts were left out below it.
# The place is the one among the children of the slot's first page.
Slot = list


def _code(path: int, text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


def _below(path: int, label: str) -> int:
    """The code of a path of elements that goes on."""
    return _code(path, f"/{label}")


def text_codes(node: Node, path: int = 0) -> Iterator[int]:
    """A hash of each text with the path of elements it lies below, in page order."""
    path = _below(path, node[0])
    for child in node[1]:
        if isinstance(child, str):
            yield _code(path, child)
        else:
            yield from text_codes(child, path)


def wrapper_of(node: Node, wanted: Callable[[int, str], bool] = lambda path, text: True, path: int = 0,
               place: int = 0) -> Slot:
    """The tree of the texts that are wanted, by path and text."""
    path = _below(path, node[0])
    slots, left_out = [], False
    for i, child in enumerate(node[1]):
        if not isinstance(child, str):
            slot = wrapper_of(child, wanted, path, i)
            if slot[3]:
                slots.append(slot)
            else:
                left_out |= slot[2]
        elif wanted(path, child):
            slots.append(["#text", 1, child, [], i])
        else:
            left_out = True
    return [node[0], 1, left_out, slots, place]


def _weight(a: Slot, b: Slot) -> int:
    """Simple tree matching: how many slots of two trees can be aligned in order. Trees without a common text cannot."""
    if a[0] != b[0]:
        return 0
    if a[0] == "#text":
        return int(a[2] == b[2])
    below = sum(w for _, _, w in _aligned(a[3], b[3]))
    return below and 1 + below


def _size(a: Slot, b: Slot) -> int:
    """The weight of two equal trees, 0 if they are not equal."""
    if a[0] != b[0] or len(a[3]) != len(b[3]):
        return 0
    if a[0] == "#text":
        return int(a[2] == b[2])
    total = 1
    for x, y in zip(a[3], b[3]):
        size = _size(x, y)
        if not size:
            return 0
        total += size
    return total


def _aligned(a: list[Slot], b: list[Slot]) -> list[tuple[int, int, int]]:
    """Pairs of places of the heaviest alignment in order, with their weights."""
    out, tail, begin, n, m = [], [], 0, len(a), len(b)
    # Nothing is heavier than equal trees at either end.
    while begin < min(n, m) and (size := _size(a[begin], b[begin])):
        out.append((begin, begin, size))
        begin += 1
    while min(n, m) > begin and (size := _size(a[n - 1], b[m - 1])):
        n, m = n - 1, m - 1
        tail.append((n, m, size))
    if begin < min(n, m):
        weights = [[_weight(x, y) for y in b[begin:m]] for x in a[begin:n]]
        rows, columns = n - begin, m - begin
        best = [[0] * (columns + 1) for _ in range(rows + 1)]
        for i in range(rows - 1, -1, -1):
            for j in range(columns - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + weights[i][j])
        i, j = 0, 0
        while i < rows and j < columns:
            if weights[i][j] and best[i][j] == best[i + 1][j + 1] + weights[i][j]:
                out.append((begin + i, begin + j, weights[i][j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return out + tail[::-1]


def merged(a: Slot, b: Slot) -> Slot:
    """One wrapper out of two with the same label; slots that only one has keep their pages.

    No slot is dropped: what is folded are texts that stand on enough pages, so a wrapper is bounded by those of a host.
    """
    slots, i, j = [], 0, 0
    for p, q, _ in _aligned(a[3], b[3]):
        slots += a[3][i:p] + b[3][j:q]
        slots.append(merged(a[3][p], b[3][q]))
        i, j = p + 1, q + 1
    slots += a[3][i:] + b[3][j:]
    return [a[0], a[1] + b[1], a[2] if a[0] == "#text" else a[2] or b[2], slots, a[4]]


def _is_template(slot: Slot, pages: int) -> bool:
    return slot[0] == "#text" and slot[1] >= SUPPORT and slot[1] >= SHARE * pages


def _is_title(label: str) -> bool:
    """A heading of the first level names the page, also where all pages have the same name."""
    return label.split(".")[0] == "h1"


def has_template(wrapper: Slot) -> bool:
    """Does it have a template slot beside texts that vary?"""
    state = {"template": False, "varies": False}

    def walk(slot: Slot, title: bool) -> None:
        if slot[0] != "#text":
            state["varies"] |= slot[2]
        elif not _is_template(slot, wrapper[1]):
            state["varies"] = True
        elif not title:
            state["template"] = True
        for child in slot[3]:
            walk(child, title or _is_title(child[0]))

    walk(wrapper, False)
    return state["template"] and state["varies"]


def _texts(slot: Slot) -> Iterator[str]:
    if slot[0] == "#text":
        yield slot[2]
    for child in slot[3]:
        yield from _texts(child)


def blocks(node: Node, wrapper: Slot | None = None) -> list[str]:
    """Texts of the blocks in page order, without those that lie in template slots of the wrapper."""
    out: list[str] = []

    def walk(node: Node, own: Slot | None, slot: Slot | None) -> None:
        partner: dict[int, tuple[Slot, Slot]] = {}
        if slot is not None:
            partner = {own[3][i][4]: (own[3][i], slot[3][j]) for i, j, _ in _aligned(own[3], slot[3])}
        for i, child in enumerate(node[1]):
            inside, mate = partner.get(i, (None, None))
            if not isinstance(child, str):
                walk(child, *((None, None) if _is_title(child[0]) else (inside, mate)))
            elif mate is None or not _is_template(mate, wrapper[1]):
                out.append(child)

    if wrapper is None:
        walk(node, None, None)
    else:
        known = set(_texts(wrapper))
        walk(node, wrapper_of(node, lambda path, text: text in known), wrapper)
    return out


def main_text(source: str, wrapper: Slot | None = None) -> str:
    return "\n".join(blocks(parse(source or ""), wrapper))


def page_code(node: Node) -> bytes:
    """A hash of the sequence of a page's blocks: equal for copies."""
    import xxhash

    digest = xxhash.xxh3_128()
    for code in text_codes(node):
        digest.update((code + (1 << 63)).to_bytes(8, "little"))
    return digest.digest()


def frequent_texts(rows: DataFrame, work: Work) -> DataFrame:
    """``host``, ``codes`` of the texts that stand on enough pages of the host to be template; hosts with such texts.

    ``rows`` has ``host`` and ``html``. Copies of a page count once: what is shuffled is a hash a page and one a text, and
    of copies only one goes on. The codes of a host are about twice as many as its pages have texts, at most.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                trees = [parse(source) for source in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("host"), pa.array([page_code(t) for t in trees], pa.binary()),
                     pa.array([sorted(set(text_codes(t))) for t in trees], pa.list_(pa.int64()))], ["host", "page", "codes"])

    distinct = rows.select("host", "html").mapInArrow(cut, "host string, page binary, codes array<bigint>").dropDuplicates(
        ["host", "page"])
    # A null code counts the pages.
    found = distinct.select("host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "codes")).alias("code"))
    found = found.groupBy("host", "code").agg(F.count("*").alias("pages")).filter(F.col("pages") >= SUPPORT)
    found = work.store(found, "texts")
    every = found.filter("code is null").select("host", F.col("pages").alias("every"))
    return (found.filter("code is not null").join(every, "host").filter(F.col("pages") >= SHARE * F.col("every"))
            .groupBy("host").agg(F.collect_list("code").alias("codes")))


def induce(pages: DataFrame, html_column: str = "html", site: str = "host") -> DataFrame:
    """``host``, ``wrapper`` (as JSON) of all hosts whose pages share template slots."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, frozenset[int]] = {}
        for batch in batches:
            for piece in slices(batch, "html"):
                pages, trees = [], []
                for k, (name, source) in enumerate(zip(piece.column("host").to_pylist(), piece.column("html").to_pylist())):
                    if name not in codes:
                        if len(codes) >= HOSTS:
                            codes.clear()
                        codes[name] = frozenset(piece.column("codes")[k].as_py())
                    own, tree = codes[name], parse(source)
                    pages.append(page_code(tree))
                    trees.append(json.dumps(wrapper_of(tree, lambda path, text: _code(path, text) in own)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("host"), pa.array(pages, pa.binary()), pa.array(trees, pa.string())],
                    ["host", "page", "tree"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % PARTS
        held: dict[str, Slot] = {}

        def out() -> pa.RecordBatch:
            rows = {"host": list(held), "part": [part] * len(held), "wrapper": [json.dumps(w) for w in held.values()]}
            held.clear()
            return pa.RecordBatch.from_pydict(rows, pa.schema([("host", pa.string()), ("part", pa.int32()),
                                                               ("wrapper", pa.string())]))

        for batch in batches:
            for name, tree in zip(batch.column("host").to_pylist(), batch.column("tree").to_pylist()):
                page = json.loads(tree)
                held[name] = merged(held[name], page) if name in held else page
                if len(held) >= HOSTS:
                    yield out()
        yield out()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for found in frame["wrapper"]:
            total = json.loads(found) if total is None else merged(total, json.loads(found))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "part": [0], "wrapper": [json.dumps(total)]})

    rows = pages.select(F.col(site).alias("host"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    schema = "host string, part int, wrapper string"
    work = Work(pages.sparkSession)
    frequent = work.store(frequent_texts(rows, work), "frequent")
    trees = rows.join(frequent, "host").mapInArrow(prune, "host string, page binary, tree string")
    folds = trees.dropDuplicates(["host", "page"]).mapInArrow(fold, schema)
    folds = folds.groupBy("host", "part").applyInPandas(merge, schema).groupBy("host").applyInPandas(merge, schema)

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_template(json.loads(w)) for w in batch.column(1).to_pylist()], pa.bool_()))

    return folds.select("host", "wrapper").mapInArrow(useful, "host string, wrapper string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` (blocks joined by a line feed), ``n_chars`` of every page.

    A null html is empty; a page without main text has an empty one. Pages without a host are a host of their own,
    the empty one. Repeated rows stay, and count as one page where template is learned; other columns are not read.
    """
    work = Work(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host(F.col(url)).alias("host"),
                        F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    wrappers = work.store(induce(rows), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Slot] = {}
        for batch in batches:
            for piece in slices(batch, "html"):
                found = []
                for source, wrapper in zip(piece.column("html").to_pylist(), piece.column("wrapper").to_pylist()):
                    if wrapper is not None and wrapper not in seen:
                        if len(seen) >= HOSTS:
                            seen.clear()
                        seen[wrapper] = json.loads(wrapper)
                    found.append(main_text(source, seen.get(wrapper)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), piece.column("url"), pa.array(found, pa.string()),
                     pa.array([len(t) for t in found], pa.int64())], ["key", "url", "text", "n_chars"])

    schema = f"key {dict(rows.dtypes)['key']}, url string, text string, n_chars bigint"
    return rows.join(wrappers, "host", "left").select("key", "url", "html", "wrapper").mapInArrow(
        run, schema).withColumnRenamed("key", key)
