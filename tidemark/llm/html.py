"""Main text of web pages by union-free wrapper inference.

A page becomes a tree of block elements with runs of text between them; inline marks belong to the text. An element is known by
its path of keys (tag and class). For each path of a host the wrapper holds one regular expression without unions over the keys
of its children: the children's streams of all its elements on all pages are aligned one after the other, neighbours that
repeat (in periods of up to PERIOD keys) become a repeated group, what one side lacks becomes optional, and text is a slot. Equal streams
are counted first, different ones are aligned in order of their own, in groups by hash and then once more, so the wrapper
does not depend on how the pages are dealt over tasks, and no task holds a host's pages. An expression of more than LONGEST parts becomes
a repeated group of its keys, all optional, so it stays bounded.

From the expressions and counts by path the main region of a host follows: the first article or main element, else the
element down to which the text concentrates without being repeated. Each page gives the whole text of that region but for
elements that are boilerplate by their tag or role, and for those that bear a boilerplate name, if the wrapper agrees: if their text is the
same on different pages, or mostly links, or they are optional or repeat, or there is only one page text to judge by. A
boilerplate name is made of boilerplate words and words for a block's form or place alone (`share-buttons`, not `share-price`). A
name counts for nothing on elements that hold the first article, main or h1 element of the page. No other text is dropped, also not
what all pages of a host share.

A page that lacks its host's region is treated by its own wrapper. Null and empty pages give an empty text. Repeated rows are
treated each, an empty table gives no rows; pages of any length and depth are taken whole (no recursion).
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, staged

INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("script style noscript template head title svg iframe object canvas video audio map math".split())
BOILER = set("nav header footer aside form button select textarea menu dialog fieldset input".split())
_BOILER_NAME = re.compile(
    r"(?:^|[-_ ])(?:nav(?:bar|igation)?|menus?|header|masthead|footer|side-?bar|comments?|comment-?list|disqus|respon(?:d|ses)|notices?|cookies?|consent|gdpr|banner"
    r"|ads?|advert\w*|sponsor\w*|promo\w*|share|sharing|social|related|recommend\w*|breadcrumbs?|pop-?up|modal|overlay|subscribe|newsletter|signup|login"
    r"|search|widget|toolbar|pagination|pager|skip-?link|tags?|copyright|legal|discussion|replies)(?:$|[-_ ])", re.I)
#: Words that say of a block only what form it has or where it stands.
_FORM_WORDS = set("area bar block bottom box btn button buttons col column container content desktop entry form global group heading holder icon icons inner item items label left link links list main "
                  "mobile outer page panel post posts primary right row secondary section site sticky text title top wrap wrapper".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_TAG_START = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!?")
_LEAVES = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre".split())
PERIOD = 4  # longest run of neighbours that is looked for as a repeated group
LONGEST = 64  # a longer content model becomes a repeated group of optionals
KEYS = 512  # with more different keys it is one of tags
SHARE = 0.01  # what fewer of a host's pages have is left to the pages themselves
LINKED = 0.3  # share of link text that tells a menu
SALTS = 64




class Node:
    """A block element of a page. items: child Nodes and strings, in order; links: characters of its own text in links."""

    __slots__ = ("key", "tag", "hard", "named", "items", "parent", "path", "depth", "links", "chars", "anchor")

    def __init__(self, key: str, tag: str, hard: bool, named: bool, parent: Node | None):
        self.key, self.tag, self.hard, self.named, self.items, self.parent = key, tag, hard, named, [], parent
        self.links = self.chars = 0
        self.anchor = False
        self.depth = parent.depth + 1 if parent else 0
        self.path = _hash(f"{parent.path} {key}") if parent else 0


def boilerplate_name(name: str) -> bool:
    """Whether a class or id is made of boilerplate words, and of words of form beside them."""
    rest, found = name.lower(), False
    while m := _BOILER_NAME.search(rest):
        found, rest = True, f"{rest[: m.start()]}-{rest[m.end() :]}"
    return found and all(not w or w in _FORM_WORDS or w.isdigit() for w in re.split(r"[-_ ]", rest))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(page: str) -> list[Node]:
    """The page's elements in page order, the root first."""
    root = Node("", "", False, False, None)
    order, stack, run, at = [root], [root], [], 0
    opened: dict[str, int] = {}
    in_link = 0

    def flush():
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                stack[-1].items.append(text)

    def close(depth):
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        if m[4] == "<" and page[at : at + 1] and page[at] in _TAG_START:  # a tag with odd quotes, or one that never ends
            at = page.find(">", at) + 1
            if not at:
                break
            continue
        if m[4] is not None:
            run.append(m[4])
            if in_link > 0:
                stack[-1].links += len(m[4].strip())
            continue
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in HIDDEN and tag != "head":
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        flush()
        in_link = 0
        if closing:
            if opened.get(tag):
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
            continue
        closes = _CLOSES.get(tag, ())
        if stack[-1].tag in closes or tag in _ENDS_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag == "hr":
            continue
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])} if m[3] else {}
        name = " ".join(attrs[k] for k in ("class", "id") if attrs.get(k))
        within = opened.get("article") or opened.get("main")
        hard = tag in BOILER and not (tag == "header" and within) or tag == "head" or attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        named = bool(name) and any(map(boilerplate_name, name.split()))
        node = Node(f"{tag}.{_DIGITS.sub('#', name)}" if name else tag, tag, hard, named, stack[-1])
        stack[-1].items.append(node)
        order.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    _measure(order)
    return order


_DIGITS = re.compile(r"[0-9]+")


def _measure(order: list[Node]) -> None:
    """Characters by element without those of boilerplate tags in it, and the elements that hold the first article or main, or the first h1."""
    for found in (("article", "main"), ("h1",)):
        node = next((n for n in order if n.tag in found and not _hidden(n)), None)
        while node is not None:
            node.anchor = True
            if node.tag == "form":
                node.hard = False  # a form around the whole page
            node = node.parent
    for node in reversed(order):
        node.chars += sum(len(x) for x in node.items if isinstance(x, str))
        if node.parent is not None and not node.hard:
            node.parent.chars += node.chars
            node.parent.links += node.links


def _hidden(node: Node) -> bool:
    """Whether the node lies in boilerplate by tag; forms may be those around a page."""
    while node is not None:
        if node.hard and node.tag != "form":
            return True
        node = node.parent
    return False


# A content model is a list of (key, optional, repeated); a text run has the key "#text".
def fold(kids: list[tuple]) -> list[tuple]:
    """Neighbours that repeat, singly or with a period of up to PERIOD, become one group."""
    for period in range(1, PERIOD + 1):
        if len(kids) <= period:
            break
        out: list[tuple] = []
        i = 0
        while i < len(kids):
            if len(out) >= period and i + period <= len(kids) and all(out[j - period][0] == kids[i + j][0] for j in range(period)) and (
                    period == 1 or len({x[0] for x in out[-period:]}) > 1):
                for j in range(period):
                    k, o, _ = out[j - period]
                    out[j - period] = (k, o | kids[i + j][1], 1)
                i += period
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return bounded(kids)


def bounded(kids: list[tuple]) -> list[tuple]:
    """Past LONGEST parts: a repeated group of the different keys, all optional; past KEYS keys, of their tags."""
    if len(kids) <= LONGEST:
        return kids
    keys = {k for k, _, _ in kids}
    if len(keys) > KEYS:
        keys = {k.split(".")[0] for k in keys}
    return [("*", 1, 1), *((k, 1, 1) for k in sorted(keys - {"*"}))]


def align(x: list[tuple], y: list[tuple]) -> list[tuple]:
    """The expression of both: the longest common run of keys in order, what one side lacks optional."""
    if x and x[0][0] == "*" or y and y[0][0] == "*":
        both = bounded([*x, *y, *[("*", 1, 1)] * LONGEST])
        return both
    if [k for k, _, _ in x] == [k for k, _, _ in y]:
        return [(k, o | p, r | q) for (k, o, r), (_, p, q) in zip(x, y, strict=True)]
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            out.append((x[i][0], x[i][1] | y[j][1], x[i][2] | y[j][2]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((x[i][0], 1, x[i][2]))
            i += 1
        else:
            out.append((y[j][0], 1, y[j][2]))
            j += 1
    return fold(out)


FIELDS = "host string, path long, model string, parent long, key string, tag string, named boolean, depth int, pages long, chars long, links long, lo long, hi long, anchor long, times long"
_MERGED = ("pages", "chars", "links", "anchor", "times")  # summed


def elements(order: list[Node]) -> dict[tuple[int, str], list]:
    """(path, content model) -> [parent, key, tag, named, depth, pages, chars, links, lo, hi, anchor, times] of one page.

    lo and hi are the least and greatest hash of the texts of the path, kept for the root and for elements with a boilerplate name."""
    rows: dict[tuple[int, str], list] = {}
    seen: set[int] = set()
    hidden: set[int] = set()
    for node in order:
        if node.hard or node.parent is not None and id(node.parent) in hidden:
            hidden.add(id(node))
            continue
        model = json.dumps(fold([("#text" if isinstance(x, str) else x.key, 0, 0) for x in node.items if isinstance(x, str) or not x.hard]))
        text = _hash(" ".join(texts_of(node, None))) if node.named or node.parent is None else 0
        row = rows.get((node.path, model))
        if row is None:
            row = rows[(node.path, model)] = [node.parent.path if node.parent else 0, node.key, node.tag, node.named, node.depth, 0, 0, 0, text, text, 0, 0]
        if node.path not in seen:
            seen.add(node.path)
            row[5] += 1
        row[6] += node.chars
        row[7] += min(node.links, node.chars)
        row[8], row[9] = min(row[8], text), max(row[9], text)
        row[10] += node.anchor
        row[11] += 1
    return rows


def texts_of(top: Node, kept: set[int] | None) -> list[str]:
    """The runs of text in an element, in page order, without boilerplate; kept None: without that of tags alone."""
    out: list[str] = []
    stack = [iter(top.items)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                out.append(x)
            elif not x.hard and (kept is None or not x.named or x.anchor or x.path in kept):
                stack.append(iter(x.items))
                break
        else:
            stack.pop()
    return out


def choose(rows: list[tuple]) -> tuple[int, list[int]]:
    """Path of the main region, and the paths with a boilerplate name that are content, from a host's
    rows (path, model, parent, key, tag, named, depth, pages, chars, links, lo, hi, anchor, times), one a path."""
    of = {r[0]: r for r in rows}
    root = of[0]
    models = {r[0]: json.loads(r[1]) for r in rows}
    # an expression that grew too long marks all its keys; what repeats in it then shows in the numbers of elements and pages
    often = {r[0] for r in rows if r[13] > r[7]}
    bound = {path for path, model in models.items() if model and model[0][0] == "*"}
    repeats = {_hash(f"{path} {k}") for path, model in models.items() if path not in bound for k, _, r in model if r} | {p for p in often if of[p][2] in bound}
    inner = {path for path, model in models.items() if path not in bound and any(r for _, _, r in model)} | {of[p][2] for p in often if of[p][2] in bound}
    single = root[10] == root[11]

    def boilerplate(r):
        path, _, parent, _, _, named, _, pages, chars, links, lo, hi, anchor, _ = r
        if not named or anchor or not path:
            return False
        return single or lo == hi or links >= LINKED * chars or parent not in of or pages < of[parent][7] or path in repeats or path in inner

    alive, loss, kids = {0}, dict.fromkeys(of, 0), {p: [] for p in of}
    down = sorted((r for r in rows if r[0]), key=lambda r: r[6])
    for r in down:
        if r[2] in alive and not boilerplate(r):
            alive.add(r[0])
        if r[2] in kids:
            kids[r[2]].append(r[0])
    for r in reversed(down):
        if r[2] in loss:
            loss[r[2]] += loss[r[0]] if r[0] in alive else r[8]
    weight = {p: of[p][8] - loss[p] for p in of}
    firsts = [p for p in alive if of[p][4] in ("article", "main") and of[p][12]]
    best = max(firsts, key=lambda p: (weight[p], -of[p][6], p), default=None)
    node = best or 0
    while True:
        if best and of[node][4] != "main":
            break
        least = (0.8 if best else 0.5) * weight[node]
        narrower = [p for p in kids[node] if p in alive and of[p][4] not in _LEAVES and p not in repeats and weight[p] >= least > 0]
        if not narrower:
            break
        node = max(narrower, key=lambda p: (weight[p], p))
    return node, sorted(p for p in alive if of[p][5] and not of[p][12])


def extract(page: str | None, region: int | None, kept: list[int] | None) -> str:
    if not page:
        return ""
    order = parse(page)
    found = _at(order, region) if region is not None else []
    if not found:  # by the page's own wrapper
        merged: dict[int, tuple] = {}
        for (path, model), row in elements(order).items():
            merged[path] = _joined(merged[path], (path, model, *row)) if path in merged else (path, model, *row)
        region, kept = choose(list(merged.values()))
        found = _at(order, region)
    names = set(kept or ())
    return _SPACE.sub(" ", " ".join(t for node in found for t in texts_of(node, names))).strip()


def _at(order: list[Node], region: int) -> list[Node]:
    """The elements of a path, but those in boilerplate by tag."""
    return [n for n in order if n.path == region and not _hidden(n) and not n.hard]


def _joined(a: tuple, b: tuple) -> tuple:
    """One row of a path from two: models aligned, counts summed."""
    return (a[0], json.dumps(align([tuple(x) for x in json.loads(a[1])], [tuple(x) for x in json.loads(b[1])])), *a[2:7],
            a[7] + b[7], a[8] + b[8], a[9] + b[9], min(a[10], b[10]), max(a[11], b[11]), a[12] + b[12], a[13] + b[13])


def _batch(names: list[str], kinds: list[pa.DataType], rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[] for _ in kinds], kinds, strict=True)], names=names)


_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]] for f in FIELDS.split(", ")]
ROWS = 20_000


def _elements(batches):
    """A row for each (host, path, content model), summed over some pages."""
    found: dict[tuple, list] = {}

    def rows():
        out = _batch(_NAMES, _KINDS, [(*k, *v) for k, v in found.items()])
        found.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = page.as_py()
            if not text:
                continue
            for (path, model), row in elements(parse(text)).items():
                have = found.setdefault((host, path, model), row)
                if have is not row:
                    for k in (5, 6, 7, 10, 11):
                        have[k] += row[k]
                    have[8], have[9] = min(have[8], row[8]), max(have[9], row[9])
            if len(found) > ROWS:
                yield rows()
    yield rows()


def _aligned(batches):
    """Rows sorted by host, salt, path, model -> one row for each host, salt and path."""
    last, out = None, []
    for batch in batches:
        for host, salt, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = tuple(row)
            if last is not None and last[:2] == (host, salt) and last[2][0] == row[0]:
                last = (host, salt, _joined(last[2], row))
                continue
            if last is not None:
                out.append((last[0], *last[2]))
            last = (host, salt, row)
            if len(out) > ROWS:
                yield _batch(_NAMES, _KINDS, out)
                out = []
    if last is not None:
        out.append((last[0], *last[2]))
    yield _batch(_NAMES, _KINDS, out)


def _chosen(batches):
    """Rows sorted by host -> host, region, kept."""
    host, rows, out = None, [], []
    for batch in batches:
        for h, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and h != host:
                out.append((host, *choose(rows)))
                rows = []
            host = h
            rows.append(tuple(row))
    if rows:
        out.append((host, *choose(rows)))
    yield _batch(["host", "region", "kept"], [pa.string(), pa.int64(), pa.list_(pa.int64())], out)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, region long, kept array<long> from all pages(host, html)."""
    fields = [F.col(c) for c in _NAMES]
    keys = [c for c in _NAMES if c not in (*_MERGED, "lo", "hi")]
    counted = staged(pages.select("host", "html").mapInArrow(_elements, FIELDS).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _MERGED], F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*fields), "elements")
    # Paths that few of a host's pages have can't be its region; without them a host has at most 1 / SHARE times the paths of a page.
    total = counted.where("depth = 0").groupBy("host").agg(F.sum("pages").alias("host_pages"))
    often = counted.groupBy("host", "path").agg(F.sum("pages").alias("n")).join(total, "host").where(F.col("n") >= F.col("host_pages") * SHARE).select("host", "path")
    some = counted.join(often, ["host", "path"], "left_semi").select(*fields)

    def aligned(df, salt):
        rest = [c for c in _NAMES if c != "host"]
        rows = df.select("host", salt.cast("int").alias("salt"), *rest)
        return rows.repartition("host", "salt", "path").sortWithinPartitions("host", "salt", "path", "model").mapInArrow(_aligned, FIELDS)

    by_salt = staged(aligned(some, F.pmod(F.xxhash64("model"), F.lit(SALTS))), "models")
    whole = aligned(by_salt, F.lit(0))
    return whole.repartition("host").sortWithinPartitions("host", "path").mapInArrow(_chosen, "host string, region long, kept array<long>")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    wrappers = staged(infer_wrappers(rows), "hosts")

    def run(batches):
        for batch in batches:
            text = [extract(h, p, s) for h, p, s in zip(batch.column("html").to_pylist(), batch.column("region").to_pylist(), batch.column("kept").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.join(bounded_broadcast(wrappers, 50_000), "host", "left").select("page_id", "url", "html", "region", "kept").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
