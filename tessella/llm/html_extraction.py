"""HTML extraction: templates deduced from equivalence classes of tokens on the pages of a host; the main slots are extracted."""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stage

#: Template rows (a host each) that may be broadcast.
BROADCAST_HOSTS = 50_000
#: Words that a task counts at once before it tells which are frequent among the pages that it has read.
COUNTED_WORDS = 400_000
#: Pages of a host from which on what they have in common is told from what chance repeats.
LEAST_PAGES = 3

# Element names of HTML by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe math noembed noframes noscript object script select style svg template textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": (), "thead": ("table",), "tbody": ("table",)}
OUTSIDE = frozenset("aside button dialog footer form head menu nav".split())
MAIN = ("article", "main")
PARTS = frozenset("address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody tfoot th thead tr ul".split())
_OUT_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumbs?|side-?bar|comments?|replies|reply|respond|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|footer|header|masthead|widget|pagination|pager|toolbar|skip-?link)(?:$|[-_\s])",
    re.I,
)
# The head of an article, by class; within an article every such name is one.
_OWN_HEADER = re.compile(r"(?:^|(?<=\s))(?:article|entry|post|story|content)[-_]+header(?=$|[-_\s])", re.I)
_ANY_HEADER = re.compile(r"(?:^|(?<=[-_\s]))header(?=$|[-_\s])", re.I)
_MAIN_NAME = re.compile(r"(?:^|[-_\s])(?:article|articlebody|post|entry|story|content|main)(?:$|[-_\s])", re.I)
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Element:
    label: str  # its name, and its class or id
    token: int  # a hash of the labels from the root down to it
    depth: int
    parent: int
    outside: bool  # by its name, role or class no part of an article
    main: int  # 2: an article by name, 1: by class
    by_class: bool = False  # outside by its class alone
    chars: int = 0  # of the text below it
    linked: int = 0  # of these, inside links


@dataclass
class Page:
    """The elements of a page in order, and its text runs as (element, text, whether in a link); an empty text ends a block."""

    elements: list[Element] = field(default_factory=list)
    runs: list[tuple[int, str, bool]] = field(default_factory=list)


def _below(token: int, label: str) -> int:
    return xxhash.xxh64_intdigest(f"{token}>{label}".encode("utf-8", "surrogatepass")) - 2**63


def parse(source: str | None) -> Page:
    """Elements and text runs of a page, however broken: an end tag without a start is passed over, open elements end with the page."""
    page = Page([Element("#", 0, 0, -1, False, 0)])
    source = source or ""
    stack, links, at, size = [(0, "#")], 0, 0, len(source)
    opened: dict[str, int] = {}

    def add_text(part: str) -> None:
        text = html_lib.unescape(part)
        if text:
            page.runs.append((stack[-1][0], text, bool(links)))
            own = page.elements[stack[-1][0]]
            own.chars += len(text.strip())
            own.linked += len(text.strip()) if links else 0

    def end_block() -> None:
        page.runs.append((stack[-1][0], "", False))

    def close(k: int) -> None:
        end_block()
        for _, name in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    while at < size:
        m = _TOKEN.search(source, at)
        if not m:
            add_text(source[at:])
            break
        if m.start() > at:
            add_text(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in INLINE:
            if name == "br":
                page.runs.append((stack[-1][0], " ", False))
            elif name == "a":
                links = 0 if ending else 1
            continue
        if ending:
            if opened.get(name):
                close(max(k for k in range(len(stack)) if stack[k][1] == name) if stack[-1][1] != name else len(stack) - 1)
            else:
                end_block()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at) if not attributes.rstrip().endswith("/") else None
            if end or not attributes.rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if name in CLOSES_P and stack[-1][1] == "p":
            close(len(stack) - 1)
        for k in range(len(stack) - 1, 0, -1) if opened.get(name) or name in ("dt", "dd", "td", "th") else ():
            if name not in SAME_CLOSES or stack[k][1] in SAME_CLOSES[name]:
                break
            if stack[k][1] == name or {stack[k][1], name} in ({"dt", "dd"}, {"td", "th"}):
                close(k)
                break
        end_block()
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        given = {k.lower(): html_lib.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        names = f"{given.get('class', '')} {given.get('id', '')}"
        shown = " ".join(sorted(given.get("class", "").split())) or given.get("id", "")
        label = f"{name}.{shown}" if shown else name
        parent = stack[-1][0]
        within = any(opened.get(n) for n in MAIN)
        outside = name in OUTSIDE or given.get("role", "") in _OUT_ROLE or "hidden" in attributes.lower().split()
        if name == "header":
            outside = outside or not within
        own = (_ANY_HEADER if within else _OWN_HEADER).sub(" ", names)
        by_class = not outside and name not in ("html", "body", *MAIN) and not (name == "header" and within) and bool(_OUT_NAME.search(own))
        main = 2 if name in MAIN or given.get("role") == "main" or given.get("itemprop") == "articleBody" else 1 if _MAIN_NAME.search(_OWN_HEADER.sub(" ", names)) else 0
        above = page.elements[parent]
        page.elements.append(Element(label, _below(above.token, label), above.depth + 1, parent, outside or by_class, main, by_class))
        stack.append((len(page.elements) - 1, name))
        opened[name] = opened.get(name, 0) + 1
    for e in reversed(page.elements[1:]):  # children come after their parents
        page.elements[e.parent].chars += e.chars
        page.elements[e.parent].linked += e.linked
    _keep_wrappers(page)
    return page


def _keep_wrappers(page: Page) -> None:
    """A class alone doesn't put an element outside that holds the page's article, or most of its text outside links where no article by name holds a fifth of it.

    The article is that by name within the fewest elements that are outside by class, then the one with most text outside links.
    """
    elements = page.elements
    if not any(e.by_class for e in elements):
        return
    hard, soft = [], []  # whether outside by more than a class; how many are outside by class, from the root down
    for e in elements:  # parents come first
        hard.append(e.parent >= 0 and hard[e.parent] or e.outside and not e.by_class)
        soft.append((soft[e.parent] if e.parent >= 0 else 0) + e.by_class)
    free = [0 if hard[i] else e.chars - e.linked for i, e in enumerate(elements)]
    whole = sum(len(t.strip()) for i, t, linked in page.runs if not linked and not hard[i])
    article = max(((-soft[i], free[i], i) for i, e in enumerate(elements) if e.main == 2 and not hard[i] and free[i] and 5 * free[i] >= whole), default=(0, 0, 0))[2]
    if article:
        while article > 0:
            keep = elements[article]
            keep.outside, article = keep.outside and not keep.by_class, keep.parent
        return
    for i, e in enumerate(elements):
        if e.by_class and 2 * free[i] > whole:
            e.outside = False


def _is_outside(page: Page | Read) -> list[bool]:
    out: list[bool] = []
    for e in page.elements:  # parents come first
        out.append(e.outside or (e.parent >= 0 and out[e.parent]))
    return out


def _blocks(page: Page) -> list[tuple[int, list[str], int]]:
    """(element, words, characters outside links) of the blocks of text of a page; a block never goes beyond its element."""
    out, held, free = [], [], 0
    for i, text, linked in [*page.runs, (0, "", False)]:
        if text:
            held.append(text)
            at, free = i, free + (0 if linked else len(text.strip()))
        elif held:
            words = "".join(held).split()
            if words:
                out.append((at, words, free))
            held, free = [], 0
    return out


@dataclass
class Read:
    """What later passes need of a page: its elements and its blocks of text as (element, words, characters outside links)."""

    elements: list[Element]
    blocks: list[tuple[int, list[str], int]]

    def dumps(self) -> str:
        elements = [(e.label, e.parent, e.outside, e.main, e.chars, e.linked) for e in self.elements[1:]]
        return json.dumps([elements, [(i, " ".join(words), free) for i, words, free in self.blocks]], ensure_ascii=True, separators=(",", ":"))

    @classmethod
    def loads(cls, data: str) -> Read:
        elements = [Element("#", 0, 0, -1, False, 0)]
        given, blocks = json.loads(data)
        for label, parent, outside, main, chars, linked in given:
            above = elements[parent]
            elements.append(Element(label, _below(above.token, label), above.depth + 1, parent, outside, main, False, chars, linked))
        return cls(elements, [(i, text.split(" "), free) for i, text, free in blocks])


def read(source: str | None) -> Read:
    page = parse(source)
    return Read(page.elements, _blocks(page))


#: Words of a template by the element that they stand in.
Common = dict[int, frozenset[str]]


def _own(block: tuple[int, list[str], int], page: Read, common: Common) -> bool:
    """Whether a block has a word that is none of its template's."""
    known = common.get(page.elements[block[0]].token)
    return not known or not known.issuperset(block[1])


def blocks(page: Read, roots: set[int] | None, common: Common) -> list[str]:
    """The blocks of text below the given elements, or below all if none are given, without what is no part of an article.

    Blocks made of template words alone, given by `common`, go too. Where an element holds both such blocks and others,
    and lies in an article by name, they stay.
    """
    outside = _is_outside(page)
    inside: list[bool] = []
    named: list[bool] = []
    for i, e in enumerate(page.elements):
        inside.append(roots is None or i in roots or (e.parent >= 0 and inside[e.parent]))
        named.append(e.main == 2 or (e.parent >= 0 and named[e.parent]))
    kept = [(b[0], b[1], _own(b, page, common)) for b in page.blocks if inside[b[0]] and not outside[b[0]]]
    mixed = {page.elements[i].token for i, _, own in kept if own and named[i]}
    return [" ".join(words) for i, words, own in kept if own or named[i] and page.elements[i].token in mixed]


def _read_pages(pages: DataFrame) -> DataFrame:
    """Each page (row, page_id, url, host, html) read once: rows with `data`, and of what its tasks have read rows with a frequent `element` or `word`.

    Each so many words a task tells which tokens, elements and words with the element that they stand in, are on a third of the `of` pages of a host that
    it has counted since, with the number of `pages` of each.
    """
    columns = "row page_id url host data element word pages of".split()

    def told(of: Counter, seen: dict[tuple[str, int], Counter]):
        out = [(h, e, w, n, of[h]) for (h, e), words in seen.items() for w, n in words.items() if 3 * n >= of[h]]
        n = len(out)
        host, element, word, many, whole = zip(*out) if out else [()] * 5
        return {"row": [None] * n, "page_id": [None] * n, "url": [None] * n, "host": host, "data": [None] * n, "element": element, "word": word, "pages": many, "of": whole}

    def run(batches):
        of, seen, size = Counter(), {}, 0
        for b in batches:
            data = []
            for host, source in zip(b["host"].to_pylist(), b["html"].to_pylist()):
                page = read(source)
                data.append(page.dumps())
                of[host] += 1
                words: dict[int, set] = {e.token: {None} for e in page.elements[1:]}
                for i, own, _ in page.blocks:
                    words.setdefault(page.elements[i].token, set()).update(own)
                for e, own in words.items():
                    size += len(own)
                    if (host, e) not in seen:
                        seen[host, e] = Counter()
                    seen[host, e].update(own)
            none = [None] * len(data)
            yield {"row": b["row"], "page_id": b["page_id"], "url": b["url"], "host": b["host"], "data": data} | {k: none for k in columns[5:]}
            if size > COUNTED_WORDS:
                yield told(of, seen)
                of, seen, size = Counter(), {}, 0
        yield told(of, seen)

    return arrow_map(pages.select("row", "page_id", "url", "host", "html"), run, "row long, page_id long, url string, host string, data string, element long, word string, pages long, of long")


def _as_common(pairs) -> Common:
    out: dict[int, set] = {}
    for x in pairs or ():
        out.setdefault(x["element"], set()).add(x["word"])
    return {e: frozenset(words) for e, words in out.items()}


def _common(pages: DataFrame, told: DataFrame, hosts: DataFrame, few: bool) -> DataFrame:
    """(host, common): the words, with the elements that they stand in, that belong to each host's template.

    Tokens are elements and words with their elements. One on two thirds of a host's pages must be on a third of the pages of some counts, whose sum then
    reaches a bound; what does not is left out without a second look, and a host has a few others for each token of a page.
    Of these a token's occurrence vector over the pages of its host is told by an
    order-free hash that tasks combine, so no host is gathered; tokens that are equally often on each page that has them and
    are on the same pages form an equivalence class. A class is valid on two thirds of the host's pages, if it is nested
    in elements of its own, has three tokens, or is on nine pages of ten. Hosts of fewer than three pages have no common words.
    """
    sums = told.groupBy("host", "element", "word").agg(F.sum("pages").alias("n"), F.sum("of").alias("m")).join(hosts.filter(F.col("of") >= LEAST_PAGES), "host")
    likely = sums.filter("3 * n - m >= of").groupBy("host").agg(F.collect_list(F.struct("element", "word")).alias("likely"))
    likely = stage(likely, "likely")

    def count(batches):
        found: dict[tuple[str, int, str | None], list[int]] = {}
        known: dict[str, Common] = {}
        for b in batches:
            for row, host, data, pairs in zip(b["row"].to_pylist(), b["host"].to_pylist(), b["data"].to_pylist(), b["likely"]):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = _as_common(pairs.as_py())
                page, likely, vector = Read.loads(data), known[host], xxhash.xxh64_intdigest(str(row))
                times = Counter((e.token, None) for e in page.elements[1:] if None in likely.get(e.token, ()))
                for i, words, _ in page.blocks:
                    e = page.elements[i].token
                    if e in likely:
                        times.update((e, w) for w in words if w in likely[e])
                for (e, w), n in times.items():
                    x = found.get((host, e, w))
                    if x is None:
                        found[host, e, w] = [vector, 1, n, n]
                    else:
                        x[0] ^= vector
                        x[1] += 1
                        x[2], x[3] = min(x[2], n), max(x[3], n)
        vectors, n, low, high = zip(*found.values()) if found else [()] * 4
        host, element, word = zip(*found) if found else [()] * 3
        yield {"host": host, "element": element, "word": word, "vector": np.array(vectors, np.uint64).view(np.int64), "pages": n, "low": low, "high": high}

    joined = pages.join(F.broadcast(likely) if few else likely, "host").select("row", "host", "data", "likely")
    rows = arrow_map(joined, count, "host string, element long, word string, vector long, pages long, low int, high int")
    seen = rows.groupBy("host", "element", "word").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"))
    frequent = seen.join(hosts, "host").filter("low = high AND 3 * pages >= 2 * of")
    classes = frequent.groupBy("host", "vector", "pages", "of").agg(  # a host has a few frequent tokens for each token of a page
        F.collect_list(F.when(F.col("word").isNotNull(), F.struct("element", "word"))).alias("words"), F.count("*").alias("size"), F.bool_or(F.col("word").isNull()).alias("nested")
    )
    return classes.filter("nested OR size >= 3 OR 10 * pages >= 9 * of").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("common"))


def _choose(slots) -> int | None:
    """The main slot among (token, data, chars, main, depth): of those with half of the data, the highest rank, then the innermost with nine tenths of what the best of that rank has."""
    weight = (lambda s: s["data"]) if any(s["data"] for s in slots) else (lambda s: s["chars"])
    most = max(map(weight, slots), default=0)
    rank = max((s["main"] for s in slots if 2 * weight(s) >= most), default=0)
    ranked = [s for s in slots if s["main"] == rank and 2 * weight(s) >= most]
    best = max(map(weight, ranked), default=0)
    return max(((s["depth"], weight(s), s["token"]) for s in ranked if 10 * weight(s) >= 9 * best), default=(0, 0, None))[2]


def templates(pages: DataFrame, told: DataFrame) -> DataFrame:
    """(host, main, common): the main slot of each host's template, and the words of its template; see `_common`.

    `pages` has (row, host, data). The slots are the elements on at least half of the host's pages that can hold an article. What they hold is
    the text outside links that remains without blocks made of template words alone; it decides which is the main
    one. Names (an article by name, by class, any other) decide only among slots that hold at least half of the most.
    """
    hosts = stage(pages.groupBy("host").agg(F.count("*").alias("of")), "hosts")
    few = hosts.count() <= BROADCAST_HOSTS
    near = F.broadcast(hosts) if few else hosts
    common = stage(_common(pages, told, near, few), "common")

    def measure(batches):
        found: dict[tuple[str, int], list[int]] = {}
        known: dict[str, Common] = {}
        for b in batches:
            for host, data, pairs in zip(b["host"].to_pylist(), b["data"].to_pylist(), b["common"]):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = _as_common(pairs.as_py())
                page = Read.loads(data)
                outside, free = _is_outside(page), [0] * len(page.elements)
                for block in page.blocks:
                    if not outside[block[0]] and _own(block, page, known[host]):
                        free[block[0]] += block[2]
                for i in range(len(page.elements) - 1, 0, -1):  # children come after their parents
                    free[page.elements[i].parent] += free[i]
                met = set()
                for i, e in enumerate(page.elements[1:], 1):
                    if not outside[i] and (e.main or e.label.split(".")[0] not in PARTS):
                        x = found.setdefault((host, e.token), [0, 0, 0, 0, e.depth])
                        x[0] += e.token not in met
                        x[1], x[2], x[3] = x[1] + free[i], x[2] + e.chars - e.linked, max(x[3], e.main)
                        met.add(e.token)
        n, data, chars, main, depth = zip(*found.values()) if found else [()] * 5
        yield {"host": [h for h, _ in found], "token": [t for _, t in found], "pages": n, "data": data, "chars": chars, "main": main, "depth": depth}

    joined = pages.join(F.broadcast(common) if few else common, "host", "left").select("host", "data", "common")
    rows = arrow_map(joined, measure, "host string, token long, pages long, data long, chars long, main int, depth int")
    slots = rows.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("data").alias("data"), F.sum("chars").alias("chars"), F.max("main").alias("main"), F.max("depth").alias("depth"))
    slots = slots.join(near, "host").filter("2 * pages >= of").groupBy("host").agg(F.collect_list(F.struct("token", "data", "chars", "main", "depth")).alias("slots"))  # a few for each element of a page
    main = slots.select("host", F.udf(_choose, "long")("slots").alias("main"))
    return hosts.select("host").join(main, "host", "left").join(common, "host", "left")


def article(page: Read, main: int | None, common: Common) -> str:
    """The article of a page: the main slot of its host's template, or what the page itself shows as its article, without the template's words."""
    roots = {i for i, e in enumerate(page.elements) if main is not None and e.token == main}
    if not roots:
        best = max((e.main for e in page.elements if not e.outside), default=0)
        roots = {i for i, e in enumerate(page.elements) if e.main == best and not e.outside} if best else set()
    # a page that has nothing of its own is a copy of others on its host
    return "\n\n".join(blocks(page, roots or None, common) or blocks(page, roots or None, {}))


def extract_text(source: str | None, main: int | None = None, common: Common | None = None) -> str:
    return article(read(source), main, common or {})


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages` (page_id, url, html).

    Templates are deduced for each host, null and unreadable urls sharing one; see `templates`. The text of the main slot is
    taken without navigation, headers, footers, side bars, notices, advertising, forms, comments, scripts and styles; character references
    are decoded, white space within a block becomes one space, and blocks are joined by two line ends. A null or empty
    html gives an empty text; a page of any length is read whole, in time in proportion to it. Repeated rows are pages of their own and give equal rows; slots that
    hold equally much are told apart by depth, then by their hash; other columns are ignored; an empty table gives an empty result.

    Pages are parsed once; what the passes over them need is staged, compressed, in the shared folder.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    known = stage(_read_pages(rows), "read", compression="zstd")
    whole = known.filter("row IS NOT NULL")
    found = stage(templates(whole.select("row", "host", "data"), known.filter("row IS NULL").select("host", "element", "word", "pages", "of")), "templates")
    n = found.count()
    joined = whole.join(F.broadcast(found) if n <= BROADCAST_HOSTS else found, "host", "left").select("page_id", "url", "host", "main", "common", "data")

    def extract(batches):
        commons: dict[str, Common] = {}
        for b in batches:
            text = []
            for h, main, pairs, data in zip(b["host"].to_pylist(), b["main"].to_pylist(), b["common"], b["data"].to_pylist()):
                if h not in commons:
                    if len(commons) > 1000:
                        commons.clear()
                    commons[h] = _as_common(pairs.as_py())
                text.append(article(Read.loads(data), main, commons[h]))
            yield {"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]}

    return arrow_map(joined, extract, "page_id long, url string, text string, n_chars long")
