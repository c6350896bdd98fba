"""Main text of web pages by template deduction over the pages of a host.

A page's tokens are its tags and its blocks of text, told apart by the path of elements that they stand in.
Tokens that occur equally often on each of a host's pages, page by page, form an equivalence class (Arasu and
Garcia-Molina, "Extracting structured data from web pages", 2003). A class is valid with enough tokens and
pages. Valid classes nest: a class belongs to the template if what encloses its elements, beyond its own, are
elements of one class that belongs to it and is on every page that the inner one is on. Text in the template
is the host's, not a page's; what else stands in the template's elements is in slots.

The slot that holds the article is chosen once per host and extracted from each page, without what is a menu,
a notice, a form or the like by its element or its name. Where an element says by its own name that it is the
article, that decides, and all its text is kept, as articles may share passages. Elsewhere it is the innermost
element that occurs once a page and whose slots hold most of the host's text outside of links; the template's
text in it is left out.

An occurrence vector is never written out: a class is known by the sum, over pages, of a hash of the page
and the number of occurrences, so vectors of any length are compared by two numbers that add up in
parallel.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td template tfoot th thead title tr ul".split()
)
#: Elements without a meaning of their own, told apart by their order in the parent.
BOXES = frozenset("div section table td".split())
#: Elements whose content is characters, not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that end an open element of one of the given names, where that end tag may be left out.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
#: Blocks before which an open paragraph ends.
CLOSE_P = BLOCK - {"br", "body", "html", "head", "title", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Elements within which an open li, td or p is another one's.
SCOPE = frozenset("ul ol dl table article aside section nav main div body header footer form fieldset blockquote".split())

#: Elements that never hold the article's text.
APART = frozenset(
    "nav aside footer form script style noscript template button select textarea iframe object svg canvas dialog menu "
    "head title input label datalist audio video map search noembed noframes".split()
)
#: Parts of class and id names of what is beside the article; the second group goes for nested articles too.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos promotion banner nav navbar "
    "navigation navigations menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar toolbar header cookie cookies "
    "consent gdpr notice notices alert alerts newsletter newsletters subscribe subscription signup login share sharing social related "
    "recommended popup modal overlay pagination pager widget widgets skip search copyright disclaimer form".split()
)
REPLIES = frozenset("comment comments commentlist reply replies respond discussion disqus responses".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())
CONTENT = frozenset("article content post entry story main text".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# how an element bears on the text in it
PLAIN, WEAK, STRONG = 0, 1, 2


class Tag:
    """What counts of one tag: name, the element's sign in a path, how it bears on its text, content hints."""

    __slots__ = ("name", "sign", "beside", "content", "empty", "href")

    def __init__(self, name: str, rest: str):
        self.name = name
        self.empty = rest.endswith("/") and name not in BLOCK
        own = {}
        if rest and not rest.isspace():
            for k, a, b, c in ATTRIBUTE.findall(rest):
                own.setdefault(k.lower(), html.unescape(a or b or c))
        self.href = own.get("href") if name == "a" else None
        names = f"{own.get('class', '')} {own.get('id', '')}"
        parts = {p.lower() for p in NAME_PART.findall(names)}
        role = own.get("role", "").lower()
        classes = ".".join(sorted(own.get("class", "").lower().split()))
        self.sign = f"{name}.{classes if len(classes) <= 80 else xxhash.xxh64_hexdigest(classes)}" if classes else name
        hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""))
        self.beside = PLAIN
        if name in APART or role in ROLES or parts & REPLIES or hidden:
            self.beside = STRONG
        elif name == "header" or parts & BESIDE:
            self.beside = WEAK
        self.content = 3 if name == "article" else 2 if name == "main" or role == "main" else 1 if parts & CONTENT and name in BLOCK else 0


_TAGS: dict[tuple[str, str], Tag] = {}


def tag(name: str, rest: str) -> Tag:
    key = (name, rest)
    found = _TAGS.get(key)
    if found is None:
        if len(_TAGS) > 20_000:
            _TAGS.clear()
        found = _TAGS[key] = Tag(name.lower(), rest)
    return found


class Within:
    """Tells whether paths lie in one of the given elements.

    A path that grew too long begins with a hash that stands for all above it; ``above`` has the parent's path
    of each such beginning.
    """

    def __init__(self, main: list[str], above: dict[str, str]):
        self.exact, self.above = set(main), above
        self.inside = ("",) if "" in self.exact else tuple(f"{p}/" for p in main)
        self.known: dict[str, bool] = {}

    def __call__(self, path: str) -> bool:
        if path in self.exact or path.startswith(self.inside):
            return True
        if path[:1] != "~":
            return False
        top = path.partition("/")[0]
        said = self.known.get(top)
        if said is None:
            # up the hashes, one by one, as there may be very many
            seen = [top]
            while True:
                at = self.above.get(seen[-1], "")
                if at in self.exact or at.startswith(self.inside):
                    said = True
                elif at[:1] == "~":
                    top = at.partition("/")[0]
                    if top in self.exact:
                        said = True
                    elif (said := self.known.get(top)) is None:
                        seen.append(top)
                        continue
                else:
                    said = False
                break
            self.known.update(dict.fromkeys(seen, said))
        return said


class Page:
    """A page's tokens: how often each path of elements opens, and its texts with the paths they stand in.

    ``texts``: (path, is beside the article, is in a link, decoded text); a path of None is a block's edge.
    ``links``: what anchors refer to. ``hints``: path -> how much its element looks like the article's.
    ``above``: hash that stands for a long path -> path of that element's parent.
    """

    def __init__(self, source: str):
        self.opened: dict[str, int] = defaultdict(int)
        self.hints: dict[str, int] = {}
        self.above: dict[str, str] = {}
        self.links: list[str] = []
        self.texts: list[tuple[str | None, bool, bool, str]] = []
        # open elements: name, path, state, in a link, inside an article
        stack: list[tuple[str, str, int, bool, bool]] = [("", "", PLAIN, False, False)]
        order: list[dict[str, int]] = [{}]  # of each open element: boxes so far by sign
        add = self.texts.append
        at = 0
        lower = None
        for m in iter(lambda: TAG.search(source, at), None):
            if m.start() > at:
                _, path, state, link, _ = stack[-1]
                add((path, state != PLAIN, link, html.unescape(source[at : m.start()])))
            at = m.end()
            name = m[2]
            if name is None:
                continue
            if m[1]:
                name = name.lower()
                if name == "br" or name == "p" and not any(x[0] == "p" for x in stack):
                    add((None, False, False, ""))
                    continue
                k = len(stack) - 1
                while k and stack[k][0] != name:
                    # an end tag does not reach out of a cell, list or article for an inline element
                    if stack[k][0] in SCOPE and name not in BLOCK:
                        k = 0
                        break
                    k -= 1
                if k:
                    if any(x[0] in BLOCK for x in stack[k:]):
                        add((None, False, False, ""))
                    del stack[k:], order[k:]
                continue
            t = tag(name, m[3])
            name = t.name
            if t.href:
                self.links.append(t.href)
            if name in BLOCK:
                add((None, False, False, ""))
            if name in VOID or t.empty:
                if name not in ("br", "wbr"):
                    self.opened[f"{stack[-1][1]}/{t.sign}"] += 1
                continue
            ends = ENDS.get(name) or ({"p"} if name in CLOSE_P else ())
            if ends:
                k = len(stack) - 1
                while k and stack[k][0] not in ends:
                    if stack[k][0] in SCOPE:
                        k = 0
                        break
                    k -= 1
                if k:
                    del stack[k:], order[k:]
            _, path, state, link, inside = stack[-1]
            path = f"{path}/{t.sign}"
            if name in BOXES:
                before = order[-1].get(t.sign, 0)
                order[-1][t.sign] = before + 1
                if before:
                    path = f"{path}~{before + 1}"
            if len(path) > 600:
                path = f"~{xxhash.xxh64_hexdigest(path)}"
                self.above[path] = stack[-1][1]
            if state != STRONG:
                if t.beside == STRONG:
                    state = STRONG
                elif t.content >= 2 and state == WEAK and t.beside == PLAIN:
                    state = PLAIN
                elif t.beside == WEAK and not (inside and name in ("header", "hgroup", "h1")) and t.content < 2:
                    state = WEAK
            self.opened[path] += 1
            if t.content and state == PLAIN:
                self.hints[path] = max(t.content, self.hints.get(path, 0))
            if name in RAW:
                # up to its own end tag, whatever looks like markup in between
                if lower is None:
                    lower = source.lower()
                    if len(lower) != len(source):
                        lower = source
                end = lower.find(f"</{name}", at)
                end = len(source) if end < 0 else end
                if name in ("title", "textarea") and end > at:
                    add((path, state != PLAIN, link, html.unescape(source[at:end])))
                at = end
            order.append({})
            stack.append((name, path, state, link or name == "a", inside or t.content == 3))
        if at < len(source):
            _, path, state, link, _ = stack[-1]
            add((path, state != PLAIN, link, html.unescape(source[at:])))

    def sizes(self) -> dict[str, list[int]]:
        """Path -> characters of text directly in it: outside of links and in them, beside left out."""
        out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for path, beside, link, text in self.texts:
            if path is not None and not beside:
                out[path][link] += len(text) - text.count(" ")
        return out

    def blocks(self) -> list[tuple[str, list[tuple[str, bool, str]]]]:
        """Runs of text between blocks' edges: the token of each, and its pieces (path, beside, text)."""
        out, run = [], []
        for path, beside, _, text in [*self.texts, (None, False, False, "")]:
            if path is not None:
                run.append((path, beside, text))
                continue
            said = " ".join("".join([x[2] for x in run]).split()) if run else ""
            if run:
                out.append((text_token(run[0][0], said) if said else "", run))
            run = []
        return out

    def said(self) -> dict[str, tuple[int, int]]:
        """Token of a block of text -> how often it occurs, and its characters, all occurrences together."""
        out: dict[str, tuple[int, int]] = {}
        for token, run in self.blocks():
            if token and not run[0][1]:
                n, size = out.get(token, (0, 0))
                out[token] = n + 1, size + sum(len(x[2]) - x[2].count(" ") for x in run)
        return out

    def text(self, main: list[str]) -> str:
        """The text in elements of the given paths, blocks joined by one space, without the given blocks."""
        inside = [p for p in main if TEXT not in p]
        if not inside:
            return ""
        left_out = {p for p in main if TEXT in p}
        within = Within(inside, self.above)
        parts = []
        for token, run in self.blocks():
            if token and token not in left_out:
                parts += [text for path, beside, text in run if not beside and within(path)]
            parts.append(" ")
        return " ".join("".join(parts).split())


#: Parts an element's path from the hash of a text in it.
TEXT = "\x01"


def text_token(path: str, said: str) -> str:
    return f"{path}{TEXT}{xxhash.xxh64_hexdigest(said)}"


def host_of(url: str | None) -> str:
    """The host part of an address in lower case, without user and port; empty if there is none."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


Token = tuple[str, int, int, int, int, int, int, int, str]  # path, pages, occurrences, d1, d2, own, linked, hint, above


def nested(tokens: list[Token], pages: int) -> set[str]:
    """The template: tokens of valid classes that nest.

    Tokens of equal occurrence vectors are one class where they are also enclosed by one class, beyond elements
    of their own. It is valid with two tokens or more, seen on half of the pages or more, if the enclosing one
    is valid and on as many pages or more.
    """
    by = {t[0]: t for t in tokens}
    class_of: dict[str, int] = {}
    numbers: dict[tuple, int] = {}
    around: list[int | None] = []  # of each class: the one that encloses it
    size: list[int] = []
    on: list[int] = []

    def parent(t: Token) -> str:
        return t[8] if t[8] else t[0].partition(TEXT)[0] if TEXT in t[0] else t[0].rpartition("/")[0]

    for t in tokens:
        chain = []
        path = t[0]
        while path in by and path not in class_of:
            chain.append(path)
            path = parent(by[path])
        for p in reversed(chain):
            up = parent(by[p])
            outer = class_of.get(up)
            if outer is not None and by[up][1:5] == by[p][1:5]:
                class_of[p] = outer
            else:
                key = (by[p][1:5], outer)
                if key not in numbers:
                    numbers[key] = len(numbers)
                    around.append(outer)
                    size.append(0)
                    on.append(by[p][1])
                class_of[p] = numbers[key]
            size[class_of[p]] += 1
    # an enclosing class has a lower number than what it encloses
    valid: list[bool] = []
    for k, outer in enumerate(around):
        valid.append(size[k] > 1 and 2 * on[k] >= pages and (outer is None or valid[outer] and on[outer] >= on[k]))
    return {p for p, k in class_of.items() if valid[k]}


#: Pages from which on a host tells its own text from its articles'.
HOST = 4


def choose(tokens: list[Token], pages: int) -> list[str]:
    """Paths of the elements that hold the article, from a host's template, and the texts in them that are
    the template's.

    Of the template's elements that occur once a page where they occur, the most article-like by name is taken;
    if none is, the innermost whose slots hold most of the text outside of links.
    """
    template = nested(tokens, pages)
    same = sum(t[5] for t in tokens if TEXT in t[0] and 2 * t[1] >= pages)
    texts = [t for t in tokens if TEXT in t[0] and t[0] in template]
    tokens = [t for t in tokens if TEXT not in t[0]]
    template = {p for p in template if TEXT not in p}
    by = {t[0]: t for t in tokens}
    above = {t[0]: t[8] for t in tokens if t[8]}

    def depth(path: str) -> int:
        n = len(path)
        while path[:1] == "~" and (path := above.get(path.partition("/")[0], "")):
            n += len(path)
        return n

    sized = [t for t in tokens if t[5]]

    def held(path: str) -> tuple[int, int]:
        within = Within([path], above)
        own = [t for t in sized if within(t[0])]
        return sum(t[5] for t in own), sum(t[5] - t[6] for t in own)

    for least in (3, 2, 1):
        found = sorted(p for p in template if by[p][7] >= least)
        # elements in chosen ones are part of them
        outer = [p for p in found if not any(p != q and Within([q], above)(p) for q in found)]
        if least == 1:
            outer = [p for p in outer if by[p][1] == by[p][2]]
            outer = sorted(outer, key=lambda p: -held(p)[0])[:1]
        if outer:
            return outer
    once = [p for p in template if by[p][1] == by[p][2]]
    total = sum(t[5] for t in tokens)
    if not total:
        return []
    # pages that are copies of one another have no slots: most of their text is the same
    own = texts if pages >= HOST and 2 * same < total else []

    def slots(path: str) -> int:
        within = Within([path], above)
        return held(path)[1] - sum(t[5] for t in own if within(t[0].partition(TEXT)[0]))

    inside = {p: slots(p) for p in once}
    most = [p for p in once if 10 * inside[p] >= 7 * (total - sum(t[5] for t in own))]
    if not most:
        return [""]
    chosen = max(most, key=lambda p: (depth(p), p))
    within = Within([chosen], above)
    return [chosen, *sorted(t[0] for t in own if within(t[0].partition(TEXT)[0]))]


def alone(page: Page) -> list[Token]:
    """A page's tokens as if it were its host's only one; what occurs equally often is one class."""
    own = page.sizes()
    return [(p, 1, n, n, n, sum(own.get(p, (0, 0))), own.get(p, (0, 0))[1], page.hints.get(p, 0), page.above.get(p, "")) for p, n in page.opened.items()]


TOKENS = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("pages", "times", "d1", "d2", "own", "linked", "hint")]
    + [T.StructField("above", T.StringType())]
)
#: Distinct (host, path) that a task adds up before it passes them on.
HELD = 100_000
#: Tokens on less than one in so many pages are not part of a template.
RARE = 20
#: Hosts whose chosen paths are broadcast, at most; beyond it they are joined.
BROADCAST = 20_000
SALTS = 16


def host_tokens(pages: DataFrame) -> DataFrame:
    """TOKENS of each host over all its pages (columns ``page_id, url, html``); path '' counts pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def out() -> pa.RecordBatch:
            cols = [[k[0] for k in held], [k[1] for k in held], *(list(c) for c in zip(*held.values()))]
            types = [pa.string(), pa.string()] + [pa.int64()] * 7 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=TOKENS.fieldNames())

        def note(key, times, digest, own, linked, hint, above=""):
            t = held.setdefault(key, [0] * 7 + [above])
            t[0] += 1
            t[1] += times
            t[2] += digest >> 33
            t[3] += digest & 0x7FFFFFFF
            t[4] += own
            t[5] += linked
            t[6] = max(t[6], hint)

        for ids, urls, sources in common.chunks(batches, 2):
            for i, url, source in zip(ids, urls, sources):
                page, host = Page(source), host_of(url)
                sizes = page.sizes()
                seed = f"{i}\n{url}"
                note((host, ""), 1, 0, 0, 0, 0)
                for path, n in page.opened.items():
                    a, b = sizes.get(path, (0, 0))
                    note((host, path), n, xxhash.xxh64_intdigest(f"{n}\n{seed}"), a + b, b, page.hints.get(path, 0), page.above.get(path, ""))
                for token, (n, size) in page.said().items():
                    note((host, token), n, xxhash.xxh64_intdigest(f"{n}\n{seed}"), size, 0, 0)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    common.ship(pages.sparkSession)
    sums = [F.sum(c).alias(c) for c in TOKENS.fieldNames()[2:8]]
    found = pages.select("page_id", "url", "html").mapInArrow(run, TOKENS)
    return found.groupBy("host", "path").agg(*sums, F.max("hint").alias("hint"), F.max("above").alias("above"))


def templates(pages: DataFrame) -> DataFrame:
    """``host, main``: the paths that hold the article, for each host with a valid template."""
    tokens = host_tokens(pages)
    size = tokens.where("path = ''").select(F.col("host").alias("of"), F.col("pages").alias("all"))
    many = tokens.where("path <> ''").join(size, F.col("host") == F.col("of"))
    least = F.when(F.contains("path", F.lit(TEXT)), 2).otherwise(RARE)
    many = many.where((F.col("all") > 1) & (F.col("pages") * least >= F.col("all")))

    def deduce(key, part):
        rows = part.to_pydict()
        own = list(zip(*(rows[c] for c in TOKENS.fieldNames()[1:])))
        return pa.table({"host": [key[0].as_py()], "main": pa.array([choose(own, rows["all"][0])], pa.list_(pa.string()))})

    return many.drop("of").groupBy("host").applyInArrow(deduce, "host string, main array<string>")


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the article's text.

    Null and empty pages give the empty string. Where a host has one page, has no address, or where its
    template's article is missing from a page, the page is taken as a template of its own. Repeated rows
    are pages like others. Character references are decoded as HTML5 says; blocks are joined by a space.
    """
    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"))
    found = common.cut(templates(rows).where(F.size("main") > 0))
    hosts = found.count()
    keyed = rows.withColumn("host", host_column("url"))
    if hosts <= BROADCAST:
        known = {r["host"]: r["main"] for r in found.collect()}
        shared = spark.sparkContext.broadcast(known)
        joined = keyed.withColumn("main", F.lit(None).cast("array<string>"))
    else:
        shared = spark.sparkContext.broadcast({})
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def make():
        known = shared.value

        def step(cols):
            texts = []
            for url, source, main in zip(cols[1], cols[2], cols[3]):
                page = Page(source)
                found = main or known.get(host_of(url), [])
                there = any(p == "" or p in page.opened for p in found)
                texts.append(page.text(found if there else choose(alone(page), 1)))
            return [cols[0], cols[1], texts, [len(t) for t in texts]]

        return step

    return common.map_texts(joined, ["page_id", "url", "html", "main"], 2, make, EXTRACTED)


def host_column(url: str):
    """:func:`host_of` as a column."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
