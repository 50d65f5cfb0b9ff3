"""HTML extraction with a host suffix array (operator 2).

A page is cut into blocks of text at block-level tags. Blocks inside menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are outside by their element or its class, id or role; blocks inside the page's
article (or main) element are its text. Where a page has no such element, its other blocks are open.

The streams of all pages of a host form its suffix array: every suffix is keyed by its first `MIN_RUN` tokens with prefix
doubling (a stretch that is shorter, by all of it), equal keys meet in one place by a shuffle, and keys on `MIN_PAGES`
different pages of the host are repeated; longer repeats are runs of such keys. Every page sends the suffixes of what stands
outside its article, and an open page also those of its open blocks. Covered boilerplate is removed and unique runs are
kept: an open page loses the covered runs of its open blocks. Inside an article, what is named a notice, a menu, a form or
comments goes whatever the host does, unless the article is what it wraps, and so do parts that are mostly links under a name
for such; of other doubtful blocks it loses one (of `MIN_RUN` tokens at least) if the host repeats all of it outside of
articles, since a passage that many articles share is their own text. A page that would lose everything keeps its text. Pages of a host whose streams share 0.8 of their word pairs are copies and count once, so copies keep their body and
lose the menus that other pages have too; only pages with something to lose are compared.

Keys are 8 bytes and are counted by partial sums, so a hot host is spread over all tasks, and texts never travel.

Defined results: null and empty html give the empty text; a null url is a host of its own; a page_id given twice is one
page to the repeat count and two rows of the result. Columns other than page_id, url and html are never read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm._common import discard, materialise, mix, slices, table
from veritab.llm.simhash_dedup import components
from veritab.llm.similar_copies import similar_classes

MIN_RUN = 8
MIN_PAGES = 3
#: Streams that share so much of their runs of so many words are copies, and one page to the repeat count.
COPY_SHARE = 0.8
COPY_WORDS = 2

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|textarea|title|iframe|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?][^>]*>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form head button dialog menu object audio video canvas map fieldset noscript template svg select option".split())
#: Of these, one that is never closed is no container: what follows it is judged as if it were not there.
CLOSABLE = frozenset("noscript template svg select object audio video canvas map button dialog".split())
#: A class token or id that names such a part, as a whole: `site-footer` and `ad-slot`, not `has-sidebar` or `entry-header`.
NOT_TEXT = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile|desktop|sticky|fixed|floating|user|reader|post|article|blog|google|in)[-_]+)*"
    r"(?:ads?|advert\w*|sponsor\w*|promos?|promotions?|promoted|banner|nav|navbar|navigation|menus?|sidebar|footer|masthead|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscri\w*|comments?|disqus|replies|related|share|sharing|social|breadcrumbs?|pagination|pager|widgets?|toolbar|skip-?link|login|signup|search)"
    r"(?:[-_]+(?:container|wrapper|wrap|box|bar|area|block|list|section|inner|content|body|unit|slot|label|links?|icons?|buttons?|btn|form|items?|banner|notice|consent|message|popup|modal|menu|nav|navigation|sidebar|widgets?|media|posts?|articles?|stories|thread|\d+))*",
    re.I,
)
#: Of those, single words that inside an article may also name a part of its own text. Notices, menus, forms and comments go
#: unless they hold `WRAPS` of the article, which is then what they wrap (comments: unless `BESIDES` characters stand outside of them); lists of links go if
#: links are `LINKED` of them; of the rest the host's pages decide.
PLAINLY_BESIDE = frozenset("notice notices alert alerts banner menu menus replies comment login signup search toolbar paywall".split())
AMBIGUOUS = PLAINLY_BESIDE | frozenset("share sharing media related widget widgets".split())
COMMENTS = frozenset(("comment", "replies"))
WRAPS, BESIDES, LINKED = 0.5, 80, 0.5
HEADER = re.compile(r"(?:(?:site|global|top|main|mobile|sticky|fixed)[-_]+)*header(?:[-_]+(?:container|wrapper|wrap|inner|bar|area))*", re.I)
#: Parts that hold articles of their own, which are not the page's.
OTHERS = re.compile(r"(?:\w+[-_]+)?(?:comments?|repl(?:y|ies)|disqus|related)(?:[-_]+\w+)*", re.I)
#: An article element so named is itself no text.
NO_ARTICLE = re.compile(r"(?:comments?|repl(?:y|ies)|ads?|advert\w*|sponsored)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}


def judged(name: str, attributes: str, in_article: bool) -> tuple[int, bool, int]:
    """(dropped, article, doubtful) of an element; dropped is 2 where articles inside are not the page's either, doubtful is 3
    for comments by name, 2 for what else is plainly beside the text by its name, 1 for what may be."""
    dropped, article = int(name in DROPPED or name == "header" and not in_article), name in ("article", "main")
    named: list[str] = []
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "id"):
                named += value.split()
            elif key == "role":
                dropped = max(dropped, value in ROLES)
                article |= value in ("main", "article")
            elif key == "itemprop":
                article |= value == "articlebody"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                dropped = 2
    if name == "aside":
        dropped = 2
    if article:
        return (2 if dropped == 2 or any(map(NO_ARTICLE.fullmatch, named)) else 0), True, 0
    doubtful = 0
    if named and name not in ("html", "body"):
        for x in named:
            if in_article and x in AMBIGUOUS:
                doubtful = max(doubtful, 3 if x in COMMENTS else 2 if x in PLAINLY_BESIDE else 1)
                continue
            if NOT_TEXT.fullmatch(x):
                dropped = max(dropped, 2 if OTHERS.fullmatch(x) else 1)
            elif not in_article and HEADER.fullmatch(x):
                dropped = max(dropped, 1)
    return dropped, False, doubtful


class Open:
    """The open elements; each knows what is dropped or article around it. All look-ups take constant time."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int, int]] = []  # name, dropped, article depth, rank, doubtful: of the element and all around it
        self.places: dict[str, list[int]] = {}  # of each name that is open
        self.block_places: list[int] = []

    def state(self) -> tuple[int, int, int, int]:
        return self.stack[-1][1:] if self.stack else (0, 0, 0, 0)

    def push(self, name: str, dropped: int, depth: int, rank: int, doubtful: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.block_places.append(len(self.stack))
        self.stack.append((name, dropped, depth, rank, doubtful))

    def cut(self, at: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.stack) > at:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in BLOCKS:
                self.block_places.pop()

    def place_of(self, name: str) -> int | None:
        """The place of the innermost open element of a name."""
        return found[-1] if (found := self.places.get(name)) else None


def blocks(page: str, keep_forms: bool = False) -> list[tuple[int, int, int, int, int, str]]:
    """(dropped, rank, depth of article elements around it, doubtful, characters in links, text) of each block; main counts as
    half an article.

    The rank is 0, or of an article inside something dropped how that is dropped, 1 or 2. Doubtful is 0, or of the outermost
    doubtful element around it four times its number and how it is doubtful."""
    out: list[tuple[int, int, int, int, int, str]] = []
    linked = doubts = 0
    open_now = Open()
    parts: list[str] = []
    last_end: dict[str, int] = {}
    lower = page.lower()
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            dropped, depth, rank, doubtful = open_now.state()
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((dropped, rank, depth, doubtful, linked, text))
            parts.clear()
        linked = 0

    for m in MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if open_now.places.get("a"):
                linked += len(parts[-1].strip())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name in BLOCKS:
                flush()
            found = open_now.place_of(name)
            if found is not None:
                if open_now.stack[found][1] or open_now.stack[found][3] or open_now.stack[found][4] or name in BLOCKS or open_now.stack[-1][1]:
                    flush()
                open_now.cut(found)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if open_now.block_places:
                inner = open_now.block_places[-1]
                around = open_now.stack[inner][0]
                if around in ("p", "option") or around in CLOSED_BY.get(name, ()):
                    open_now.cut(inner)
        if name in VOID or m[4].endswith("/") and name not in BLOCKS:
            continue
        if name in CLOSABLE:
            if name not in last_end:
                last_end[name] = lower.rfind("</" + name)
            if last_end[name] < at:
                continue
        around, depth, rank, doubted = open_now.state()
        dropped, article, doubtful = judged(name, m[4], depth > 0)
        if name == "form" and keep_forms:
            dropped = 0
        if around and article and not dropped:
            flush()
            rank, depth, around = max(rank, around), 0, 0
        elif dropped and not around or doubtful and not doubted:
            flush()
        if doubtful and not doubted:
            doubts += 1
            doubted = 4 * doubts + doubtful
        open_now.push(name, max(around, dropped), depth + (1 if name == "main" else 2) * article, rank, doubted)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def beside(found: list[tuple[int, int, int, int, int, str]], kept: list[bool]) -> set[int]:
    """The doubtful elements of an article that are beside its text by name or links, and do not wrap it."""
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    for own, (_, _, _, doubt, linked, text) in zip(kept, found, strict=True):
        if own:
            size[doubt] = size.get(doubt, 0) + len(text)
            links[doubt] = links.get(doubt, 0) + linked
    whole = sum(size.values())
    wraps = lambda d, n: whole - n < BESIDES if d % 4 == 3 else n >= WRAPS * whole
    return {d for d, n in size.items() if d and not wraps(d, n) and (d % 4 >= 2 or links[d] >= LINKED * n)}


def main_text(page: str) -> tuple[bool, list[str], list[bool], list[str]]:
    """(whether they are an article's, the page's blocks, which of them are doubtful, the stretches of text outside of them).

    An article inside something dropped is the page's if no other is; one among comments or asides only if there is no other
    text. A page of which nothing stays is read again with its forms, since some pages are wrapped in one."""
    found = blocks(page)
    kept = None
    for rank in range(3):
        deepest = max((d for x, r, d, *_ in found if not x and r == rank), default=0)
        if deepest and (rank < 2 or not any(r < 2 for x, r, *_ in found if not x)):
            inside = 2 if deepest >= 2 else 1
            kept = [not x and r == rank and d >= inside for x, r, d, *_ in found]
            break
    fixed = kept is not None
    if kept is None:
        kept = [not x and not d for x, _, d, *_ in found]
        if not any(kept):
            found = blocks(page, keep_forms=True)
            kept = [not x and not d for x, _, d, *_ in found]
    elif any(own and x[3] for own, x in zip(kept, found, strict=True)):
        gone = beside(found, kept)
        kept = [own and x[3] not in gone for own, x in zip(kept, found, strict=True)]
    outside: list[list[str]] = [[]]
    for own, (*_, text) in zip(kept, found, strict=True):
        if not own:
            outside[-1].append(text)
        elif outside[-1]:
            outside.append([])
    own_blocks = [(t, fixed and q > 0) for own, (_, _, _, q, _, t) in zip(kept, found, strict=True) if own]
    return fixed, [t for t, _ in own_blocks], [q for _, q in own_blocks], [" ".join(x) for x in outside if x]


def window_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix by its first `length` tokens (a power of two), by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < length:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def left(keep: np.ndarray) -> np.ndarray:
    """A block's tokens that stay: a covered stretch goes if it is a whole run within the block, or the whole block."""
    out = np.ones(len(keep), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out[a:b] = b - a < min(MIN_RUN, len(keep))
    return out


def unique_runs(pages: list[tuple[object, list[str]]]) -> list[str]:
    """The text of each (page, open blocks) without runs that `MIN_PAGES` of them share, in memory; `decide` does it for hosts."""
    numbers: dict[str, int] = {}
    stream: list[int] = []
    owner: list[int] = []
    names = {p: i for i, p in enumerate(dict.fromkeys(p for p, _ in pages))}
    for k, (page, open_blocks) in enumerate(pages):
        for block in open_blocks:
            words = block.split(" ")
            stream += [numbers.setdefault(w, len(numbers)) for w in words]
            owner += [names[page]] * len(words)
        stream.append(-1 - k)  # ends a page's stream: occurs once
        owner.append(-1)
    if not stream:
        return ["\n".join(b) for _, b in pages]
    tokens, own = np.array(stream, np.int64), np.array(owner, np.int64)
    rank = window_ranks(tokens, MIN_RUN)
    ends = np.flatnonzero(own < 0)
    whole = ends[np.searchsorted(ends, np.arange(len(own)))] - np.arange(len(own)) >= MIN_RUN
    pairs = np.unique(rank[whole] * (len(names) + 1) + own[whole])
    times = np.bincount(pairs // (len(names) + 1), minlength=len(tokens))
    start = np.flatnonzero(whole & (times[rank] >= MIN_PAGES))
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + MIN_RUN, -1)
    keep = np.cumsum(edge[:-1]) == 0
    out, at = [], 0
    for _, open_blocks in pages:
        texts, first = [], at
        for block in open_blocks:
            words = block.split(" ")
            texts.append(" ".join([w for w, k in zip(words, left(keep[at : at + len(words)]), strict=True) if k]))
            at += len(words)
        out.append("\n".join(t for t in (texts if keep[first:at].any() else open_blocks) if t))
        at += 1
    return out


def window_keys(streams: list[str], hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the stream, key) of every suffix of `MIN_RUN` tokens, by prefix doubling of hashes of host and token; a
    stream of fewer tokens has one key, of all of it."""
    words = [x.split(" ") if x else [] for x in streams]
    n = np.array([len(w) for w in words], np.int64)
    page = np.repeat(np.arange(len(n)), n)
    if not len(page):
        return page, np.empty(0, np.uint64)
    key = mix(pd.util.hash_array(np.array([w for x in words for w in x], object)) ^ mix(hosts.view(np.uint64))[page])
    ends = np.cumsum(n)
    first = np.arange(len(page)) == (ends - n)[page]
    left = ends[page] - np.arange(len(page))
    step = 1
    while step < MIN_RUN:
        after = np.zeros_like(key)
        after[:-step] = key[step:]
        after[left <= step] = 0
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + after)
        step *= 2
    whole = (left >= MIN_RUN) | first
    return page[whole], key[whole]


NARROW = "cls long, fixed boolean, outside array<long>, probes array<long>"


def read_keys(page: Column, host: Column) -> Column:
    """cls, which tells equal texts of a host; the different keys outside of the page's article, those of doubtful blocks and
    an open page's own among them; and of each doubtful block its least key."""

    @F.arrow_udf(NARROW)
    def keys(pages: pa.Array, hosts: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        at = hosts.to_numpy(zero_copy_only=False)
        for start, texts in slices(pages):
            for k, text in enumerate(texts, start):
                fixed, own, doubts, outside = main_text(text or "")
                doubtful = [t for t, q in zip(own, doubts, strict=True) if q]
                streams = outside + (doubtful if fixed else [" ".join(own)])
                seen = np.unique(window_keys(streams, np.full(len(streams), at[k]))[1]).view(np.int64)
                probes = np.empty(0, np.uint64)
                if doubtful:
                    block, key = window_keys(doubtful, np.full(len(doubtful), at[k]))
                    probes = np.minimum.reduceat(key, np.flatnonzero(np.diff(block, prepend=-1)))
                cls = xxhash.xxh64_intdigest("\n".join(own), int(at[k]) & (2**63 - 1))
                rows.append((cls - (cls >> 63 << 64), fixed, seen, np.unique(probes).view(np.int64)))

        def lists(arrays: list[np.ndarray]) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))

        cls, fixed, seen, probes = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(cls, pa.int64()), pa.array(fixed, pa.bool_()), lists(list(seen)), lists(list(probes))], names=["cls", "fixed", "outside", "probes"])

    return keys(page, host)


def stream_of(page: Column, host: Column) -> Column:
    """The page's own text as one stream, and all keys of what it may lose."""

    @F.arrow_udf("stream string, keys array<long>")
    def read(pages: pa.Array, hosts: pa.Array) -> pa.Array:
        streams, keys = [], []
        for text, h in zip(pages.to_pylist(), hosts.to_numpy(zero_copy_only=False), strict=True):
            fixed, own, doubts, _ = main_text(text or "")
            parts = [t for t, q in zip(own, doubts, strict=True) if q] if fixed else [" ".join(own)]
            streams.append(" ".join(own))
            keys.append(np.unique(window_keys(parts, np.full(len(parts), h))[1]).view(np.int64).tolist())
        return pa.StructArray.from_arrays([pa.array(streams, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["stream", "keys"])

    return read(page, host)


def without(blocks: list[str], host: int, keys: np.ndarray, fixed: bool, doubts: list[bool] | None = None) -> str:
    """The blocks' text without the runs of keys; a page that would lose everything keeps its text. An article loses whole
    doubtful blocks only."""
    if fixed:
        gone = [q and np.isin(window_keys([b], np.array([host], np.int64))[1].view(np.int64), keys).all() for b, q in zip(blocks, doubts or [], strict=True)]
        return "\n".join([b for b, g in zip(blocks, gone, strict=True) if not g] or blocks)
    sizes = [b.count(" ") + 1 for b in blocks]
    start = np.flatnonzero(np.isin(window_keys([" ".join(blocks)], np.array([host], np.int64))[1].view(np.int64), keys))
    edge = np.zeros(sum(sizes) + MIN_RUN + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + MIN_RUN, -1)
    keep = np.split((np.cumsum(edge) == 0)[: sum(sizes)], np.cumsum(sizes)[:-1])
    texts = [" ".join([w for w, k in zip(b.split(" "), left(k), strict=True) if k]) for b, k in zip(blocks, keep, strict=True)]
    return "\n".join([t for t in texts if t] or blocks)


def main_texts(page: Column, host: Column, keys: Column | None = None) -> Column:
    """The text of each page, without the runs of its keys."""

    @F.arrow_udf("string")
    def whole(pages: pa.Array) -> pa.Array:
        return pa.array(["\n".join(main_text(x or "")[1]) for _, some in slices(pages) for x in some], pa.string())

    @F.arrow_udf("string")
    def cut(pages: pa.Array, hosts: pa.Array, wanted: pa.Array) -> pa.Array:
        out, at = [], hosts.to_numpy(zero_copy_only=False)
        for start, some in slices(pages):
            for k, x in enumerate(some, start):
                fixed, own, doubts, _ = main_text(x or "")
                gone = wanted[k].as_py()
                out.append(without(own, int(at[k]), np.array(gone, np.int64), fixed, doubts) if gone and own else "\n".join(own))
        return pa.array(out, pa.string())

    return whole(page) if keys is None else cut(page, host, keys)


def pages_of(held: DataFrame) -> DataFrame:
    """(cls, page) of streams (cls, page_id, host, stream): near copies on a host, and rows with one page_id, are one page."""
    texts, placed = similar_classes(held.select("cls", "stream").dropDuplicates(["cls"]), COPY_WORDS, COPY_SHARE, "stream", "cls", pivots=False)
    rooted = texts.toDF("cls", "text").join(placed.select(F.col("cls").alias("text"), "root"), "text").select("cls", "root")
    named = materialise(held.select("cls", "page_id", "host").join(rooted, "cls").select("cls", "page_id", "host", F.xxhash64("host", "root").alias("page")).distinct())
    ids = named.where("page_id IS NOT NULL").groupBy("host", "page_id").agg(F.min("page").alias("b"), F.max("page").alias("hi")).where("b != hi")
    edges = materialise(named.join(ids, ["host", "page_id"]).where("page != b").select(F.col("page").alias("a"), "b"))
    pages = named.select("cls", "page").distinct()
    if edges.isEmpty():
        return pages
    linked = components(edges)
    return pages.join(linked, pages.page == linked.vertex, "left").select("cls", F.coalesce("root", "page").alias("page"))


def repeated(pages: DataFrame) -> DataFrame | None:
    """(cls, keys): of each text with something to lose, the keys of its own that its host repeats; None if there is none.
    pages has (page_id, host, html)."""
    read = pages.select("page_id", "host", read_keys(F.col("html"), F.col("host")).alias("k")).select("page_id", "host", "k.*")
    read = materialise(read)
    seen = read.select("cls", F.explode("outside").alias("key"))
    often = materialise(seen.groupBy("key").agg(F.count_distinct("cls").alias("n")).where(F.col("n") >= MIN_PAGES).select("key"))
    probed = read.where("fixed").select("cls", F.explode("probes").alias("key")).join(often, "key").select("cls")
    touched = materialise(read.where("NOT fixed").select("cls").union(probed).distinct())
    if touched.isEmpty():
        discard(read, often, touched)
        return None
    both = pages.withColumn("cls", read_keys(F.col("html"), F.col("host"))["cls"])
    own = materialise(both.join(touched, "cls", "left_semi").select("cls", "page_id", "host", stream_of(F.col("html"), F.col("host")).alias("s")).select("cls", "page_id", "host", "s.*"))
    named = materialise(own.select("cls", F.explode("keys").alias("key")).distinct().join(often, "key"))
    wanted = named.select("key").distinct()
    evidence = materialise(seen.join(wanted, "key").distinct())
    involved = evidence.select("cls").distinct()
    held = both.join(involved, "cls", "left_semi").select("cls", "page_id", "host", stream_of(F.col("html"), F.col("host"))["stream"].alias("stream"))
    counted = evidence.join(pages_of(materialise(held)), "cls").select("key", "page").distinct().groupBy("key").count().where(F.col("count") >= MIN_PAGES)
    return materialise(named.join(counted.select("key"), "key").groupBy("cls").agg(F.collect_list("key").alias("keys")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    hosted = pages.select("page_id", "url", "html", F.xxhash64(name).alias("host"))
    marks = repeated(hosted)
    if marks is None or marks.isEmpty():
        found = hosted.select("page_id", "url", main_texts(F.col("html"), F.col("host")).alias("text"))
    else:
        cls = read_keys(F.col("html"), F.col("host"))["cls"]
        joined = hosted.withColumn("cls", cls).join(marks, "cls", "left")
        found = joined.select("page_id", "url", main_texts(F.col("html"), F.col("host"), F.col("keys")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
