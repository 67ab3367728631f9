"""HTML extraction: a host suffix array finds what repeats over pages, markup tells the rest.

A page becomes a stream of text blocks. What can't be text (scripts, styles, forms, media) is not read; every
other block is, with a mark for whether it stands in the page's main part and whether its element, class, id or
role says that it is a menu, header, footer, sidebar, notice, advert or comment.

The token streams of a host's distinct pages (copies of a page are one) are laid end to end, an own token
after each page, and their suffix array is built by doubling, with the longest common prefixes of neighbours.
Neighbours that share RUN tokens or more are one repeated substring; where it stands on enough distinct pages
its tokens are covered, and a block that is mostly covered is removed. A block shorter than RUN is also known
as a whole. Unique runs stay. In the main part only what most of the host's pages repeat counts, and a page of
which most would go is a copy, not boilerplate, and stays whole. Of what stays, blocks that markup tells are
left out too: adverts, menus and comments that differ on each page repeat nowhere.

A host with many pages is dealt into parts by its pages' tokens, copies to the same part. A substring on a
share of a host's pages is on that share in some part at least, so the substrings that are so in a part are
all candidates; each part counts them, and the sums over all parts decide. Results don't depend on the dealing.

Null and empty html give the empty text. A null url is a host of its own. Rows are extracted each for
itself: repeated rows give the same text. Very long pages are read whole, as one part's work. Extra columns are
not read. An empty table gives an empty result. Tie rules play no part: pages are read in order of page_id and a
hash of their html only to have a fixed order.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm import kernels
from ledgerframe.llm.common import groups, if_small, stash, tune
from ledgerframe.llm.urls import host_of

#: Tokens of a substring that counts as long.
RUN = 8
#: In a marked main part and elsewhere: the share of a host's distinct pages, and the pages, that repeat boilerplate.
MAIN_SHARE, MAIN_PAGES = 0.6, 10
SHARE, PAGES = 0.2, 3
#: A block goes if this share of its tokens is covered.
COVERED = 0.6
#: Characters of html of a host's pages that one task sorts together, about; a larger host is dealt into parts.
GROUP_CHARACTERS = 8_000_000
#: Marks of a block: in the main part; told by markup not to be of the article.
MAIN, ASIDE = 1, 2

# HTML's elements by what they mean for the text.
NO_TEXT = frozenset("form script style noscript template iframe svg math button select textarea head title object canvas audio video datalist option".split())
DROPPED = frozenset("nav footer aside dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar header masthead footer comment comments disqus replies respond share sharing social related recommended widget pagination pager toolbar complementary contentinfo".split()
)
MAIN_HINTS = frozenset("main article articlebody content maincontent post entry story".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)  # a quote opens only after =
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORDS = re.compile(r"[A-Za-z0-9]+")


def _hints(attributes: str) -> set[str]:
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        for name in value.split():
            out.add(name.replace("-", "").replace("_", ""))
            out.update(WORDS.findall(name.replace("_", " ")))
    return out


def blocks_of(page: str | None) -> tuple[list[str], list[int]]:
    """The text blocks of a page in order, and the marks of each."""
    blocks: list[str] = []
    marks: list[int] = []
    pieces: list[str] = []
    dropped: list[str] = []  # the open elements from the first one left out on that have its name
    silent = False  # whether that one can't be text
    inside: list[str] = []  # the open elements that mark a main part
    depth: dict[str, int] = {}
    page = page or ""
    at = 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append(text)
                marks.append((MAIN if inside else 0) | (ASIDE if dropped else 0))

    length = len(page)
    while at < length:
        m = TAG.search(page, at)
        if not m:
            if not (dropped and silent):
                pieces.append(page[at:])
            break
        if m.start() > at and not (dropped and silent):
            pieces.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not (dropped and silent):
                pieces.append(entities.escape(m[0][9:-3]))
            continue
        closing, attributes = bool(m[1]), m[3] or ""
        alone = name in VOID or attributes.endswith("/")
        if not closing and name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if dropped:
            # an element that is left out ends with its own end tag, or where a main part begins
            if closing and name == dropped[0]:
                if len(dropped) == 1:
                    flush()
                dropped.pop()
            elif not closing and name == dropped[0] and not alone:
                dropped.append(name)
            elif not closing and name in ("article", "main") and not inside and not _hints(attributes) & HINTS:
                flush()
                dropped.clear()
                inside.append(name)
                depth[name] = 1
            elif not silent and name == "br":
                pieces.append(" ")
            elif not silent and name not in INLINE:
                flush()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            if inside and name == inside[-1]:
                depth[name] -= 1
                if not depth[name]:
                    inside.pop()
            continue
        if alone:
            continue
        hints = _hints(attributes) if attributes else set()
        never = name in NO_TEXT or bool(attributes and HIDDEN.search(attributes))
        leave = never or name in DROPPED or name == "header" and not inside
        if leave or hints & HINTS and name not in ("html", "body", "main") and not (name == "article" and not hints & {"comment", "comments", "related", "recommended", "ad", "ads", "advert", "sponsored", "promo"}):
            flush()
            dropped.append(name)
            silent = never
        elif inside and name == inside[-1]:
            depth[name] += 1
        elif name in ("article", "main") or not inside and hints & MAIN_HINTS and name in ("div", "section", "td"):
            flush()
            inside.append(name)
            depth[name] = 1
    flush()
    return blocks, marks


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes in order, and the length of what each shares with the one before it (0 for the first).

    Suffixes are ranked by their first 1, 2, 4, ... tokens until all differ; the same ranks, from the longest
    down, give the common prefixes.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int32)
    ranks = [rank]
    order = np.argsort(rank, kind="stable")
    reach = 1
    while n and int(rank.max()) < n - 1:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - reach] += rank[reach:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))).astype(np.int32)
        ranks.append(rank)
        reach *= 2
    shared = np.zeros(n, np.int32)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = order[:-1] + shared[1:], order[1:] + shared[1:]
        same = np.flatnonzero((a < n) & (b < n))
        same = same[ranks[k][a[same]] == ranks[k][b[same]]]
        same = same[np.maximum(a[same], b[same]) + (1 << k) <= n]
        shared[1 + same] += 1 << k
    return order, shared


def _distinct(values: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and on how many pages each stands."""
    kinds, at = np.unique(values, return_inverse=True)
    wide = int(pages.max(initial=0)) + 1
    pair = np.unique(at.astype(np.int64) * wide + pages)
    return kinds, np.bincount(pair // wide, minlength=len(kinds))


@dataclass
class Host:
    """The token streams of pages of a host, given as lists of blocks.

    distinct: the pages that differ. runs: by token the hash of the RUN tokens that start there, odd; forms: by block shorter
    than RUN its hash, even. Both are 0 where there is none.
    """

    pages: list[list[str]]

    def __post_init__(self) -> None:
        flat = [b.encode("utf-8", "replace") for p in self.pages for b in p]
        self.blocks_at = np.concatenate(([0], np.cumsum([len(p) for p in self.pages], dtype=np.int64)))
        words, begins = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for i, j in kernels.chunks(flat):
            w, at = kernels.word_hashes(flat[i:j])
            words.append(w)
            begins.append(at[1:] + begins[-1][-1])
        self.words, self.begins = np.concatenate(words), np.concatenate(begins)
        self.page_at = self.begins[self.blocks_at]
        self.page = np.repeat(np.arange(len(self.pages), dtype=np.int32), np.diff(self.page_at))
        # copies of a page are one: each page is known by its tokens
        place = np.arange(len(self.words)) - self.page_at[:-1][self.page]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernels.mixed(self.words ^ kernels.mixed(place.astype(np.uint64))), dtype=np.uint64)))
        lengths = np.diff(self.page_at)
        _, first, self.same = np.unique(sums[self.page_at[1:]] - sums[self.page_at[:-1]], return_index=True, return_inverse=True)
        self.first = first[lengths[first] > 0]
        self.distinct = len(self.first)
        # hashes of 1, 2, 4 and 8 tokens; the last of them is the run's
        grams, reach, self.pairs = self.words, 1, self.words
        while reach < RUN:
            shorter = grams
            grams = np.zeros(len(shorter), np.uint64)
            n = max(len(shorter) - reach, 0)
            grams[:n] = kernels.mixed(shorter[:n]) * kernels.ODD + shorter[reach:]
            reach *= 2
            self.pairs = grams if reach == 2 else self.pairs
        self.whole = place + RUN <= lengths[self.page]
        self.runs = np.where(self.whole, grams | np.uint64(1), np.uint64(0))
        # a block shorter than a run is known as a whole
        size = np.diff(self.begins)
        block = np.repeat(np.arange(len(flat)), size)
        mixes = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernels.mixed(self.words ^ kernels.mixed((np.arange(len(self.words)) - self.begins[:-1][block]).astype(np.uint64) + np.uint64(77))), dtype=np.uint64)))
        short = np.flatnonzero((size > 0) & (size < RUN))
        self.forms = np.zeros(len(flat), np.uint64)
        self.forms[short] = kernels.mixed((mixes[self.begins[1:]] - mixes[self.begins[:-1]])[short] + size[short].astype(np.uint64)) & ~np.uint64(1)

    def _on(self, kept: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of the forms that are kept: distinct ones and their pages."""
        at = np.flatnonzero(self.forms != 0)
        at = at[kept(self.forms[at])]
        owner = np.searchsorted(self.blocks_at, at, "right") - 1
        return _distinct(self.forms[at], self.same[owner])

    def frequent(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The runs and forms that stand on `least` distinct pages or more, and on how many.

        Of the distinct pages' streams what can be in such a run goes into the suffix array: a pair of tokens that comes fewer
        times than that is in none. An own token stands for each gap and after each page.
        """
        mine = np.zeros(len(self.pages), bool)
        mine[self.first] = True
        mine = mine[self.page]
        bits = min(22, 2 + len(self.words).bit_length())
        slot = (self.pairs >> np.uint64(64 - bits)).astype(np.int64)
        often = np.bincount(slot[mine], minlength=1 << bits)[slot] >= least
        rare = np.concatenate(([0], np.cumsum(~often)))
        start = np.flatnonzero(self.whole & mine)
        start = start[rare[start + RUN - 1] == rare[start]]
        over = np.zeros(len(self.words) + RUN + 1, np.int64)
        np.add.at(over, start, 1)
        np.add.at(over, start + RUN, -1)
        at = np.flatnonzero(np.cumsum(over)[: len(self.words)] > 0)
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(at):
            gap = np.flatnonzero((np.diff(at) > 1) | (np.diff(self.page[at]) > 0)) + 1
            ends = np.append(gap, len(at))
            stream = np.insert(self.words[at], ends, np.arange(len(ends), dtype=np.uint64) | np.uint64(1 << 63))
            place = np.insert(at, ends, -1)
            order, shared = suffix_array(stream)
            classes = np.cumsum(shared < RUN)  # neighbours that share a run
            size = np.bincount(classes)
            where = place[order]
            held = np.flatnonzero((size >= least)[classes] & (where >= 0))
            held = held[self.runs[where[held]] != 0]
            # a suffix that ends its segment sooner than a run is no run; it shares none with its neighbours
            held = held[_reaches(ends, order[held])]
            kinds, n = _distinct(classes[held], self.same[self.page[where[held]]])
            one = np.zeros(len(size), np.int64)
            one[classes[held][::-1]] = where[held][::-1]
            keys = self.runs[one[kinds]]
            keys, n = keys[n >= least], n[n >= least]
        forms, m = self._on(lambda f: np.ones(len(f), bool))
        keys, n = np.concatenate((keys, forms[m >= least])), np.concatenate((n, m[m >= least]))
        order = np.argsort(keys)
        return keys[order], n[order]

    def counted(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys those that pages have, and on how many distinct pages."""
        known = lambda x: keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)
        at = np.flatnonzero(known(self.runs) & self.whole)
        runs, n = _distinct(self.runs[at], self.same[self.page[at]])
        forms, m = self._on(known)
        return np.concatenate((runs, forms)), np.concatenate((n, m))

    def repeated(self, marks: list[list[int]], keys: np.ndarray, counts: np.ndarray, pages: int) -> list[list[bool]]:
        """Of each page's blocks, whether repeats cover them: sorted keys and their counts, of a host with so many distinct pages."""
        of = lambda x: np.where(keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x, counts[np.minimum(np.searchsorted(keys, x), len(keys) - 1)], 0) if len(keys) else np.zeros(len(x), np.int64)
        run_counts, form_counts = np.where(self.whole, of(self.runs), 0), np.where(self.forms != 0, of(self.forms), 0)
        flat = np.array([m for x in marks for m in x], np.int64)
        size = np.diff(self.begins)
        block = np.repeat(np.arange(len(flat)), size)
        main = (flat & MAIN) > 0
        gone = np.zeros(len(flat), bool)
        for mine, share, least in ((main, MAIN_SHARE, MAIN_PAGES), (~main, SHARE, PAGES)):
            need = max(least, int(np.ceil(share * pages)))
            hit = np.flatnonzero(run_counts >= need)
            over = np.zeros(len(self.words) + RUN + 1, np.int64)
            np.add.at(over, hit, 1)
            np.add.at(over, hit + RUN, -1)
            covered = np.bincount(block[np.cumsum(over)[: len(self.words)] > 0], minlength=len(flat))
            gone |= mine & (covered >= np.maximum(COVERED * size, 1e-9))
            gone |= mine & (form_counts >= need)
        cuts = self.blocks_at
        return [gone[i:j].tolist() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _reaches(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether RUN tokens from places of a stream on are before the next own token; the k-th stands at ends[k] + k."""
    stops = ends + np.arange(len(ends))
    return at + RUN <= stops[np.searchsorted(stops, at)]


def host_repeats(blocks: list[list[str]], marks: list[list[int]]) -> list[list[bool]]:
    """Of each page's blocks, whether repeats over the pages, all of a host's, cover them."""
    host = Host(blocks)
    return host.repeated(marks, *host.frequent(max(PAGES, SHARE * host.distinct)), host.distinct)


def text_of(blocks: list[str], marks: list[int], repeated: list[bool]) -> str:
    """A page's text: its blocks but for those that repeat or that markup leaves out; of a page with a main part only that."""
    main = any(m == MAIN for m in marks)
    own = [k for k, m in enumerate(marks) if m == (MAIN if main else 0)]
    stay = [k for k in own if not repeated[k]]
    size = lambda ks: sum(blocks[k].count(" ") + 1 for k in ks)
    if main and size(stay) * 2 < size(own):
        stay = own
    return "\n".join(blocks[k] for k in stay)


def _packed(pages: list[tuple[list[str], list[int]]], press: zstandard.ZstdCompressor) -> bytes:
    """Pages' blocks, in which a space is the only white space, and their marks, compressed, so that a shuffle moves less."""
    return press.compress("\f".join("\n".join(["".join(map(str, marks)), *blocks]) for blocks, marks in pages).encode("utf-8", "surrogatepass"))


def _unpacked(bodies: pa.ChunkedArray) -> tuple[list[list[str]], list[list[int]]]:
    unpress = zstandard.ZstdDecompressor()
    rows = [page.split("\n") for x in bodies.to_pylist() if x is not None for page in unpress.decompress(x).decode("utf-8", "surrogatepass").split("\f")]
    return [r[1:] for r in rows], [list(map(int, r[0])) for r in rows]


def _same(blocks: list[str]) -> int:
    """A hash of a page's tokens."""
    return xxhash.xxh3_64_intdigest(" ".join(blocks).encode("utf-8", "surrogatepass")) - (1 << 63)


def sized(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, host, tie, the host's number of parts and html."""
    tune(pages.sparkSession)
    host = F.coalesce(F.when(F.col("url").isNotNull(), host_of(F.col("url"))), F.lit("\x00"))
    large = stash(pages.groupBy(host.alias("_h")).agg(F.sum(F.length("html")).alias("_size")).where(F.col("_size") > GROUP_CHARACTERS))
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(if_small(large, 100_000), F.col("host") == F.col("_h"), "left")
    parts = F.coalesce(F.ceil(F.col("_size") / F.lit(GROUP_CHARACTERS)), F.lit(1)).cast("long")
    return rows.select("page_id", "url", "host", F.xxhash64("html").alias("tie"), parts.alias("parts"), "html")


def _parsed(rows: DataFrame) -> DataFrame:
    """sized() rows with deal, the part that a page is in, and body, its packed blocks, for html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for b in batches:
            found = [blocks_of(x) for x in b.column(5).to_pylist()]
            deal = [_same(x) % n for (x, _), n in zip(found, b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(deal, pa.int64()), pa.array([_packed([f], press) for f in found], pa.binary())], names)

    names = ["page_id", "url", "host", "tie", "parts", "deal", "body"]
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, tie long, parts long, deal long, body binary")


def _bundled(rows: DataFrame) -> DataFrame:
    """Of sized() rows, host, parts, deal and body: pages of a part that a batch has, packed together, for what only counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for b in batches:
            held: dict[tuple, list] = {}
            for host, n, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                page = blocks_of(html)
                held.setdefault((host, n, _same(page[0]) % n), []).append(page)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in held], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))), pa.array([_packed(p, press) for p in held.values()], pa.binary())], ["host", "parts", "deal", "body"])

    return rows.select("host", "parts", "html").mapInArrow(run, "host string, parts long, deal long, body binary")


def _counted(dealt: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Of dealt pages: host, key, n, by part the counts of what stands on SHARE of its pages, or with keys those of the host's keys.
    Key 0 has the part's distinct pages."""
    asks = keys is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, _), group in groups(batches, ["host", "deal"]):
            part = Host(_unpacked(group["body"])[0])
            if asks:
                asked = group["keys"][0].values.to_numpy().view(np.uint64) if group["keys"][0].is_valid else np.zeros(0, np.uint64)
                found, n = part.counted(np.sort(asked))
            else:
                found, n = part.frequent(max(1, SHARE * part.distinct))
            found, n = np.append(found, np.uint64(0)), np.append(n, part.distinct)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(n), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["host", "key", "n"])

    return _with_keys(dealt, keys).mapInArrow(run, "host string, key long, n long")


def _with_keys(dealt: DataFrame, keys: DataFrame | None) -> DataFrame:
    """dealt pages, sorted for their part; with keys (host, parts, keys, counts, distinct) a first row a part has its host's."""
    if keys is not None:
        deals = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("deal")
        dealt = keys.select("host", deals, "keys", "counts", "distinct", F.lit(0).alias("kind")).unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    else:
        dealt = dealt.withColumn("kind", F.lit(1))
    return dealt.repartition("host", "deal").sortWithinPartitions("host", "deal", "kind", *(c for c in ("page_id", "tie") if c in dealt.columns))


def _settled(rows: DataFrame, kind: str) -> DataFrame:
    """The results of sorted rows, each host and part by its own counts or by those of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups(batches, ["host", "deal"]):
            keys = distinct = None
            if group["kind"][0].as_py() == 0:
                keys, counts = (group[c][0].values.to_numpy() for c in ("keys", "counts"))
                distinct, group = group["distinct"][0].as_py(), group.slice(1)
            if not len(group):
                continue
            blocks, marks = _unpacked(group["body"])
            if keys is None:
                gone = host_repeats(blocks, marks)
            else:
                order = np.argsort(keys.view(np.uint64))
                gone = Host(blocks).repeated(marks, keys.view(np.uint64)[order], counts[order], distinct)
            texts = list(map(text_of, blocks, marks, gone))
            for i in range(0, len(texts), 2000):
                part, mine = group.slice(i, 2000), texts[i : i + 2000]
                yield pa.RecordBatch.from_arrays([part["page_id"].combine_chunks(), part["url"].combine_chunks(), pa.array(mine, pa.string()), pa.array([len(t) for t in mine], pa.int64()), pa.array([sum(g) for g in gone[i : i + 2000]], pa.int64())], names)

    names = ["page_id", "url", "text", "n_chars", "n_repeated"]
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_repeated long")


def extract(pages: DataFrame) -> DataFrame:
    """The contract's rows for pages (page_id, url, html): page_id, url, text and n_chars, with n_repeated, the blocks of the page
    that its host repeats."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = sized(pages)
    whole = _parsed(rows.where("parts = 1"))
    nothing = {"keys": "array<long>", "counts": "array<long>", "distinct": "long"}
    out = _settled(_with_keys(whole, None).withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}), kind)
    if not rows.where("parts > 1").limit(1).count():
        return out
    large = rows.where("parts > 1")  # parsed again by each step, which costs less than a table of it
    hosts = stash(large.select("host", "parts").distinct())
    first = stash(_counted(_bundled(large)))
    asked = first.where("key <> 0").groupBy("host").agg(F.collect_set("key").alias("keys")).join(hosts, "host")
    blank = {c: F.lit(None).cast(t) for c, t in nothing.items() if c != "keys"}
    again = stash(_counted(_bundled(large), asked.withColumns(blank)))
    sums = again.groupBy("host", "key").agg(F.sum("n").alias("n"))
    pages_of = sums.where("key = 0").select("host", F.col("n").alias("distinct"))
    kept = sums.where("key <> 0").join(pages_of, "host").where(F.col("n") >= SHARE * F.col("distinct"))
    entry = F.sort_array(F.collect_list(F.struct("key", "n")))
    totals = pages_of.join(kept.groupBy("host").agg(entry.alias("e")), "host", "left")
    none = F.array().cast("array<long>")
    totals = totals.join(hosts, "host").select("host", "parts", F.coalesce("e.key", none).alias("keys"), F.coalesce("e.n", none).alias("counts"), "distinct")
    return out.unionByName(_settled(_with_keys(_parsed(large), totals), kind))
