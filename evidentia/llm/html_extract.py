"""Main text of HTML pages: structure, and a suffix array of each host.

A page is read into blocks, and its blocks into one stream of tokens with a mark at every block's
end.  The streams of a host are put side by side, and the suffixes that begin at shared seeds are
sorted, forwards and backwards; neighbours' common prefixes say how long a run of tokens recurs
on ``REPEAT_PAGES`` distinct pages.  Seeds are minimizers: of each ``WINDOW`` successive
``SEED``-token strings the one of the least hash, so a run of ``SEED + WINDOW - 1`` tokens or
more that recurs is found wherever it stands and covered from end to end, and nothing is covered
that isn't part of a run of ``SEED`` tokens on so many pages.

What is covered is boilerplate on pages whose structure says nothing (no article or main
element): it goes, unique runs stay.  Articles quote each other and are copied with changes, so
inside one a run is boilerplate only if nearly every page of the host has it (``HOST_SHARE``), and
only whole blocks go.  Menus, headers, footers, forms and the like go by their tags and names.

Streams are cut up where pages are read.  Only hashes of seeds are shuffled, then the
suffixes of recurring seeds, by ranges of their content and page: a run that is on every page of
a host is spread over as many tasks as it fills.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, join_small, near, width

#: Tokens of a seed, seeds of which one is taken, and distinct pages of a host that a run has to be on.
SEED, WINDOW, REPEAT_PAGES = 10, 15, 3
#: Tokens of a suffix that are compared behind its seed: to the end of a run that has no seed after it.
DEPTH = WINDOW - 1
#: Distinct pages of a host that has a template inside its articles, and the share that shows it.
HOST_PAGES, HOST_SHARE = 20, 0.9

# Elements and names.
RAW = frozenset("script style noscript template iframe svg textarea title object canvas audio video select math xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form button dialog menu head fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended widget toolbar pagination pager disclaimer".split()
)
#: Names that inside an article count only as a whole class or id: ``entry-header`` is its own.
WHOLE_NAMES = frozenset("header footer menu notice notices reply replies share sharing social related recommended widget toolbar banner overlay login disclaimer subscription".split())
#: Words that may stand beside a name in a class or id inside an article.
PARTS = frozenset("area bar block body box button buttons container content count form icon icons item items left link links list msg right row section text title top bottom wrap wrapper".split())
#: What a start tag closes first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article main body div section".split())

_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-z]+")


class _Tags:
    """Tags, comments and the like in order, in time linear in the page's length.

    ``_PLAIN`` finds whole tags quicker; where it fails on one, a quote or the page never ends,
    which happens once.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends: behind the first > outside quotes.

        A quote that never ends isn't one; from then on quotes are no longer looked at, so the
        rest of the page is searched once at most.
        """
        page = self.page
        close = page.find(">", at)
        if close < 0:
            return len(page)
        first = close + 1
        while self.quotes:
            marks = [q for q in (page.find('"', at, close), page.find("'", at, close)) if q >= 0]
            if not marks:
                return close + 1
            shut = page.find(page[min(marks)], min(marks) + 1)
            if shut > close:
                close = page.find(">", shut + 1)
            if shut < 0 or close < 0:
                self.quotes = False
                break
            at = shut + 1
        return first

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether an end tag, name, attributes) of the next tag; the name of comments is None."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            following = page[start + 1 : start + 2]
            if following == "!" and page.startswith("--", start + 2):
                if page.startswith((">", "->"), start + 4):
                    return start, page.index(">", start + 4) + 1, False, None, ""
                shut = re.compile(r"--!?>").search(page, start + 4)
                return start, shut.end() if shut else len(page), False, None, ""
            if following in ("!", "?"):
                shut = page.find(">", start)
                return start, len(page) if shut < 0 else shut + 1, False, None, ""
            ending = following == "/"
            if m := _NAME.match(page, start + 1 + ending):
                end = self._end(m.end())
                return start, end, ending, m[0].lower(), page[m.end() : end].removesuffix(">")
            if ending and page[start + 2 : start + 3]:
                shut = page.find(">", start)
                return start, len(page) if shut < 0 else shut + 1, True, None, ""
            at = start + 1
        return None


def _dropped(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is not main text, by its tag, role, names or hidden state; ``inside`` an article."""
    if tag in DROPPED:
        return True
    if not attributes or attributes.isspace():
        return False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id"):
            if inside and tag not in ("article", "main", "body", "html"):
                if any(_telling(word) for word in value.split()):
                    return True
                continue
            words = _WORD.findall(value)
            if tag in ("article", "main", "body", "html"):
                words = [w for w in words if w.startswith("comment")]
            if any(w in NAMES for w in words):
                return True
    return False


def _telling(word: str) -> bool:
    """Whether a whole class or id inside an article is a name, alone or with nothing but names and parts: not ``comments-on-law``."""
    if word in NAMES:
        return True
    words = _WORD.findall(word)
    return any(w in NAMES and w not in WHOLE_NAMES for w in words) and all(w in NAMES or w in PARTS for w in words)


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks in page order.

    Zones: ``a`` article, ``m`` main, ``o`` neither, ``x`` dropped by structure.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (tag, zone inside)
    # Places in the stack of each tag, of blocks and of scopes, so that no search walks the stack.
    where: defaultdict[str, list[int]] = defaultdict(list)
    block_at: list[int] = []
    scope_at: list[int] = []
    zone, held, at, n = "o", [], 0, len(page)
    tags = _Tags(page)

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((zone, text))

    def close(to: int):
        nonlocal zone
        for tag, _ in stack[to:]:
            where[tag].pop()
        del stack[to:]
        for places in (block_at, scope_at):
            while places and places[-1] >= to:
                places.pop()
        zone = stack[-1][1] if stack else "o"

    while at < n:
        end = page.find("<", at)
        if end >= 0 and tags.quotes and (m := _PLAIN.match(page, end)):  # nearly all tags
            after, ending, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        elif found := tags.next(at):
            end, after, ending, tag, attributes = found
        else:
            end, after, tag = n, n, None
        if end > at:
            piece = page[at:end]
            held.append(html.unescape(piece) if "&" in piece else piece)
        at = after
        if tag is None:
            continue
        if ending:
            if tag in BLOCK:
                flush()
            elif tag in ("td", "th"):
                held.append(" ")
            if where[tag]:
                i = where[tag][-1]
                if stack[i][1] != (stack[i - 1][1] if i else "o"):
                    flush()
                close(i)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = shut.end() if shut else n
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if where["p"] and where["p"][-1] == block_at[-1]:  # a block ends an open paragraph
                close(where["p"][-1])
        elif tag in ("br", "td", "th", "img", "input", "wbr"):
            held.append("" if tag == "wbr" else " ")
        if tag in _CLOSES:
            i = max((where[t][-1] for t in _CLOSES[tag] if where[t]), default=-1)
            if i > (scope_at[-1] if scope_at else -1):
                close(i)
        if tag in VOID:
            continue
        inner = zone
        if zone != "x":
            if _dropped(tag, attributes, zone in "am"):
                inner = "x"
            elif tag == "article":
                inner = "a"
            elif zone != "a" and (tag == "main" or "role" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes, re.I)):
                inner = "m"
        if inner != zone and tag not in BLOCK:
            flush()
        where[tag].append(len(stack))
        if tag in BLOCK:
            block_at.append(len(stack))
        if tag in _SCOPES:
            scope_at.append(len(stack))
        stack.append((tag, inner))
        zone = inner
    flush()
    return out


def main_zone(parts: list[tuple[str, str]]) -> str:
    """Zones of the main text: ``a`` if the page has articles, ``m`` if it has a main element, else ``o``.

    Articles inside of a main element that itself says more than they do are parts of it: ``ma``.
    """
    size = {z: sum(len(t) for x, t in parts if x == z) for z in "am"}
    if size["m"] > size["a"]:
        return "ma" if size["a"] else "m"
    return "a" if size["a"] else "o"


def stream(parts: list[tuple[str, str]]) -> np.ndarray:
    """Codes (CRC-32) of a page's tokens, with a mark's code behind each block."""
    tokens = "".join(f"{text} \0 " for _, text in parts).encode("utf-8", "replace").split(b" ")[:-1]
    return np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def seeds(codes: np.ndarray, size: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimizers of a stream, and the 64-bit hashes of their ``size`` tokens."""
    if len(codes) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        values, step = codes.astype(np.uint64) + np.uint64(1), _STEP

        def longer(x, k, y):  # strings of k tokens followed by others
            return x[: len(y) - k] * np.uint64(pow(int(step), k, 1 << 64)) + y[k:] if len(y) > k else x[:0]

        span, doubled, done, whole = 1, values, 0, None
        for bit in range(size.bit_length()):
            if size >> bit & 1:
                whole, done = (doubled, span) if whole is None else (longer(doubled, span, whole)[: len(codes) - done - span + 1], done + span)
            if bit + 1 < size.bit_length():
                doubled, span = longer(doubled, span, doubled), 2 * span
        values = whole
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    # Least of each window, the first of equal ones, from windows of half the size.
    least, span, window = np.arange(len(values)), 1, min(window, len(values))
    while span < window:
        more = min(span, window - span)
        left, right = least[: len(least) - more], least[more:]
        least, span = np.where(values[right] < values[left], right, left), span + more
    places = least[np.r_[True, least[1:] != least[:-1]]]
    return places, values[places]


def _held(pages: DataFrame, page_id: str, url: str, markup: str) -> DataFrame:
    """(page_id, url, host, html, page, check): two hashes tell pages of a host apart by their content."""
    at = F.col(f"`{url}`").cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(at, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.xxhash64(host).alias("host"), F.coalesce(F.col(f"`{markup}`").cast("string"), F.lit("")).alias("html"))
    return rows.withColumns({"page": F.xxhash64("host", "html"), "check": F.xxhash64(F.lit(1), "html", "host")})


def recurring(held: DataFrame, least_pages: int = REPEAT_PAGES) -> DataFrame:
    """(seed, pages) of the seeds on at least ``least_pages`` pages of a host, from distinct pages."""

    def cut_up(batches):
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for host, text in zip(batch["host"], batch["html"], strict=True):
                _, values = seeds(stream(blocks(text)))
                found.append(np.unique(values) ^ np.int64(host).astype(np.uint64))
            yield pd.DataFrame({"seed": np.concatenate(found).view(np.int64)})

    met = held.select("host", "html").mapInPandas(cut_up, "seed long")
    return met.groupBy("seed").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)


def distinct(held: DataFrame) -> DataFrame:
    """``held`` with one of the rows of each page of a host; pages stay where they are read."""
    held = held.withColumn("_row", F.monotonically_increasing_id())
    copies = held.groupBy("page", "check").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return join_small(held, cut(copies), ["page", "check"]).where(F.col("_first").isNull() | (F.col("_first") == F.col("_row"))).drop("_first", "_row")


def suffixes(held: DataFrame, common: DataFrame) -> DataFrame:
    """(seed, content, page, at): suffixes that begin at recurring seeds, of distinct pages.

    ``seed`` tells host and ``SEED`` tokens; ``content`` has the codes, of four bytes each, of up
    to DEPTH tokens behind it or, for suffixes that are read back, before it.  ``at`` holds the
    place in the stream and three bits: read back, a page without an article or main element, a
    seed on nearly all pages of the host.  ``common`` is checkpointed; if its bytes allow, its
    seeds are sent to the tasks, which then cut up no others.
    """
    joined = near(common)
    sieve = None if joined is common else held.sparkSession.sparkContext.broadcast(np.sort(common.select("seed").toPandas()["seed"].to_numpy()))
    hosts = held.groupBy("host").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= HOST_PAGES)

    def cut_up(batches):
        for batch in batches:
            out = []
            for host, page, most, text in zip(batch["host"], batch["page"], batch["all"], batch["html"], strict=True):
                parts = blocks(text)
                codes = stream(parts)
                places, values = seeds(codes)
                keys = (values ^ np.int64(host).astype(np.uint64)).view(np.int64)
                if sieve is not None:
                    at = np.searchsorted(sieve.value, keys)
                    some = np.take(sieve.value, at, mode="clip") == keys if len(sieve.value) else np.zeros(len(keys), bool)
                    keys, places = keys[some], places[some]
                silent, n = 2 * (main_zone(parts) == "o"), len(codes)
                on, back = codes.astype(">u4").tobytes(), codes[::-1].astype(">u4").tobytes()
                for seed, p in zip(keys.tolist(), places.tolist(), strict=True):
                    q = n - p
                    out.append((seed, page, most, 8 * p + silent, on[4 * (p + SEED) : 4 * (p + SEED + DEPTH)], back[4 * q : 4 * (q + DEPTH)]))
            yield pd.DataFrame(out, columns=["seed", "page", "all", "at", "on", "back"])

    found = join_small(held.select("host", "page", "html"), cut(hosts), ["host"]).withColumn("all", F.coalesce("all", F.lit(1 << 62)))
    found = found.mapInPandas(cut_up, "seed long, page long, all long, at long, on binary, back binary")
    found = join_small(found, common, ["seed"]).where(F.col("pages").isNotNull())  # a run on every page of a host is one seed
    template = F.when(F.col("pages") >= HOST_SHARE * F.col("all"), 1).otherwise(0)
    return found.select("seed", "page", (F.col("at") + template).alias("at"), F.posexplode(F.array("on", "back")).alias("side", "content")).select("seed", "content", "page", (F.col("at") + 4 * F.col("side")).alias("at"))


def _lengths(entries: list[tuple[tuple[int, int], bytes, int]], first: int, last: int, least_pages: int) -> list[int]:
    """For the sorted entries ``first`` to ``last`` - 1: tokens behind the seed in common with those of so many pages.

    The others are neighbours' edges; entries are distinct (seed and side, content, page).
    """
    n = len(entries)
    size = np.array([len(e[1]) // 4 for e in entries], np.int64)
    codes = np.frombuffer(b"".join(e[1].ljust(4 * DEPTH, b"\0") for e in entries), ">u4").reshape(n, DEPTH)
    common = np.minimum((codes[1:] == codes[:-1]).cumprod(axis=1).sum(axis=1), np.minimum(size[1:], size[:-1])).tolist()
    common = [c if entries[i][0] == entries[i + 1][0] else -1 for i, c in enumerate(common)]
    out = []
    for i in range(first, last):
        near_ones = []
        for step in (-1, 1):
            j, shared, seen = i, int(size[i]), {entries[i][2]}
            while len(seen) < least_pages and 0 <= j + step < n:
                shared = min(shared, common[j - (step < 0)])
                j += step
                if shared < 0:
                    break
                if entries[j][2] not in seen:
                    seen.add(entries[j][2])
                    near_ones.append((shared, entries[j][2]))
        seen, length = {entries[i][2]}, int(size[i]) if least_pages == 1 else -SEED
        for shared, page in sorted(near_ones, reverse=True):
            seen.add(page)
            if len(seen) == least_pages:
                length = shared
                break
        out.append(length)
    return out


def _distinct(batches) -> tuple[pd.DataFrame, np.ndarray, list[tuple[tuple[int, int], bytes, int]]]:
    """Rows of a sorted partition, the entry of each, and the distinct entries."""
    rows = pd.concat(batches, ignore_index=True)
    entries, which = [], []
    for e in zip(zip(rows["seed"], rows["side"], strict=True), map(bytes, rows["content"]), rows["page"], strict=True):
        if not entries or e != entries[-1]:
            entries.append(e)
        which.append(len(entries) - 1)
    return rows, np.array(which), entries


def repeats(found: DataFrame, least_pages: int = REPEAT_PAGES) -> DataFrame:
    """(page, start, stop, silent, template) of the runs from seeds that are on ``least_pages`` distinct pages.

    The suffix array: sorted by ranges, its order checkpointed.  A range needs the nearest
    entries of the ranges around it; those edges, of a fixed number of pages per range, go
    through the driver.
    """
    spark = found.sparkSession
    side = F.col("at").bitwiseAND(4).cast("int").alias("side")
    order = ["seed", side, "content", "page"]
    found = cut(found)  # else the ranges' sample would cut up all pages once more
    array = cut(found.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)).select("seed", side, "content", "page", "at")
    edge_pages = 2 * least_pages

    def edges(batches):
        from pyspark import TaskContext

        batches = [b for b in batches if len(b)]
        if batches:
            _, _, entries = _distinct(batches)
            for kind, ordered in ((0, entries), (1, entries[::-1])):
                seen, out = set(), []
                for e in ordered:
                    if e[2] not in seen:
                        seen.add(e[2])
                        out.append((TaskContext.get().partitionId(), kind, len(out), *e[0], *e[1:]))
                    if len(seen) == edge_pages:
                        break
                yield pd.DataFrame(out, columns=["part", "kind", "n", "seed", "side", "content", "page"])

    schema = "part int, kind int, n int, seed long, side int, content binary, page long"
    ends: tuple[dict[int, list[tuple]], dict[int, list[tuple]]] = {}, {}
    for r in sorted(array.drop("at").mapInPandas(edges, schema).collect(), key=lambda r: (r.part, r.n)):
        ends[r.kind].setdefault(r.part, []).append(((r.seed, r.side), bytes(r.content), r.page))
    parts = sorted(ends[0])
    around: dict[int, tuple[list[tuple], list[tuple]]] = {}
    for i, part in enumerate(parts):
        before, after = [], []
        for other in reversed(parts[:i]):
            before += ends[1][other]
            if len(before) >= edge_pages:
                break
        for other in parts[i + 1 :]:
            after += ends[0][other]
            if len(after) >= edge_pages:
                break
        around[part] = before[::-1], after
    shared = spark.sparkContext.broadcast(around)

    def measured(batches):
        from pyspark import TaskContext

        batches = [b for b in batches if len(b)]
        if batches:
            rows, which, entries = _distinct(batches)
            before, after = shared.value[TaskContext.get().partitionId()]
            beyond = np.array(_lengths([*before, *entries, *after], len(before), len(before) + len(entries), least_pages), np.int64)[which]
            at, back = rows["at"].to_numpy(), rows["side"].to_numpy() > 0
            place = at >> 3
            start, stop = np.where(back, place - beyond, place), place + SEED + np.where(back, 0, beyond)
            yield pd.DataFrame({"page": rows["page"], "start": start.astype(np.int32), "stop": stop.astype(np.int32), "silent": (at & 2) > 0, "template": (at & 1) > 0})[beyond >= 0]

    return array.mapInPandas(measured, "page long, start int, stop int, silent boolean, template boolean")


def covered(held: DataFrame, least_pages: int = REPEAT_PAGES) -> DataFrame:
    """(page, runs) of the pages that share runs with others: (start, stop, gone), ``gone`` if the run is boilerplate."""
    held = distinct(held)
    common = cut(recurring(held, least_pages))
    found = repeats(suffixes(held, common), least_pages)
    run = F.struct("start", "stop", (F.col("silent") | F.col("template")).alias("gone"))
    return found.groupBy("page").agg(F.collect_set(run).alias("runs"))  # bounded by the page


def decide(parts: list[tuple[str, str]], gone: np.ndarray | None) -> str:
    """Main text of a page's blocks; ``gone`` marks the covered tokens of its stream.

    Articles lose whole blocks, other pages lose runs.  Where nothing would stay, the page is a
    copy rather than boilerplate, and stays as it is.
    """
    best = main_zone(parts)
    kept, at = [], 0
    for zone, text in parts:
        words = text.split(" ")
        mine = gone[at : at + len(words)] if gone is not None else None
        at += len(words) + 1
        if zone not in best:
            continue
        if mine is None or not mine.any() or best != "o" and not mine.all():
            kept.append(text)
        elif not mine.all():
            kept.append(" ".join(w for w, g in zip(words, mine, strict=True) if not g))
    if not kept and gone is not None:
        return decide(parts, None)
    return "\n\n".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", least_pages: int = REPEAT_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_gone), a row per row of ``pages``.

    Text blocks have single spaces and are joined by an empty line.  Null and empty pages have
    an empty text.  Rows may repeat and keys be null; a null or odd url counts as the host ''.
    Pages of a host with equal markup are one page.  ``n_shared``: tokens of the page (ends of
    blocks are tokens too) in runs that it shares with pages of its host; ``n_gone``: those that
    are boilerplate by the rules above.  Other columns aren't carried.
    """
    kinds = dict(pages.dtypes)
    held = _held(pages, page_id, url, markup)
    runs = cut(covered(held, least_pages))

    def work(batches):
        for batch in batches:
            texts, counts = [], []
            for text, found in zip(batch["html"], batch["runs"], strict=True):
                parts, marks = blocks(text), None
                if found is not None and len(found):
                    marks = np.zeros((2, sum(t.count(" ") + 2 for _, t in parts)), bool)
                    for r in found:
                        marks[0, r["start"] : r["stop"]] = True
                        if r["gone"]:
                            marks[1, r["start"] : r["stop"]] = True
                texts.append(decide(parts, marks[1] if marks is not None and marks[1].any() else None))
                counts.append((0, 0) if marks is None else tuple(marks.sum(axis=1).tolist()))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_shared": [a for a, _ in counts], "n_gone": [b for _, b in counts]})

    joined = join_small(held.drop("host", "check"), runs, ["page"]).select("page_id", "url", "html", "runs")
    out = joined.mapInPandas(work, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_shared long, n_gone long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_gone")
