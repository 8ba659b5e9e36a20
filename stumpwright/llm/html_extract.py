"""Operator 8: main text of web pages, by structure and by a suffix array per host.

A page is cut into blocks by one linear scan. Blocks inside a declared main container (article, main)
but outside its menus, forms, adverts and reader comments are main; blocks in menus, headers, footers
and the like are chrome; all others are plain. A host's pages are concatenated as token streams of
all their blocks. A suffix array over the streams finds runs of MIN_RUN tokens or more that recur on distinct pages, and decides which blocks of
every page are boilerplate:

* plain blocks: those all of whose words are in runs that recur go, and of the others the runs on at
  least OFTEN pages and SHARE of the host's pages;
* the container's blocks: only as a whole, and only if all words are in runs on at least MAIN_OFTEN
  pages and MAIN_SHARE of the host's pages, as repeats inside articles are mostly quotations and
  reprints (see README for figures). The middle ones, all but EDGE short blocks at its ends, are judged
  by runs within middles, which do not count for blocks elsewhere.

What is left, in page order, is the page's text.

A host's streams are dealt by their hash into parts of about PART_TOKENS; with several parts,
window counts are summed over the parts first, so a run on pages of two parts counts too (one of
middles from the parts where it is on half of the pages or more). Pages with equal streams are one page here.

Words of a class or an id make chrome only of containers (div, section, lists and the like), only as
whole furniture names (related-posts, but not related-work), and inside a main container never of
headings or paragraphs, but for paragraphs whose class is an advert's.

Nulls: null html is an empty page, a null url an empty host. Repeated rows each give a row; an
empty table gives none; extra columns are ignored. Pages are taken whole; a very long one, with tags,
quotes or comments that never close, takes time in proportion to its length.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.llm.common import only, size_of, utf8, written

MIN_RUN = 6
#: A run within a plain block is boilerplate from so many pages on, and from this share (numerator, denominator) of the host's.
OFTEN = 3
SHARE = (1, 4)
#: Blocks at each end of a main container, and words of a block at most, that are judged; and from when on such a block is boilerplate.
EDGE = 2
END_WORDS = 32
MAIN_OFTEN = 8
MAIN_SHARE = (3, 4)
PART_TOKENS = 500_000
#: zstd level of the table of streams.
TABLE_LEVEL = 6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_MARK = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript iframe textarea title xmp noembed noframes".split()}
_CHROME_TAGS = frozenset("head nav footer aside form dialog button menu template svg select datalist canvas audio video".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
#: Names of page furniture: the first always, the second beside other such names and fillers only.
_STRONG = frozenset("navbar sidebar masthead advert adverts advertisement advertisements adsbygoogle sponsored commentlist breadcrumb breadcrumbs newsletter popup modal toolbar pagination".split())
_WEAK = frozenset(
    "nav navigation menu footer ad ads sponsor promo banner cookie cookies consent notice notices comment comments respond reply replies share sharing social related "
    "subscribe signup widget widgets skip".split()
)
_FILLER = frozenset(
    "box list area section wrapper wrap container block bar button buttons link links post posts article articles body content item items story stories page site main top bottom "
    "left right inline in entry form icon icons media thread title heading header inner outer group row col column unit slot text module panel overlay message info you may also "
    "like more this to primary secondary global mobile desktop sticky fixed".split()
)
_ADVERTS = frozenset("ad ads advert adverts advertisement sponsored".split())
_TALK = frozenset("discussion discuss responses feedback forum comments".split())
_MARKED = frozenset("div section ul ol dl li header main article center details figure table".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A block closes an open p, and these an open one of their own; neither reaches over the elements named.
_P_SCOPE = frozenset("td th caption button template table".split())
_SAME = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "option": frozenset(("select",))}
_MAIN, _CHROME, _PLAIN = "main", "chrome", "plain"


def _markup(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") of a page, in one pass.

    A quote that never closes is an ordinary character; a tag that never closes ends the page, as does
    an open comment or script."""
    at, n, last = 0, len(page), {q: page.rfind(q) for q in "\"'>"}
    quotes = True
    while True:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        head = page[lt + 1 : lt + 2]
        if page.startswith("!--", lt + 1):
            yield "text", page[at:lt], ""
            end = page.find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
            continue
        if head in ("!", "?") or (head == "/" and not page[lt + 2 : lt + 3].isalpha()):
            yield "text", page[at:lt], ""
            at = page.find(">", lt) + 1 if last[">"] > lt else n
            continue
        close = head == "/"
        name = _NAME.match(page, lt + 1 + close)
        if not name:
            yield "text", page[at : lt + 1], ""
            at = lt + 1
            continue
        yield "text", page[at:lt], ""
        if last[">"] < lt:
            return
        end = name.end()
        while quotes:
            stop = _STOP.search(page, end)
            if not stop:  # all that follows is in quotes: from here on, a tag ends at its next >
                quotes = False
                break
            end = stop.start()
            if page[end] == ">":
                break
            k = end - 1
            while page[k].isspace():
                k -= 1
            end = page.find(page[end], end + 1) + 1 if page[k] == "=" and last[page[end]] > end else end + 1
        if not quotes:
            end = page.find(">", name.end())
        tag = name[0].lower()
        yield ("close" if close else "open"), tag, page[name.end() : end]
        at = end + 1
        if not close and tag in _RAW and not page[end - 1] == "/":
            done = _RAW[tag].search(page, at)
            at = done.start() if done else n


def _names(value: str) -> list[str]:
    return [w.lower() for w in _CAMEL.sub("-", value).split()]


def _furniture(name: str, more: frozenset[str] = frozenset()) -> bool:
    words = [w for w in re.split("[-_]+", name) if w and not w.isdigit()]
    own = [w in _WEAK or w in more for w in words]
    return any(w in _STRONG for w in words) or (any(own) and all(o or w in _FILLER for o, w in zip(own, words)))


_HEADER = frozenset(("header",))


def _zone(tag: str, attrs: str, outer: str, talk: bool) -> tuple[str, bool]:
    """The zone inside an element, and whether it is in a discussion."""
    if outer == _CHROME or tag in _CHROME_TAGS or (tag == "article" and talk):
        return _CHROME, talk
    inner = _MAIN if tag in ("article", "main") else outer
    if tag == "header" and outer != _MAIN:
        return _CHROME, talk
    if "=" in attrs:
        for kind, *values in _MARK.findall(attrs):
            value = "".join(values).strip()
            if kind.lower() == "role":
                if value.lower() in _CHROME_ROLES:
                    return _CHROME, talk
                inner = _MAIN if value.lower() in ("main", "article") else inner
                continue
            names = _names(value)
            if tag in _MARKED and (outer == _MAIN or tag not in ("article", "main")):
                if any(_furniture(x, _HEADER if outer != _MAIN else frozenset()) for x in names):
                    return _CHROME, talk
                talk = talk or any(w in _TALK for x in names for w in re.split("[-_]+", x))
            elif tag == "p" and any(x in _ADVERTS for x in names):
                return _CHROME, talk
    return inner, talk


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block that has text, in page order."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str, bool]] = [("", _PLAIN, False)]
    count: Counter[str] = Counter()

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((stack[-1][1], joined))
            text.clear()

    def close(depth: int) -> None:
        if stack[depth][1] != stack[-1][1] or stack[depth - 1][1] != stack[-1][1]:
            flush()
        for tag, _, _ in stack[depth:]:
            count[tag] -= 1
        del stack[depth:]

    def implied(tag: str, scope: frozenset[str]) -> None:
        """Close an open element of the tag that no element of the scope shields."""
        if count[tag]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    return close(i)
                if stack[i][0] in scope:
                    return None

    for kind, tag, attrs in _markup(page or ""):
        if kind == "text":
            if tag:
                text.append(html_lib.unescape(tag) if "&" in tag else tag)
            continue
        if tag == "br":
            text.append(" ")
        if tag in _BLOCKS:
            flush()
        if kind == "close":
            if count[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in _BLOCKS:
            implied("p", _P_SCOPE)
            if tag in _SAME:
                implied(tag, _SAME[tag])
        if tag in _VOID or tag in _RAW or attrs.endswith("/"):
            continue
        if tag == "body":
            count.clear()
            del stack[1:]
        zone, talk = _zone(tag, attrs, *stack[-1][1:])
        if zone != stack[-1][1]:
            flush()
        stack.append((tag, zone, talk))
        count[tag] += 1
    flush()
    return out


#: What a block is in the tables: never text, judged as a whole or by runs, judged as a whole only, a container's middle.
CHROME, PLAIN, END, TEXT = range(4)


def kinds_of(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block that has text, in page order."""
    found = blocks_of(page)
    main = [i for i, (zone, _) in enumerate(found) if zone == _MAIN]
    ends = {i for i in (*main[:EDGE], *main[max(0, len(main) - EDGE) :]) if found[i][1].count(" ") < END_WORDS}
    return [(CHROME if zone == _CHROME else PLAIN if zone == _PLAIN else END if i in ends else TEXT, text) for i, (zone, text) in enumerate(found)]


def _read(page: str | None) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The blocks that may be text, and the token stream's blocks, which are all; each (kind, text)."""
    found = kinds_of(page)
    return [b for b in found if b[0] != CHROME], found


def _flat(stream: list[tuple[int, str]]) -> bytes:
    """A stream as one string: the kinds, then a block a line; white space of a block is spaces only."""
    return utf8("\n".join(("".join(str(k) for k, _ in stream), *(t for _, t in stream))))


def _blocks(flat: bytes) -> list[tuple[int, str]]:
    kinds, *texts = flat.decode("utf-8", "surrogatepass").split("\n")
    return [(int(k), t) for k, t in zip(kinds, texts)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the column flat compressed, for a shuffle. A table keeps it plain: its files are compressed over many rows, which is smaller."""
    for batch in batches:
        at = batch.schema.get_field_index("flat")
        yield batch.set_column(at, "flat", pa.array([zlib.compress(x, 6) for x in batch.column(at).to_pylist()], pa.binary()))


_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page row: page_id, url, text (blocks joined by an empty line; empty if none), n_chars."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = only(pages, page_id=page_id, url=url, html=html).withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            streams = [_read(x)[1] for x in batch.column("html").to_pylist()]
            flat = [_flat(s) for s in streams]
            keys = [_digest(x) >> 1 for x in flat]
            first = []
            for own in zip(batch.column("host").to_pylist(), keys):
                first.append(own not in seen)
                seen.add(own)
            size = pa.array([sum(t.count(" ") + 1 for _, t in s) for s in streams], pa.int64())
            cols = [batch.column(c) for c in ("page_id", "url", "host")]
            made = [pa.array(keys, pa.int64()), pa.array(first, pa.bool_()), size, pa.array(flat, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *made], ["page_id", "url", "host", "key", "first", "size", "flat"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = (zlib.decompress(x) if shuffled else x for x in batch.column("flat").to_pylist())
            texts = pa.array([_merged(_blocks(b), k) for b, k in zip(flat, batch.column("kept").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    read = written(rows.mapInArrow(parsed, f"page_id {kind}, url string, host string, key long, first boolean, size long, flat binary"), level=TABLE_LEVEL)
    # a task's first row of each stream, so equal pages don't meet in one task
    verdicts = written(unique_runs(read.where("first").select("host", "key", "size", "flat")))  # only of streams that lose something
    texts = read.select("page_id", "url", "host", "key", "flat")
    shuffled = size_of(verdicts) > pages.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if shuffled:
        out = texts.mapInArrow(_packed, texts.schema).join(verdicts.hint("merge"), ["host", "key"], "left")
    else:
        out = texts.join(F.broadcast(verdicts), ["host", "key"], "left")
    return out.select("page_id", "url", "flat", "kept").mapInArrow(merged, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def _merged(stream: list[tuple[int, str]], kept: list[str | None] | None) -> str:
    """The text of the blocks, those that lose something as the verdict has them."""
    texts = [t for k, t in stream if k != CHROME]
    return "\n\n".join(x for x in (texts if kept is None else (t if k is None else k for t, k in zip(texts, kept))) if x)


def unique_runs(streams: DataFrame) -> DataFrame:
    """host, key, kept: of each stream that loses something, its blocks but chrome: null if unchanged, empty where nothing is kept.

    streams: host, key, size (tokens), flat (the blocks); rows of one host and key are one page."""
    each = streams.groupBy("host", "key").agg(F.first("size").alias("size"))
    per_host = each.groupBy("host").agg(F.sum("size").alias("n"), F.count("*").alias("of")).select("host", F.greatest(F.ceil(F.col("n") / PART_TOKENS), F.lit(1)).cast("int").alias("parts"), "of")
    # a table, so that its size on disk decides the join
    packed = streams.drop("size")
    packed = packed.mapInArrow(_packed, packed.schema)
    dealt = packed.join(written(per_host), "host").withColumn("part", F.pmod("key", F.col("parts")).cast("int"))
    keys = ["host", "part"]
    # without a filter, so that both read one exchange
    shared = (
        dealt.groupBy(*keys).applyInArrow(_window_counts, "host string, part int, window long, n long, n_middle long")
    )
    several = shared.groupBy("host", "window").agg(F.sum("n").alias("n"), F.sum("n_middle").alias("n_middle"), F.collect_set("part").alias("ps")).where("n > 1 or n_middle > 1")
    several = several.select("host", F.explode("ps").alias("part"), "window", "n", "n_middle")
    return (
        dealt.groupBy(*keys).cogroup(several.groupBy(*keys)).applyInArrow(_unique, "host string, key long, kept array<string>")
    )


class _Suffixes:
    """Suffixes of the streams in the order of their first MIN_RUN tokens; equal ones have one rank."""

    def __init__(self, streams: list[list[tuple[int, str]]]):
        known: dict[str, int] = {}
        tokens, owner, text, self.blocks = [], [], [], []
        for p, stream in enumerate(streams):
            own = []
            for kind, block in stream:
                words = block.split(" ")
                own.append((kind, words, len(tokens)))
                tokens += [known.setdefault(w, len(known)) for w in words]
                text += [kind == TEXT] * len(words)
            tokens.append(-1)
            text.append(False)
            owner += [p] * (len(tokens) - len(owner))
            self.blocks.append(own)
        self.words = list(known)
        self.tokens = np.array(tokens, np.int64)
        self.owner = np.array(owner, np.int64)
        n = len(tokens)
        inside = np.flatnonzero(self.tokens == -1)
        left = inside[np.searchsorted(inside, np.arange(n))] - np.arange(n) if n else np.zeros(0, np.int64)
        rank = self.tokens + 1  # numbers of words, in the order they came
        depth = 1
        while depth < MIN_RUN:
            step = min(depth, MIN_RUN - depth)
            after = np.full(n, -1, np.int64)
            after[: n - step] = rank[step:]
            rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            depth += step
        self.order = np.argsort(rank, kind="stable")
        self.at = self.order[left[self.order] >= MIN_RUN]
        self.rank = rank[self.at]
        before = np.r_[0, np.cumsum(np.array(text, np.int64))]
        inside = before[self.at + MIN_RUN] - before[self.at]
        #: Whether none, or all, of the suffix's first MIN_RUN words are of a container's middle.
        self.apart, self.middle = inside == 0, inside == MIN_RUN

    def pages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per suffix in order: the number of its run, on how many pages that run is apart from containers' middles, and on how many within."""
        if not len(self.at):
            return (np.zeros(0, np.int64),) * 3
        run = np.cumsum(np.r_[False, self.rank[1:] != self.rank[:-1]])

        def on(some: np.ndarray) -> np.ndarray:
            r, owner = run[some], self.owner[self.at][some]  # equal runs are in order of place, so of owner
            new = np.r_[True, (r[1:] != r[:-1]) | (owner[1:] != owner[:-1])] if len(r) else r.astype(bool)
            return np.bincount(r[new], minlength=run[-1] + 1)[run]

        return run, on(self.apart), on(self.middle)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        word = np.array([_digest(utf8(w)) for w in self.words] or [0], np.uint64)
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(MIN_RUN):
                h = (h ^ word[self.tokens[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h.astype(np.int64)


def _digest(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def _streams(group: pa.Table) -> tuple[np.ndarray, list[list[tuple[int, str]]]]:
    """The distinct keys, and their streams."""
    keys, at = np.unique(group.column("key").to_numpy(), return_index=True)
    return keys, [_blocks(zlib.decompress(x)) for x in group.column("flat").take(pa.array(at)).to_pylist()]


def _window_counts(group: pa.Table) -> pa.Table:
    """The runs of a part and on how many of its pages they are; those of containers' middles alone only from half of the pages on,
    as a run on less decides nothing there."""
    if group.column("parts")[0].as_py() == 1:
        return pa.table({"host": pa.array([], pa.string()), "part": pa.array([], pa.int32())} | {c: pa.array([], pa.int64()) for c in ("window", "n", "n_middle")})
    keys, streams = _streams(group)
    s = _Suffixes(streams)
    run, pages, middle = s.pages()
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else run
    first = first[(pages[first] > 0) | (middle[first] * 2 >= len(keys))]
    n = len(first)
    return pa.table({"host": [group.column("host")[0].as_py()] * n, "part": pa.array([group.column("part")[0].as_py()] * n, pa.int32()), "window": pa.array(s.hashes(s.at[first]), pa.int64()), "n": pa.array(pages[first], pa.int64()), "n_middle": pa.array(middle[first], pa.int64())})


def _unique(group: pa.Table, several: pa.Table) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    if group.num_rows:
        keys, streams = _streams(group)
        s = _Suffixes(streams)
        _, pages, inner = s.pages()
        if several.num_rows:
            window, n, n_middle = (several.column(c).to_numpy() for c in ("window", "n", "n_middle"))
            order = np.argsort(window)
            own = s.hashes(s.at)
            k = order[np.minimum(np.searchsorted(window, own, sorter=order), len(order) - 1)]
            pages, inner = (np.where(window[k] == own, x[k], y) for x, y in ((n, pages), (n_middle, inner)))
        of = group.column("of")[0].as_py()
        mostly = lambda x: (x >= MAIN_OFTEN) & (x * MAIN_SHARE[1] >= of * MAIN_SHARE[0])
        often = (pages >= OFTEN) & (pages * SHARE[1] >= of * SHARE[0])
        again, often, ends, middle = (_covered(s, x) for x in (s.apart & (pages > 1), s.apart & often, s.apart & mostly(pages), s.middle & mostly(inner)))
        host = group.column("host")[0].as_py()
        for key, blocks in zip(keys.tolist(), s.blocks):
            judged = [b for b in blocks if b[0] != CHROME]
            kept = []
            for kind, words, at in judged:
                own = slice(at, at + len(words))
                kept.append(_kept(words, again[own], often[own]) if kind == PLAIN else [] if (ends if kind == END else middle)[own].all() else words)
            if any(len(a) != len(b[1]) for a, b in zip(kept, judged)):
                for column, x in zip(out, (host, key, [None if len(a) == len(b[1]) else " ".join(a) for a, b in zip(kept, judged)])):
                    column.append(x)
    return pa.table({"host": pa.array(out[0], pa.string()), "key": pa.array(out[1], pa.int64()), "kept": pa.array(out[2], pa.list_(pa.string()))})


def _covered(s: _Suffixes, runs: np.ndarray) -> np.ndarray:
    """Per token whether one of the chosen suffixes has it in its first MIN_RUN tokens."""
    covered = np.zeros(len(s.tokens) + 1, np.int64)
    np.add.at(covered, s.at[runs], 1)
    np.add.at(covered, s.at[runs] + MIN_RUN, -1)
    return np.cumsum(covered) > 0


def _kept(words: list[str], again: np.ndarray, often: np.ndarray) -> list[str]:
    """None of a block that recurs as a whole, else its words but for runs found often. A run that reaches
    into the block from its neighbour counts only if it has MIN_RUN words in it."""
    if again.all():
        return []
    if not often.any():
        return words
    edges = np.flatnonzero(np.diff(np.r_[False, often, False].astype(np.int8)))
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= MIN_RUN:
            out += words[at:a]
            at = b
    return out + words[at:]
