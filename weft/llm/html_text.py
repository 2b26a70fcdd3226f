"""Main text of web pages by a host suffix array.

Each page is cut into blocks. Blocks of an article or main element are text by
markup; navigation, forms, adverts, notices and comments are boilerplate by
markup; the rest is undecided. The token streams of all blocks of all pages are
concatenated per host, and suffix arrays over them, one per trigger of the
host's prefix-free parse, find the long substrings that half of the host's
pages repeat. Undecided blocks keep what is not repeated. Blocks that are text
by markup go only as a whole, and only if the host has five pages or more; those
of them whose class names hint at boilerplate go as a whole on any host.
Copies of a page count as one page, and a page of repeats alone keeps its text.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernels as K
from weft.llm.frames import NULL_ID, cut, mapped, row_id, table, text_key
from weft.llm.phrases import HOT_PHRASES, by_trigger, hot_marks, split_hot

#: Bytes of a repeated substring at least, and of its trigger's slice.
REPEAT_BYTES = 48
_ANCHOR_BYTES = 8
#: Pages of a host that repeat a substring: one of so many, two pages at least; and so many before a block of marked text goes.
HOST_SHARE = 2
MARKED_PAGES = 3
_SIEVE_BITS = 26
_LOW = (1 << 40) - 1  # of a trigger, where triggers are only counted

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)
#: Elements without text, of boilerplate, inline, empty, and those that an opening tag of the same kind ends.
NO_TEXT = frozenset("script style noscript template svg math iframe object canvas textarea select option head title button video audio map datalist".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
SECTIONS = frozenset("nav header footer article main h1".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY_OWN = frozenset("p li dt dd tr td th option".split())
#: Parts of class and other names that mark boilerplate, main text, headers of the text itself, and names that only state whether something is there.
_BAD = re.compile(r"ad|ads|advert\w*|adv|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer\w*|header|masthead|cookie\w*|consent\w*|gdpr|notices?|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|search\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|comment\w*|disqus\w*|replies|respond|widget\w*|toolbar|pagination|pager|skip\w*|contentinfo|complementary")
_GOOD = re.compile(r"article\w*|main|story\w*")
_GOOD_NAMES = frozenset("entry-content post-content post-body content-body".split())
_OWN_HEADER = frozenset("article entry post story content".split())
_STRUCTURE = frozenset(
    "area article articles aside bar block body bottom box button buttons card center col column container content count dropdown entry feed fixed float form global group heading icon icons inline inner item items label left "
    "link links list main mini mobile module outer page panel post posts primary region right row secondary section site slot small stories story strip tab text title top unit wrap wrapper".split()
)
_STATES = frozenset("has with no without is not hide show".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of a page's blocks in order; kind is text, boilerplate, undecided or, in marked text under a name that hints at boilerplate, hint. Takes time in proportion to the page.

    Names and forms only suggest boilerplate: where they leave a page without
    marked text, what stands around its first main element or article is forgiven,
    and a form that holds sections of the page is never one.
    """
    found, around, forms = _walk(page, frozenset())
    if forms:
        found, around, _ = _walk(page, forms)
    if around and all(kind != "text" for kind, _ in found):
        found, _, _ = _walk(page, forms | around)
    return [(kind, text) for kind, text in found if kind != "none"]


def _walk(page: str, forgiven: frozenset[int]) -> tuple[list[tuple[str, str]], frozenset[int], frozenset[int]]:
    """Blocks, the suggestions around the first main element or else article that they hide, and forms around sections; elements by their number."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str, str, int]] = []  # element, kind of what it holds, attributes, number
    opened: Counter[str] = Counter()  # elements of the stack by name
    hidden: dict[str, frozenset[int]] = {}
    forms: set[int] = set()
    kind, at, n, number = "undecided", 0, len(page), 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(("text" if kind == "main" else kind, text))
            parts.clear()

    def leave(name: str) -> str:
        while stack:
            e = stack.pop()[0]
            opened[e] -= 1
            if e == name:
                break
        return stack[-1][1] if stack else "undecided"

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name, attributes = m[2], m[3]
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                parts.append(html.escape(page[m.start() + 9 : at - 3]))
            continue
        name = name.lower()
        if name in INLINE and not m[1] and not _NAMES.search(attributes) and not _HIDDEN.search(attributes):
            continue
        if m[1]:
            new = leave(name) if opened[name] else kind
            if name not in INLINE or new != kind:
                close()
            kind = new
            continue
        if name in VOID:
            if name in ("br", "hr"):
                parts.append(" ")
            continue
        number += 1
        new = _kind(name, attributes, kind, number in forgiven)
        if name not in INLINE or new != kind:
            close()
        if name in ENDED_BY_OWN and stack and stack[-1][0] == name:
            kind = leave(name)
            new = _kind(name, attributes, kind, number in forgiven)
        if attributes.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        if name in _RAW:
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in SECTIONS:
            forms |= {i for e, _, _, i in stack if e == "form"} if opened["form"] else set()
            if name in ARTICLE and kind == "boilerplate" and name not in hidden and _kind("div", attributes, "text") not in ("boilerplate", "none"):
                judged = [(i, _kind(e, its, "undecided"), _kind(e, its, "undecided", True)) for e, _, its, i in stack]
                if all(forgiving not in ("boilerplate", "none") for _, _, forgiving in judged):
                    hidden[name] = frozenset(i for i, k, _ in judged if k == "boilerplate")
        stack.append((name, new, attributes, number))
        opened[name] += 1
        kind = new
    close()
    return out, hidden.get("main", hidden.get("article", frozenset())), frozenset(forms) - forgiven


def _said(name: str, last: bool = False) -> str | None:
    """What one class or other name says of an element: bad, hint, good or nothing.

    A name is bad that has a bad part beside words of structure only; beside
    other words a bad part is but a hint. With last, only the last part counts.
    """
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if not _STATES.isdisjoint(parts):
        return None
    parts = parts[-1:] if last else parts
    bad = [x for x in parts if _BAD.fullmatch(x)]
    if bad == ["header"] and not _OWN_HEADER.isdisjoint(parts):
        return None
    if bad:
        return "bad" if all(x in bad or x in _STRUCTURE or x.isdigit() for x in parts) else "hint"
    return "good" if "-".join(parts) in _GOOD_NAMES or any(_GOOD.fullmatch(x) for x in parts) else None


def _kind(name: str, attributes: str, outer: str, forgiven: bool = False) -> str:
    """Kind of what an element holds. In marked text a heading is no header of the page, and what a name hints at is left to the repeats on the host."""
    if outer == "none" or name in NO_TEXT or attributes and _HIDDEN.search(attributes):
        return "none"
    if outer == "boilerplate" or name in BOILERPLATE or name == "form" and not forgiven:
        return "boilerplate"
    given = " ".join(v.strip("\"'") for v in _NAMES.findall(attributes)).lower().split() if attributes else []
    said = {_said(x, name in ARTICLE) for x in given}  # an article has many names
    if forgiven or name in ("body", "html"):
        said = set()
    marked = outer in ("text", "hint")
    if name in HEADINGS and marked:
        said = {_said(x) for x in given if "header" not in re.split("[-_]+", x)}
    if "bad" in said or "hint" in said and not marked or name == "header" and not marked:
        return "boilerplate"
    if "hint" in said:
        return "hint"
    if name == "article" or "good" in said:
        return "text"
    return "main" if name == "main" and outer == "undecided" else outer


_KINDS = ("boilerplate", "undecided", "text", "hint")
_PAGE = "did long, dh long, url string, hh long, mh long, kinds binary, z binary, size int"


def _blocks(rows: DataFrame) -> DataFrame:
    """The pages with their blocks as lines (zstd), the kinds of the lines and a hash of all lines but boilerplate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            streams, kinds, main = [], [], []
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                streams.append("\n".join(t for _, t in found).encode("utf-8", "replace"))
                kinds.append(bytes(_KINDS.index(k) for k, _ in found))
                kept = "\n".join(t for k, t in found if k != "boilerplate").encode("utf-8", "replace")
                main.append(int.from_bytes(hashlib.blake2b(kept, digest_size=8).digest(), "little", signed=True))
            z = [codec.compress(x, asbytes=True) if x else b"" for x in streams]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(main, pa.int64()), pa.array(kinds, pa.binary()), pa.array(z, pa.binary()), pa.array([len(x) for x in streams], pa.int32())],
                names=["did", "dh", "url", "hh", "mh", "kinds", "z", "size"],
            )

    return rows.transform(mapped, run, _PAGE)


def _streams(batch: pa.RecordBatch) -> list[bytes]:
    return [pa.decompress(z, size, "zstd", asbytes=True) if size else b"" for z, size in zip(batch.column("z").to_pylist(), batch.column("size").to_pylist(), strict=True)]


def _lines(stream: bytes, kinds: bytes, window: int, own: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """(kind, start, line, place in the appendix or -1) of each block; see _laid_out."""
    at, end = 0, len(stream)
    for kind, line in zip(kinds, stream.split(b"\n") if kinds else [], strict=True):
        short = kind in (1, 3) and len(line) < window
        yield kind, at, line, end + len(own) if short else -1
        at += len(line) + 1
        if short:
            end += len(own) + window


def _laid_out(stream: bytes, kinds: bytes, window: int, own: bytes) -> bytes:
    """The stream and, as an appendix, its short blocks that are undecided or hints filled up to a window each, set apart by what no other page has."""
    short = [line for _, _, line, place in _lines(stream, kinds, window, own) if place >= 0]
    return b"".join([stream, *(own + b"\0" + line + b"\0" * (window - 1 - len(line)) for line in short)])


def _own(did: int, dh: int) -> bytes:
    return b"\1%x %x\1" % (did & (1 << 64) - 1, dh & (1 << 64) - 1)


def _parsed(batch: pa.RecordBatch, window: int) -> Iterator[tuple]:
    """Of each chunk of pages: rows of the batch, triggers mixed with the host, and what K.anchored_runs and the chunk hold."""
    keys = zip(_streams(batch), batch.column("kinds").to_pylist(), batch.column("did").to_pylist(), batch.column("dh").to_pylist(), strict=True)
    laid = pa.array([_laid_out(x, kinds, window, _own(did, dh)) for x, kinds, did, dh in keys], pa.large_binary())
    host = K.mix(np.asarray(batch.column("hh")).view(np.uint64))
    data, offsets = K.text_buffer(laid)
    for i, _, part, offs in K.document_chunks(data, offsets):
        doc, a, n, m, c, whole = K.anchored_runs(K.byte_grams(part), offs, window, _ANCHOR_BYTES, K.BYTE_REACH)
        if len(doc):
            yield i + doc, a, n, K.mix(m.view(np.uint64) + host[i + doc]).view(np.int64), c, whole, offs[doc] + a, part


def _first(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which values are the first of their kind in their document."""
    order = np.lexsort((x, doc))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    out = np.zeros(len(x), bool)
    out[order] = new
    return out


def hot_triggers(pages: DataFrame, hosts: DataFrame, window: int) -> DataFrame:
    """(hh, low, least) of the triggers, by _LOW bits, that may stand on as many pages of their host as a repeat needs, which is least.

    Copies are told from one another only by whether all pages of a trigger are
    copies, so some triggers here are too few; none is missing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hh, mh = np.asarray(batch.column("hh")), np.asarray(batch.column("mh"))
            for doc, _, _, m, *_ in _parsed(batch, window):
                one = _first(doc, m)
                doc = doc[one]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m[one] & _LOW, hh[doc], mh[doc])], names=["low", "hh", "mh"])

    found = pages.transform(mapped, count, "low long, hh long, mh long").groupBy("hh", "low")
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.min("mh").alias("a"), F.max("mh").alias("b")).where("n > 1 and a <> b").select("hh", "low", "n")
    return counts.join(hosts, "hh").where("n >= least").select("hh", "low", "least")


def _sieve(keys: DataFrame) -> np.ndarray:
    """Bits of the values of a column of hashes: of fixed size, whatever their number; lets some others through."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            if batch.num_rows:
                bits = np.zeros(1 << _SIEVE_BITS, bool) if bits is None else bits
                bits[np.asarray(batch.column(0)) & (1 << _SIEVE_BITS) - 1] = True
        if bits is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])

    out = np.zeros(1 << _SIEVE_BITS >> 3, np.uint8)
    for r in keys.coalesce(8).transform(mapped, mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & (1 << _SIEVE_BITS) - 1
    return (sieve[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)


def repeated_on_host(pages: DataFrame, window: int = REPEAT_BYTES, hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """(did, dh, hh, spans, least) of the strings of `window` bytes or more that stand on `least` pages of the host.

    Copies, that is pages of a host whose blocks but boilerplate are all the same, count as one page.
    """
    copies = cut(pages.groupBy("hh", "mh").agg(F.count(F.lit(1)).alias("copies")))
    hosts = copies.groupBy("hh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hh", F.greatest(F.lit(2), F.ceil(F.col("n") / HOST_SHARE)).cast("int").alias("least"))
    hot = cut(hot_triggers(pages, hosts, window))
    shared = pages.sparkSession.sparkContext.broadcast(_sieve(hot.select("low")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for batch in batches:
            did, dh, hh, mh = (np.asarray(batch.column(x)) for x in ("did", "dh", "hh", "mh"))
            for doc, a, n, m, c, whole, begin, part in _parsed(batch, window):
                on = _passes(sieve, m)
                if not on.any():
                    continue
                doc, a, n, m, c, begin = (x[on] for x in (doc, a, n, m, c, begin))
                ends = np.cumsum(n)
                new = _first(np.repeat(doc, n), whole[np.repeat(begin - (ends - n), n) + np.arange(ends[-1])])
                seen = [None if x.all() else x.astype(np.uint8).tobytes() for x in np.split(new, ends[:-1])]  # a window counts once a page
                raw = part.tobytes()
                body = [raw[x : x + y + window - 1] for x, y in zip(begin.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (did[doc], dh[doc], hh[doc], mh[doc], a.astype(np.int32), m, m & _LOW, c)), pa.array(seen, pa.binary()), pa.array(body, pa.binary())],
                    names=["did", "dh", "hh", "mh", "a", "m", "low", "c", "seen", "body"],
                )

    runs = pages.transform(mapped, parse, "did long, dh long, hh long, mh long, a int, m long, low long, c long, seen binary, body binary").join(hot, ["hh", "low"])
    runs = cut(runs.join(copies.where("copies > 1"), ["hh", "mh"], "left").withColumn("pages", 1 / F.coalesce("copies", F.lit(1))).drop("mh", "low", "copies"))
    phrases = runs.groupBy("m", "c", "seen").agg(F.sum("pages").alias("pages"), F.min("least").alias("least"), F.min("body").alias("body"))
    phrases, warm = split_hot(phrases, runs.select("m", "c", "seen").distinct().select("m"), hot_phrases)

    def mark(t: pa.Table) -> pa.Table:
        m, c, pages, least = (t.column(x).to_numpy() for x in ("m", "c", "pages", "least"))
        body, seen = (t.column(x).to_pylist() for x in ("body", "seen"))
        out: dict[tuple[int, int], tuple] = {}
        edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1], [True]])).tolist()
        for i, j in zip(edge, edge[1:], strict=False):
            weights = [pages[k] * (np.frombuffer(seen[k], np.uint8) if seen[k] else np.ones(len(body[k]) - window + 1)) for k in range(i, j)]
            for k, flags in zip(range(i, j), suffixes_on_pages(body[i:j], weights, int(least[i]), window), strict=True):
                s, e = K.runs_of(flags)
                if len(s):
                    out[int(m[k]), int(c[k])] = (s.tolist(), (e + window - 1).tolist())
        rows = [(*key, *x) for key, x in out.items()]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table([pa.array([x[f] for x in rows], kind) for f, kind in enumerate(kinds)], names=["m", "c", "s", "e"])

    marks = phrases.repartition("m").sortWithinPartitions("m").transform(mapped, lambda it: by_trigger(it, "m", mark), "m long, c long, s array<int>, e array<int>")
    if warm is not None:  # a host's template in ever new surroundings: windows are counted one by one
        warm = warm.select("m", "c", F.col("pages").cast("double").alias("weight"), F.col("seen").alias("flags"), (F.col("least") - 0.5).cast("double").alias("least"), "body")
        marks = marks.unionByName(hot_marks(warm, window).withColumn("e", F.transform("s", lambda j: j + window)))
    marks = cut(marks)
    spans = runs.select("did", "dh", "hh", "least", "a", "m", "c").join(marks, ["m", "c"])
    spans = spans.select("did", "dh", "hh", "least", F.expr("transform(arrays_zip(s, e), x -> struct(x.s + a as start, x.e + a as end))").alias("spans"))
    return spans.groupBy("did", "dh", "hh").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.min("least").alias("least"))


def suffixes_on_pages(phrases: list[bytes], weights: list[np.ndarray], least: int, window: int) -> list[np.ndarray]:
    """Suffix array of a trigger's phrases, cut at window bytes: which suffixes stand on `least` pages; weights are pages by suffix."""
    rank, n = K.window_ranks(phrases, window)
    shared = np.bincount(rank, np.concatenate(weights)) > least - 0.5
    return np.split(shared[rank], np.cumsum(n)[:-1])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = REPEAT_BYTES, hot: int = HOT_PHRASES) -> DataFrame:
    """One row per input row: id, url and text, the main text (empty if none).

    Null or empty html gives empty text; null urls form one host; rows that
    repeat an id are pages of their own unless their html is the same, too.
    Other columns are ignored; an empty table gives no rows. Triggers of more
    than `hot` distinct phrases are dealt window by window.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^/]*//([^/?#]*)", 1))
    rows = pages.select(row_id(id_col).alias("did"), text_key(html_col).alias("dh"), F.col(url_col).alias("url"), F.xxhash64(host).alias("hh"), F.col(html_col).alias("html"))
    found = cut(_blocks(rows))
    spans = cut(repeated_on_host(found, window, hot))

    shared = pages.sparkSession.sparkContext.broadcast(_sieve(spans.select("dh")))

    def some(spanned: bool, columns: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_passes(shared.value, np.asarray(batch.column("dh"))) == spanned)).select(columns)

        return run

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("did", "dh", "kinds", "spans", "least"))
            out = [text_of(stream, kinds, [(s["start"], s["end"]) for s in spans or []], least or 0, window, _own(did, dh)) for stream, did, dh, kinds, spans, least in zip(_streams(batch), *columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("url"), pa.array(out, pa.string())], names=["did", "url", "text"])

    # only pages that may have spans are dealt for the join
    with_spans, without = (found.transform(mapped, some(x, found.columns), _PAGE) for x in (True, False))
    both = with_spans.join(spans, ["did", "dh", "hh"], "left").select(*found.columns, "spans", "least")
    none = without.withColumns({"spans": F.lit(None).cast(spans.schema["spans"].dataType), "least": F.lit(None).cast("int")})
    out = both.unionByName(none).transform(mapped, texts, "did long, url string, text string")
    return out.select(F.nullif("did", F.lit(NULL_ID)).alias(id_col), F.col("url").alias(url_col), "text")


def text_of(stream: bytes, kinds: bytes, spans: list[tuple[int, int]], least: int, window: int, own: bytes) -> str:
    """The main text of a page from its blocks and repeated spans."""
    every, kept = [], []
    lines = list(_lines(stream, kinds, window, own))
    gone = np.zeros(max([len(stream), *(place + window for *_, place in lines)]), bool)
    for start, end in spans:
        gone[start:end] = True
    for kind, at, line, place in lines:
        if not kind:
            continue
        every.append(line.decode())
        over = gone[at : at + len(line)]
        if kind == 1:
            if text := "" if place >= 0 and gone[place : place + window].all() else unique_words(line, over):
                kept.append(text)
        elif kind == 3:
            if not (gone[place : place + window] if place >= 0 else over).all():
                kept.append(line.decode())
        elif least < MARKED_PAGES or len(line) < window or not over.all():
            kept.append(line.decode())
    return " ".join(kept or every)


def unique_words(line: bytes, gone: np.ndarray) -> str:
    """The words of a block that no repeated substring covers wholly."""
    out, at = [], 0
    for word in line.split(b" "):
        if word and not gone[at : at + len(word)].all():
            out.append(word)
        at += len(word) + 1
    return b" ".join(out).decode("utf-8", "replace")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    """op4: main text of all pages."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
