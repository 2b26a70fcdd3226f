"""The operators against brute force on small tables with nulls, empty and repeated rows and foreign columns."""

import collections
import hashlib
import html
import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from weft.llm import bpe, exact_dedup, fingerprint, html_text, jaccard_join, langid, licences, mixing, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, m long, node long, words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefgéßø", k=r.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(r.choices(vocabulary, k=n))
    a, b = thue_morse(1024), thue_morse(1024, "ba")  # equal for any polynomial modulo a power of two
    passage, out = make(70), [f"{a} x y z", f"{b} x y z", " ".join([a, *"bcdefghijklmnopqrstuvw"]), " ".join([b, *"bcdefghijklmnopqrstuvw"]), "w" * 300 + " tail", None, "", " ", "a", "A", "aaaa " * 120, "a" * 900, "ab" * 400, "été", "été", make(3000)]
    for _ in range(60):
        out.append(make(r.randint(1, 160)))
    for _ in range(25):
        out.append(f"{make(r.randint(0, 30))} {passage}\n{make(r.randint(0, 30))}")
    base = make(150).split()
    for k in range(40):  # near copies, each further from the first than the one before
        base[r.randrange(len(base))] = make(1)
        out.append(" ".join(base))
    out += r.sample(out, 20) + [out[17]] * 30
    return [(i, t, None, None if i % 7 == 0 else f"s{i % 4 if i % 3 else 0}", 1, 2, "x") for i, t in enumerate(out)] + [(5, out[5], None, "s1", 1, 2, "x"), (None, "a", None, None, 1, 2, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("hot", [2, 512])
def test_suffix_dedup(docs, rows, hot):
    window, count = 60, collections.Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[i : i + window] for i in range(len(b) - window + 1))
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        want.append((d, len(b), bytes(x for x, g in zip(b, gone) if not g), len(bytes(gone).replace(b"\0", b" ").split())))
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in suffix_dedup.suffix_dedup(docs, window, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("hot", [2, 512])
def test_substring_dedup(docs, rows, hot):
    window, least = 20, {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k, i_ = tuple(w[i : i + window]), -1 if d is None else d
            least[k] = min(i_, least.get(k, i_))
    want = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (-1 if d is None else d):
                gone[i : i + window] = [True] * window
        want.append((d, len(w), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [(r.doc_id, r.n_words, r.kept) for r in substring_dedup.substring_dedup(docs, window, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("digest_bytes", [1, 32])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, rows, keep, digest_bytes):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(-1 if d is None else d)
    pick = max if keep == "largest" else min
    want = [(d, pick(groups[t or ""]), len(groups[t or ""]), (-1 if d is None else d) == pick(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows]
    got = [(r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, keep, digest_bytes=digest_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
@pytest.mark.parametrize("node_bits", [5, 64])
def test_jaccard_components(docs, rows, n, num, den, node_bits):
    sets = []
    for d, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets.append((-1 if d is None else d, frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = collections.defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    want = [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_join.jaccard_components(docs, n, num, den, node_bits=node_bits).collect()]
    assert sorted(got) == sorted(want)


def test_fragment_keys_find_every_linked_pair():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(150):
        a = r.integers(0, 2**64, r.integers(1, 120), dtype=np.uint64)
        b = np.concatenate([a[r.random(len(a)) > 0.08], r.integers(0, 2**64, r.integers(0, 4), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            who, key = jaccard_join.fragment_keys([a, b], 85, 100)
            assert set(key[who == 0]) & set(key[who == 1])


def test_bpe_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    odd = ["a   b", "x   y ", "\n\n  a's 12  ", "<|endoftext|> a<|endoftext|>", "​ ​  c", "don't  ", "\x1c \x85  z"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text").unionByName(more), path), path).collect()
    known = Tokenizer.from_file(path)
    texts = [(d, t or "") for d, t, *_ in rows] + [(1000 + i, t) for i, t in enumerate(odd)]
    want = [(d, known.encode(t, add_special_tokens=False).ids, t) for d, t in texts]
    assert sorted(((r.doc_id, r.ids, r.text) for r in out), key=str) == sorted(want, key=str)
    assert all(r.n_tokens == len(r.ids) for r in out)


def test_langid(spark):
    r = random.Random(1)
    stems = {"aa": "th er on ing the ed".split(), "bb": "ch ung sch ei der ß".split(), "cc": "пр ов ст".split()}
    make = lambda lang, n: " ".join("".join(r.choices(stems[lang], k=r.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, None), (901, "", "aa"), (902, "12 !! 34", None), (None, make("bb", 20), None), (903, make("aa", 40) + " " + make("cc", 25) + " " + make("bb", 10), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("other"))
    model = langid.fit(docs.where("lang is not null and text is not null").where(~langid.held_out()))
    out = {row.doc_id: row for row in langid.identify(docs, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:120])
    assert [out[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "bb", "aa"]
    assert [s.lang for s in out[903].lang_spans] == ["aa", "cc", "bb"]
    assert [(s.start, s.end) for s in out[903].lang_spans] == [(0, 40), (40, 65), (65, 75)]
    assert {row.lang_pred for row in langid.identify(docs, None).collect()} == {"und"}


def test_licences(spark):
    texts = [None, "", "cc by", "x CC-BY 4.0 all  rights, reserved cc by", "general public license version 3", "Released under the MIT License.", "released under a the mit license here", "unrelated words only", "écc by"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in licences.scan(docs).collect()}
    phrases = {tuple(p.split()): label for p, label in licences.PHRASES.items()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        assert out[i].n_words == len(w)
        assert sorted((p.word, p.label) for p in out[i].places) == sorted(places)
    assert [s.label for s in out[5].spans] == ["mit"] and out[5].spans[0].share == 1.0


def _license_spans(text):
    """Brute force: every place of a document at which a template's words may begin, by the longest common subsequence."""
    words_ = [w.decode() for w in licences._words(text.encode())[0]]
    labels = set()
    best = {}
    for label, template in licences.TEMPLATES:
        t = [w.decode() for w in licences._words(template.encode())[0]]
        for at in range(max(1, len(words_) - len(t) + 1)):
            agreed = licences.common_words(words_[at : at + len(t)], t)
            best[label] = max(best.get(label, 0), agreed / len(t))
        if best[label] == 1:
            labels.add(label)
    return labels


def test_licences_whole_texts(spark):
    r = random.Random(2)
    filler = lambda n: " ".join("".join(r.choices("abcde", k=4)) for _ in range(n))
    names = [label for label, _ in licences.WHOLE]
    texts = [f"{filler(30)}\n{text}\n{filler(50)}" for _, text in licences.WHOLE]
    texts += [f"{filler(5)} {text} {filler(9)}" for _, text in licences.NOTICES]
    changed = licences.WHOLE[3][1].replace("sublicense", "sub license").replace("the rights to use", "all the rights to use")
    texts += [filler(40) + changed, " ".join([*(f"{t} {filler(400)}" for _, t in licences.WHOLE), filler(20_000), licences.WHOLE[3][1]])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    out = {x.doc_id: x for x in licences.scan(docs).collect()}
    for i, name in enumerate(names):
        sure = [s for s in out[i].spans if s.share >= licences.LEAST_SHARE]
        assert {s.label for s in sure} == {name} and max(s.share for s in sure) == 1.0 and name in _license_spans(texts[i])
    for i, (label, _) in enumerate(licences.NOTICES, len(names)):
        sure = {s.label for s in out[i].spans if s.share >= licences.LEAST_SHARE}
        assert label in sure and sure <= _license_spans(texts[i])
    assert {s.label for s in out[len(texts) - 2].spans if s.share >= 0.9} == {"mit"}
    assert set(names) <= {s.label for s in out[len(texts) - 1].spans} and sum(s.label == "mit" and s.share == 1 for s in out[len(texts) - 1].spans) >= 2


def test_mixing(docs, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    total = sum(len(words(t)) for _, t, *_ in rows)
    per = {}
    for r in out:
        key = (r.source_size, r.target)
        per.setdefault(key, 0)
        per[key] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
    assert sum(r.size for r in out) == total
    assert abs(sum(t for _, t in per) - total) < 1e-6 * total
    longest = max(r.size for r in out)
    for (size, target), taken in per.items():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= longest
    first = [r.positions[0] for r in out if r.positions]
    assert first == sorted(first)


def test_fingerprint(spark, docs, rows):
    import xxhash

    out = fingerprint.fingerprints(docs).withColumn("name", fingerprint.as_text("fp")).collect()
    want = collections.Counter()
    for d, t, *_ in rows:
        form = re.sub(r"\s+", " ", unicodedata.normalize("NFC", t or "").upper().lower()).strip(" ")
        want[d, xxhash.xxh64_intdigest(form.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(form.encode(), 42) >> 63 else 0)] += 1
    assert collections.Counter((r.doc_id, r.fp.high) for r in out) == want


def _canonical(text):
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", unicodedata.normalize("NFC", text).replace("ß", "ss").upper().lower()).strip(" ")


def _likeness(a, b):
    """From fingerprints as text: equal digests, else equal lanes at the block length that both have."""
    (da, pa_, la), (db, pb, lb) = (x.split(".") for x in (a, b))
    if da == db:
        return 1.0
    if pa_ != pb:
        return None
    la, lb = ([x[i : i + 16] for i in range(0, len(x), 16)] for x in (la, lb))
    return sum(x == y for x, y in zip(la, lb, strict=False)) / max(len(la), len(lb), 1)


@pytest.mark.parametrize("bits", [3, 128])
def test_fingerprint_edits(spark, docs, rows, bits):
    import xxhash

    extra = [unicodedata.normalize(f, x) for x in ("tiếng Việt", "ǭ", "한국어", "각", "q\u0307\u0323", "क़ \u212b") for f in ("NFC", "NFD")]
    more = spark.createDataFrame([(2000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    given = docs.select("doc_id", "text").unionByName(more)
    hashes = {r.t: r.dh for r in given.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dh")).collect()}
    order = sorted([(-1 if d is None else d, hashes[t or ""], t or "") for d, t, *_ in rows] + [(2000 + i, hashes[t], t) for i, t in enumerate(extra)])
    groups = collections.defaultdict(list)
    for d, _, t in order:
        groups[_canonical(t)].append(d)
    want = []
    for i, (d, _, t) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        own = groups[_canonical(t)]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), min(own), len(own), t, edited, after))
    out = fingerprint.fingerprint_edits(given, bits).collect()
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, -1 if r.class_id is None else r.class_id, r.class_size) for r in out]
    assert sorted(got) == sorted(w[:5] for w in want)
    if bits == 128:
        digest = lambda t: f"{xxhash.xxh64_intdigest(_canonical(t).encode(), 42):016x}"
        named = collections.defaultdict(list)
        for w in want:
            named[w[0], w[2]].append(w)
        for r in out:
            w = named[-1 if r.doc_id is None else r.doc_id, r.edited_sha256][0]
            assert r.fingerprint[:16] == digest(w[5]) and r.edited_fingerprint[:16] == digest(w[6])
            if (near := _likeness(r.fingerprint, r.edited_fingerprint)) is not None:
                assert r.near_edited == near
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1) >= (_canonical(w[5]) == _canonical(w[7]))
        for i in range(0, len(extra), 2):
            a, b = (next(r for r in out if r.doc_id == 2000 + i + k) for k in (0, 1))
            assert a.fingerprint == b.fingerprint and a.class_id == b.class_id == 2000 + i


def test_html_text(spark):
    nav = "<nav><a href=/>Home</a></nav>"
    notice = "<div>Subscribe to all the news of this fine house today</div>"
    pages = [
        (1, "http://h.org/a", f"<html><head><title>t</title><style>p{{}}</style></head><body>{nav}<article><h1>One &amp; two</h1><p>A<b>b</b>c<br>d&nbsp;e</p><div class='comments'>no</div></article><footer>f</footer>"),
        (2, "http://h.org/b", f"<body>{nav}{notice}<p>Quite unlike the other page, this speaks of ships.</p><form>x</form></body>"),
        (3, "http://h.org/c", f"<body>{notice}<p>Here it is about mountains and their snow.</p><script>var x='</p>';</script></body>"),
        (4, None, None), (5, "http://i.org/", ""), (6, "http://i.org/x", "<p>unclosed <i>tag"),
    ]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "One & two Abc d e", 2: "Quite unlike the other page, this speaks of ships.", 3: "Here it is about mountains and their snow.", 4: "", 5: "", 6: "unclosed tag"}
    assert html.unescape("&amp;") == "&"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = bpe.default_tokenizer()
    for out in (
        suffix_dedup.suffix_dedup(docs), substring_dedup.substring_dedup(docs), exact_dedup.exact_dedup(docs), jaccard_join.jaccard_components(docs), bpe.decode(bpe.encode(docs, path), path),
        langid.identify(docs, langid.fit(docs)), licences.scan(docs), mixing.mix(docs), fingerprint.fingerprints(docs), html_text.main_text(pages),
    ):
        assert out.collect() == []


def _texts(spark, pages, parts=3, **more):
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts), **more).collect()}


def test_html_text_keeps_undecided_blocks_beside_marked_ones(spark):
    notice = "<div>Subscribe to all the news of this fine house today</div><div>Short foot</div>"
    body = ["ships that sail by night", "mountains and all their snow", "rivers as they run to the sea"]
    pages = [(i, "http://h.org/x", f"<h1 class='article-title'>T{i}</h1><div><p>The whole body is about {t}.</p></div>{notice}") for i, t in enumerate(body)]
    assert _texts(spark, pages) == {i: f"T{i} The whole body is about {t}." for i, t in enumerate(body)}


WRAPPERS = ("content-sidebar-wrap", "layout-sidebar-right", "header-and-footer-layout", "comments-enabled", "modal-open")
OWN_PARTS = (
    '<h2 class="section-header">yes</h2>', '<p class="side-note">yes</p>', '<p class="ad-hoc">yes</p>', '<section class="related-work"><p>yes</p></section>', '<div class="search-algorithms">yes</div>', '<div class="social-science">yes</div>',
)
FOREIGN_PARTS = (
    '<div class="related-posts">no</div>', '<div class="ad-slot-2">no</div>', '<ul class="share-buttons"><li>no</ul>', '<section id="comments"><p>no</section>', '<h3 class="related-title">no</h3>', '<div class="newsletter-signup">no</div>', '<form>no</form>',
)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="main-menu">Home About</div><p>The body is here.</p>', ["The body is here."]),
        ('<article><p>x</p><article class="comment">no</article><div class="article-comments">no</div><div class=story-ads>no</div><ul class="main-nav"><li>no</ul></article>', ["x"]),
        ("<main><header>Site</header><p>t</p></main>", ["t"]),
        ('<article class="post has-sidebar"><header><h1>T</h1></header><div class="article-header">H</div><p>b</p></article>', ["T", "H", "b"]),
        ('<body class="main-nav"><div class="has-sidebar main">a</div>b <a class=ad>no</a> c', ["a", "b", "c"]),
        ('<p>a<img alt="x>y">b <q cite=\'>c</q> d', ["ab c d"]),
        ("<p>a<p>b<br>c&nbsp;&amp;</p></p> d<!-- no", ["a", "b c &", "d"]),
        ('<form id="aspnetForm"><article><p>The body</p></article><form>no</form></form>', ["The body"]),
        ('<form action=x><header>no</header><div><p>The body</p></div></form>', ["The body"]),
        ("<p>a</p><form>no <input> no</form>", ["a"]),
        ('<aside class="x"><article>no</article></aside><p>a</p>', ["a"]),
        ('<div class="comments"><article class="comment-body">no</article></div>', []),
        *((f'<div class="{wrapper}"><nav>no</nav><main class="content"><article><p>The body.</main><div class="sidebar">no</div></div>', ["The body."]) for wrapper in WRAPPERS),
        *((f'<div class="{wrapper}"><article><p>The body.</article><ol class=comments><li><article class="comment-body">no</article></ol></div>', ["The body."]) for wrapper in WRAPPERS),
        *((f"<article><p>a</p>{part}<p>b</p></article>", ["a", "yes", "b"]) for part in OWN_PARTS),
        *((f"<article><p>a</p>{part}<p>b</p></article>", ["a", "b"]) for part in FOREIGN_PARTS),
    ],
)
def test_html_blocks(page, want):
    assert [t for kind, t in html_text.blocks(page) if kind != "boilerplate"] == want


def test_html_hints_go_where_the_host_repeats_them(spark):
    """A class name with a bad part beside other words leaves a block of the article to the repeats on its host; clashing columns and repeated rows."""
    hint = '<div class="promo-zone">Read all of our wonderful stories from the harbour every single day</div>'
    pages = [(i, "http://h.org/x", f"<article><p>The whole body is about {t}.</p>{hint}<p class='side-note'>Noted {t}.</p></article>") for i, t in enumerate(["ships", "hills", "rivers", "seas"])]
    pages.append((9, "http://other.org/x", pages[0][2]))
    rows = spark.createDataFrame([(*p, "x", 1, "y") for p in [*pages, pages[0]]], "page_id long, url string, html string, dh string, hh int, kinds string")
    got = html_text.main_text(rows.repartition(3))
    assert got.columns == ["page_id", "url", "text"]
    texts = [(r.page_id, r.text) for r in got.collect()]
    short = {i: f"The whole body is about {t}. Noted {t}." for i, t in enumerate(["ships", "hills", "rivers", "seas"])}
    assert sorted(texts) == sorted([*short.items(), (0, short[0]), (9, "The whole body is about ships. Read all of our wonderful stories from the harbour every single day Noted ships.")])


def test_html_blocks_take_linear_time():
    import time

    began = time.time()
    html_text.blocks("<div>" * 50_000 + "</p>x" * 50_000)
    html_text.blocks("<a '" * 8_001)
    html_text.blocks("<form><div class='x-sidebar'>" * 20_000 + "<article>x")
    html_text.blocks("<div class='x-sidebar'>" * 20_000 + "<article>x</article>" * 20_000)
    assert time.time() - began < 5


def test_html_text_repeats_against_brute_force(spark):
    """Undecided blocks lose the words that windows of REPEAT_BYTES on half of the host's pages cover."""
    r = random.Random(11)
    window = html_text.REPEAT_BYTES
    boxes = _prose(12, *[14] * 6)
    lines = [[t for t in (*r.sample(boxes, 3), *_prose(100 + i, 25, 18)) if r.random() > 0.1] for i in range(14)]
    for own in lines:
        r.shuffle(own)
    seen = collections.Counter(w for own in lines for w in {x[i : i + window] for x in ["\n".join(own)] for i in range(len(x) - window + 1)})
    want = {}
    for i, own in enumerate(lines):
        text = "\n".join(own)
        gone = bytearray(len(text))
        for k in range(len(text) - window + 1):
            if seen[text[k : k + window]] >= len(lines) / 2:
                gone[k : k + window] = b"\1" * window
        kept = [m.group() for m in re.finditer(r"\S+", text) if not all(gone[m.start() : m.end()])]
        want[i] = " ".join(kept) or " ".join(own)
    assert any(len(want[i]) < len(" ".join(lines[i])) for i in want)
    pages = [(i, "https://one.org/p", "".join(f"<div>{t}</div>" for t in own)) for i, own in enumerate(lines)]
    assert _texts(spark, pages, 4) == _texts(spark, pages, 4, hot=2) == want


def _prose(seed, *sizes):
    r = random.Random(seed)
    return [" ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n)) for n in sizes]


def test_html_text_repeats_need_half_of_the_host(spark):
    quote, menu, *prose = _prose(5, 12, 12, *[60] * 12)
    page = lambda i: f"<div>{menu}</div><p>{prose[i]}</p><div>{prose[i][:89]} {quote if i < 4 else ''}</div>"
    pages = [(i, "http://h.org/x", page(i)) for i in range(12)]
    pages += [(100 + i, "http://h.org/y", page(0)) for i in range(30)]  # copies count as one page
    pages += [(200 + i, "http://two.org/", f"<p>{prose[1]}</p>") for i in range(2)]  # a page whose whole text is copied
    got = _texts(spark, pages)
    for i in range(12):
        assert got[i] == f"{prose[i]} {prose[i][:89]} {quote if i < 4 else ''}".strip()
    assert {got[100 + i] for i in range(30)} == {got[0]}
    assert got[200] == got[201] == prose[1]


def test_html_text_drops_repeated_blocks_of_marked_text(spark):
    quote, box, *prose = _prose(6, 12, 15, *[60] * 12)
    pages = [(i, "http://h.org/x", f"<article><p>{prose[i]}</p>{f'<p>{quote}</p>' if i < 4 else ''}<section>{box}</section></article>") for i in range(12)]
    pages += [(100 + i, None, f"<article><p>{prose[i]}</p><section>{box}</section></article>") for i in range(3)]  # too few pages to overrule the markup
    got = _texts(spark, pages)
    assert all(got[i] == " ".join([prose[i], quote] if i < 4 else [prose[i]]) for i in range(12))
    assert all(got[100 + i] == f"{prose[i]} {box}" for i in range(3))


def _stems(r, lang, n):
    stems = {"aa": "th er on ing the ed".split(), "bb": "ch ung sch ei der ß".split(), "cc": "пр ов ст".split()}
    return " ".join("".join(r.choices(stems[lang], k=r.randint(1, 3))) for _ in range(n))


def test_pipeline_keeps_mixed_and_unlabelled_documents(spark):
    import corpus_pipeline

    r = random.Random(3)
    rows = [(i, _stems(r, lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(900, None, None), (901, "12 !! 34", None), (902, " ".join(_stems(r, *x) for x in (("aa", 40), ("cc", 35), ("bb", 25))), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = set(range(60)) | {902}
    assert {x.doc_id for x in corpus_pipeline.language_id(spark, docs, "").collect()} == want
    assert {x.doc_id for x in corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()} == want


@pytest.mark.parametrize("kinds", [3, 200])
def test_viterbi_against_brute_force(kinds):
    import numpy as np

    r = np.random.default_rng(kinds)
    lengths = [0, 1, 5, 2, 7, 0, 6]
    codes = r.integers(0, 9, sum(lengths))
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = r.normal(0, 4, (9, kinds)).astype(np.float32)
    path = langid.viterbi(codes, first, scores, 3.0)
    total = lambda doc, labels: sum(scores[c, k] for c, k in zip(doc, labels, strict=True)) - 3.0 * sum(a != b for a, b in zip(labels, labels[1:], strict=False))
    for a, b in zip(first, first[1:], strict=False):
        doc, got = codes[a:b], path[a:b].tolist()
        assert all(0 <= k < kinds for k in got)
        if kinds == 3:
            best = max((total(doc, p) for p in itertools.product(range(kinds), repeat=len(doc))), default=0)
        else:  # dynamic programming word by word
            value = [0.0] * kinds
            for i, c in enumerate(doc):
                top = max(value)
                value = [(max(v, top - 3.0) if i else 0.0) + scores[c, k] for k, v in enumerate(value)]
            best = max(value) if len(doc) else 0
        assert abs(total(doc, got) - best) < 1e-3


def test_langid_letters_and_clashing_columns(spark):
    r = random.Random(1)
    labelled = [(i, _stems(r, lang, 30), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    model = langid.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    texts = ["² ½ Ⅷ 12", "th on ²", "sch ei " * 40_000, None, ""]
    docs = spark.createDataFrame([(i, t, "x", 7, True) for i, t in enumerate(texts)], "doc_id long, text string, _lower string, lower int, lang_spans boolean")
    out = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert [out[i].lang_pred for i in range(5)] == ["und", "aa", "bb", "und", "und"]
    assert all(x["_lower"] == "x" and x["lower"] == 7 for x in out.values())
    assert {x.doc_id for x in docs.where(langid.has_letter()).collect()} == {1, 2}


def _near_components(given, n, num, den):
    sets = [(d, frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := words(t.translate(LOWER))) else frozenset()) for d, t in given]
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if x and y and label[a] < label[b] and den * len(x & y) >= num * len(x | y):
                    label[b], changed = label[a], True
    return label


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(9)
    rows = [(i, _stems(r, lang, r.randint(20, 60)), lang, f"s{i % 4}" if i % 5 else None) for i, lang in enumerate(["aa", "bb", "cc"] * 15)]
    rows += [(100 + i, rows[i][1], None, "s0") for i in range(12)]  # exact copies
    rows += [(200 + i, rows[20 + i][1] + " th", None, "s1") for i in range(8)]  # near copies
    rows += [(300, None, None, "s2"), (301, "", None, None), (302, "12 34", None, "s2"), (303, "²", "aa", "s2"), (304, rows[3][1], "aa", "s3"), (None, "on the er ing", None, "s1")]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), "e", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars int, score string, did int")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    at, given = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        at[name] = given = corpus_pipeline.cut(stage(spark, given, str(tmp_path)))
        if name != "bpe":
            assert given.schema.names == docs.schema.names + (["position", "copy"] if name == "mixing" else [])
            assert all(x.score == "e" and x.did == 1 for x in given.collect())
    left = {d: t for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t) and t != "²"}
    assert {x.doc_id for x in at["language_id"].collect()} == set(left)
    first = {}
    for d, t in sorted(left.items(), key=lambda x: -1 if x[0] is None else x[0]):
        first.setdefault(t, d)
    exact = {d: t for t, d in first.items()}
    assert {x.doc_id for x in at["exact_dedup"].collect()} == set(exact)
    label = _near_components([(-1 if d is None else d, t) for d, t in exact.items()], 5, 4, 5)
    near = {d: t for d, t in exact.items() if label[-1 if d is None else d] == (-1 if d is None else d)}
    assert {x.doc_id for x in at["jaccard_join"].collect()} == set(near)
    times = collections.Counter(x.doc_id for x in at["mixing"].collect())
    plan = {x.doc_id: x for x in mixing.mix(at["jaccard_join"]).collect()}
    assert set(plan) == set(near) and times == collections.Counter({d: x.copies for d, x in plan.items() if x.copies})
    known = Tokenizer.from_file(bpe.default_tokenizer())
    order = lambda rows: [d for _, _, d in sorted(rows, key=lambda x: (*x[:2], str(x[2])))]
    wanted = order((p, k, d) for d, x in plan.items() for k, p in enumerate(x.positions))
    for stage in ("mixing", "bpe"):  # the order of the mix reaches the output
        assert order((x.position, x.copy, x.doc_id) for x in at[stage].collect()) == wanted
    got = collections.Counter((x.doc_id, tuple(x.ids), x.text) for x in at["bpe"].collect())
    assert got == collections.Counter({(d, tuple(known.encode(near[d], add_special_tokens=False).ids), near[d]): k for d, k in times.items()})
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(times.values())


def test_pipeline_stages_on_empty_tables(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_encode_settles_input_that_comes_from_a_shuffle(spark, docs):
    assert bpe._settled(docs.select("doc_id")).inputFiles() and bpe._settled(docs.repartition(3).select("doc_id")).inputFiles()
    for plain in (spark.createDataFrame([(1, "a")], "doc_id long, text string"), bpe.cut(docs.select("doc_id", "text"))):
        assert bpe._settled(plain) is plain


def test_langid_sample_keeps_rare_languages(spark):
    rows = [(i, f"t{i}", "aa") for i in range(3000)] + [(None, f"n{i}", "bb") for i in range(1000)] + [(i, f"t{i}", "cc") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.Counter(x.lang for x in langid.bounded(docs, F.col("doc_id"), 403).collect())
    assert got["cc"] == 3 and 150 < got["aa"] < 250 and 150 < got["bb"] < 250
    assert langid.bounded(docs, F.col("doc_id"), 4003).count() == 4003


def test_twins_of_a_digest(spark):
    docs = spark.createDataFrame([(1, "Same text"), (2, "same  TEXT "), (3, "other"), (4, "alone"), (4, "alone"), (5, None), (6, "")], "doc_id long, text string")
    rows = fingerprint.with_fingerprint(fingerprint.keyed(docs), F.col("text"), "fp")
    assert sorted((r.did, r.twin) for r in fingerprint.links(rows).collect()) == [(1, True), (2, True), (3, False), (4, True), (5, True), (6, True)]
    assert {(r.doc_id, r.class_id, r.class_size) for r in fingerprint.fingerprint_edits(docs).collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 5, 2), (6, 5, 2)}
