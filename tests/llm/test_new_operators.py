"""Collocations, piece BPE and timestamps against brute force, the library and the zone database."""

import random
import re
import zoneinfo
from collections import Counter
from datetime import UTC, datetime, timedelta
from hashlib import sha256

import pytest

from weft.llm import collocations, piece_bpe, timestamps

DOCS = "doc_id long, text string, lang string, did string, ids int, words string, n long, row int, block int, token string, source string"


def docs_of(spark, rows):
    """Documents with more columns, named as the operators name theirs."""
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2, 3, 4, "z", None) for i, t, lang in rows], DOCS)


def brute_collocations(rows, least, share, most):
    """The contract, word by word."""
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    frequent = {p: c for p, c in f.items() if c >= least}
    found = {}
    for p, a in frequent.items():
        if len(p) > 2:
            lang, *w = p
            score, k = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            found[p] = (lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score)
    for (lang, *w), c in frequent.items():
        for i in range(len(w)):
            for k in range(2, len(w)):
                inner = (lang, *w[i : i + k])
                if i + k <= len(w) and inner in found and 100 * c >= share * frequent[inner]:
                    found.pop(inner)
    out = set()
    for lang in n:
        own = sorted((v for v in found.values() if v[0] == lang), key=lambda v: (-v[6], -v[2], v[1].encode()))
        out |= {(v[0], i + 1, *v[1:]) for i, v in enumerate(own[:most])}
    return out


@pytest.mark.parametrize("shard_words, most", [(40, 1000), (100000, 7)])
def test_collocations_equal_brute_force(spark, shard_words, most):
    rnd = random.Random(shard_words)
    words = ["a", "B", "c", "dé", "E\x00f", "New", "york", "city", "\xa0x", "Éa"]
    phrase = lambda: rnd.choice([["New", "York", "City", "a"], [rnd.choice(words)], ["c", "c", "c"], ["B", "dé"]])
    rows = []
    for i in range(60):
        text = "".join("".join(f"{w}{rnd.choice([' ', ' ', ' ', '  ', chr(9)])}" for w in phrase()) + rnd.choice(["", "", "", ".", "\n", "\r", "!? ", " ; "]) for _ in range(rnd.randint(0, 25)))
        rows.append((rnd.choice([i, i, None, 7]), text, rnd.choice(["en", "en", "fr", None, "und"])))
    rows += [(1, None, "en"), (2, "", "en"), (3, " . \t", None), (4, "long word " * 5000, "xx"), rows[0], rows[0]]
    got = collocations.collocations(docs_of(spark, rows), 5, 80, most, shard_words=shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, 5, 80, most)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, " ", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    found = spark.createDataFrame([(1, 0, 0, 0, big + 1), (2, 0, 0, 0, big + 5), (1, 2, 0, 0, big)], "w1 long, w2 long, w3 long, w4 long, f long")
    assert [tuple(r) for r in collocations.scored(found).collect()] == [(1, 2, 0, 0, big, big + 1, big + 5, 2000000 * big // (2 * big + 6))]


def test_phrases_of_bitmaps_cross_blocks_and_batches(monkeypatch):
    """Counts of pairs and of longer phrases by shifts of bitmaps, in small batches too."""
    import numpy as np

    rnd = np.random.default_rng(3)
    codes = rnd.integers(-1, 6, 5000)
    for paired in (1, 50, 1 << 22):
        monkeypatch.setattr(collocations, "_PAIRED", paired)
        for allowed in (None, lambda a, b: np.ones(len(a), bool)):
            got = Counter()
            for names, counts in collocations.phrases(codes, 4, allowed):
                got.update({tuple(p): c for p, c in zip(names.tolist(), counts.tolist(), strict=True)})
            sizes = (2,) if allowed is None else (3, 4)
            want = Counter(tuple(codes[i : i + k].tolist()) for k in sizes for i in range(len(codes) - k + 1) if (codes[i : i + k] >= 0).all())
            assert got == want


def piece_texts():
    rnd = random.Random(9)
    made = ["".join(rnd.choice(["th", "e", " ", "  ", "ing", "\n", "日本", "é", "😀", "\x00", "▁", "1", "=="]) for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    return [*made, None, "", " ", "a" * 3000, "ha" * 3000, " " * 5000 + "x", "word and " * 20000, "<s>a</s><0x41>", made[0], made[0]]


def test_piece_bpe_equals_the_library(spark):
    import sentencepiece

    path = piece_bpe.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(None if i % 50 == 3 else i, t, None) for i, t in enumerate(piece_texts())]
    out = piece_bpe.decode(piece_bpe.encode(docs_of(spark, rows).repartition(3), path), path)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, piece_bpe.unpacked(r.ids), r.text) for r in out.collect())
    ids = [library.encode(t or "", add_bos=True, add_eos=True) for _, t, _ in rows]
    assert got == sorted((i is None, i or 0, len(x), x, library.decode(x)) for (i, _, _), x in zip(rows, ids, strict=True))
    assert piece_bpe.encode(docs_of(spark, []), path).count() == 0


def test_merges_come_one_after_the_other():
    """Against merging pair by pair, with pieces whose longer forms come first."""
    import numpy as np

    rnd = random.Random(4)
    letters = "abc"
    for _ in range(300):
        made = {rnd.choice(letters) * 1 for _ in range(9)} | set(letters) | {"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 5))) for _ in range(14)}
        ids = {p: i for i, p in enumerate(sorted(made))}
        score = {p: rnd.randint(0, 9) for p in ids}
        pairs = sorted((ids[p[:k]] * piece_bpe._SPAN + ids[p[k:]], ids[p], score[p]) for p in ids for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        if not pairs:
            continue
        keys, merged, ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        model = piece_bpe.Pieces(keys, merged, ranks, None, None, None, None, 0, 0, 0, len(ids), None)
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(5)]
        want = []
        for n, w in enumerate(words):
            parts = list(w)
            while True:
                able = [(score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
                if not able:
                    break
                i = min(able)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want += [(n, ids[p]) for p in parts]
        symbols = np.array([ids[c] for w in words for c in w])
        out, owner = piece_bpe.merge_rounds(model, symbols, np.repeat(np.arange(len(words)), [len(w) for w in words]))
        assert list(zip(owner.tolist(), out.tolist(), strict=True)) == want


STAMP = re.compile(r"(?:(20\d\d)-(\d\d)-(\d\d)|(20\d\d)(\d\d)(\d\d)|(\d\d)\.(\d\d)\.(20\d\d)|(\d\d) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20\d\d)|(\d\d)/(\d\d)/(20\d\d))(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP]M))?(?: ?(Z|[+-]\d\d:?\d\d))?)?", re.ASCII)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def day_of(y, m, d):
    try:
        return datetime(int(y), int(m), int(d))
    except ValueError:
        return None


def read_stamp(raw, zone):
    """None, ('epoch', us), or ([day first, month first], seconds of the day, offset)."""
    s = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}", s):
        return "epoch", int(s) * 10**6
    if re.fullmatch("[0-9]{13}", s):
        return "epoch", int(s) * 10**3
    if not (m := STAMP.fullmatch(s)):
        return None
    g = m.groups()
    if g[12]:
        days = [day_of(g[14], g[13], g[12]), day_of(g[14], g[12], g[13])]
    elif g[10]:
        days = [day_of(g[11], MONTHS.index(g[10]) + 1, g[9])] * 2
    elif g[6]:
        days = [day_of(g[8], g[7], g[6])] * 2
    else:
        days = [day_of(*(g[:3] if g[0] else g[3:6]))] * 2
    if days == [None, None]:
        return None
    h, mi, sec = int(g[15] or 0), int(g[16] or 0), int(g[17] or 0)
    if g[18]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g[18] == "PM")
    if h > 23 or mi > 59 or sec > 59:
        return None
    offset = None
    if g[19]:
        digits = g[19].replace(":", "")
        hours, minutes = (0, 0) if digits == "Z" else (int(digits[1:3]), int(digits[3:5]))
        if hours > 14 or minutes > 59:
            return None
        offset = (hours * 3600 + minutes * 60) * (-1 if digits[0] == "-" else 1)
    elif zone not in zoneinfo.available_timezones():
        return None
    return days, h * 3600 + mi * 60 + sec, offset


def instant(wall, zone):
    """Seconds of UTC, and whether the wall time is skipped or repeated: of all offsets of two days, those that fit."""
    z = zoneinfo.ZoneInfo(zone)
    at = wall.replace(tzinfo=UTC)
    offsets = [(at + timedelta(minutes=15 * k)).astimezone(z).utcoffset() for k in range(-96, 97)]
    fit = sorted({at - o for o in offsets if (at - o).astimezone(z).utcoffset() == o})
    if len(fit) == 1:
        return int(fit[0].timestamp()), False
    return int((fit[-1] if fit else at - offsets[-1]).timestamp()), True


def brute_stamps(rows):
    read = [(r, read_stamp(r[3], r[2])) for r in rows]
    votes = Counter()
    for (_, source, _, _), x in read:
        if x and x[0] != "epoch" and (x[0][0] is None) != (x[0][1] is None):
            votes[source, x[0][0] is None] += 1
    out = []
    for (i, source, zone, _), x in read:
        if x is None:
            out.append((i, None, "bad", False))
            continue
        if x[0] == "epoch":
            out.append((i, x[1], "epoch", False))
            continue
        (one, two), seconds, offset = x
        rule, day = "plain", one or two
        if one and two and one != two:
            dm, md = votes[source, False], votes[source, True]
            rule = "votes" if dm > 10 * md or md > 10 * dm else "default"
            day = two if md > 10 * dm else one
        wall = day + timedelta(seconds=seconds)
        at, unsure = instant(wall, zone) if offset is None else (int(wall.replace(tzinfo=UTC).timestamp()) - offset, False)
        out.append((i, at * 10**6, rule, rule != "plain" or unsure))
    return out


STAMPS = "stamp_id long, source string, zone string, raw string, id int, epoch string, token string, order string, voter string"
ZONES = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Pacific/Apia", "Australia/Lord_Howe", "America/Sao_Paulo", None, "Mars/Base", "+01:00"]
FIXED = [
    "2024-02-29", "2023-02-29", " \t20240229\r\n", "20240230", "31.04.2024", "30.04.2024 23:59:59", "29 Feb 2024T00:00", "29 feb 2024", "01 Sep 2024 12:00 AM", "01 Sep 2024 12:00PM", "01 Sep 2024 13:00 PM", "01 Sep 2024 00:10 AM",
    "13/02/2024", "02/13/2024 10:00", "02/03/2024", "03/03/2024", "13/13/2024", "32/01/2024", "13/02/2024 24:00", "13/02/2024 10:60", "2024-03-31 02:30", "2024-10-27 02:30:00", "2024-10-27T02:30:00 Z", "2024-10-27 02:30+14:59", "2024-10-27 02:30+15:00",
    "2024-10-27 02:30-0530", "2024-10-27 02:30 AM -05:30", "2024-03-10 02:30 AM", "2024-11-03 01:30", "2011-12-30 12:00", "2024-04-07 01:45", "2024-10-06 02:15", "2018-11-04 00:15", "1999-12-31", "2000-01-01", "2099-12-31 23:59", "2100-01-01", "1700000000", "1700000000123",
    "17000000001", "170000000", "", " ", None, "n/a", "2024-1-2", "2024-01-02 1:00", "2024-01-02T", "2024-01-02  10:00", "2024-01-02 10:00  AM", "2024-01-02 10:00 am", "2024-01-02 10:00Zz", "٢٠٢٤-01-02", "2024-01-02 10:00:00.5", "2024-01-02\n10:00", "x" * 100000, "2024-01-02 10:00" + " " * 50000,
]


def stamp_rows():
    rnd = random.Random(2)
    rows = [(i, f"s{i % 3}", ZONES[i % len(ZONES)] if i % 5 else "Europe/Berlin", r) for i, r in enumerate(FIXED * 3)]
    for k in range(300):  # sources with 11 to 1, 10 to 1 and no votes, and a null one
        source = rnd.choice(["a", "b", "c", None])
        rows.append((1000 + k, source, rnd.choice(ZONES), f"{rnd.randint(1, 12):02}/{rnd.randint(1, 12):02}/2024 {rnd.randint(0, 23):02}:{rnd.randint(0, 59):02}"))
    rows += [(2000 + k, "a", "UTC", "01/13/2024") for k in range(11)] + [(2100, "a", "UTC", "13/01/2024"), (2101, "b", "UTC", "13/01/2024")] + [(2200 + k, "b", "UTC", "01/13/2024") for k in range(10)] + [(2300, None, "UTC", "01/20/2024"), (2301, "c", None, "01/20/2024")]
    return [*rows, rows[0], rows[0], (None, "a", "UTC", "2024-01-01"), (None, "a", "UTC", "02/03/2024")]


def test_stamps_equal_brute_force(spark):
    rows = stamp_rows()
    stamps = spark.createDataFrame([(*r, 1, "e", "t", "o", "v") for r in rows], STAMPS).repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    want = sorted(brute_stamps(rows), key=key)
    assert {r[2] for r in want} == {"bad", "epoch", "votes", "default", "plain"}
    for most in (timestamps.BROADCAST_BYTES, 0):  # counts broadcast, or joined by source and salt
        out = timestamps.normalise(stamps, most=most)
        assert out.columns == ["stamp_id", "utc_us", "rule", "ambiguous"]
        assert sorted((tuple(r) for r in out.collect()), key=key) == want
    assert timestamps.normalise(stamps.limit(0)).count() == 0


def test_stamps_after_changes_of_all_zones(spark):
    """Wall times around the changes of every zone, 2000 to 2037."""
    rnd = random.Random(8)
    rows = []
    for n, zone in enumerate(sorted(zoneinfo.available_timezones() & set(timestamps._zones(spark)))[::7]):
        z = zoneinfo.ZoneInfo(zone)
        for _ in range(6):
            t = datetime(rnd.randint(2000, 2036), 1, 1, tzinfo=UTC)
            while t.year < 2037 and t.astimezone(z).utcoffset() == (t + timedelta(hours=6)).astimezone(z).utcoffset():
                t += timedelta(hours=6)
            wall = t.astimezone(z).replace(tzinfo=None) + timedelta(minutes=rnd.randint(-300, 600))
            rows.append((n, "s", zone, wall.strftime("%Y-%m-%d %H:%M")))
    out = timestamps.normalise(spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(brute_stamps(rows)) and any(r[3] for r in got)


def test_new_queries_run_whole(spark):
    """op11, op12 and op13 on the smallest tables against brute force, the library and the contract."""
    import sentencepiece

    from weft.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert {tuple(r) for r in queries()["op11_collocations"](spark, sf).collect()} == brute_collocations(docs, 30, 80, 2000)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    want = set()
    for i, t, _ in docs:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in queries()["op12_piece_bpe"](spark, sf).collect()} == want
    stamps = [tuple(r) for r in spark.read.parquet(f"{sf}/stamps.parquet").select("stamp_id", "source", "zone", "raw").collect()]
    assert sorted(tuple(r) for r in queries()["op13_timestamps"](spark, sf).collect()) == sorted(brute_stamps(stamps))
