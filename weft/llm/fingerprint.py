"""Canonical exact digests of documents (DataFrame and SQL functions only).

A text's canonical form is NFC-composed, case-folded and has its white space
folded. Its fingerprint is a 128-bit xxhash of the canonical form, followed by
64-bit lanes of consecutive blocks whose length is a power of two, at two
sizes. Equal canonical forms have equal fingerprints; where two differ, the
share of equal lanes is their likeness. Rows whose digests are equal are
compared byte by byte before they count as one class.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.frames import NULL_ID, cut, row_id, table, text_key

#: Unicode white space; blocks of a fingerprint at most; least block length as a power of two.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]+"
MOST_BLOCKS = 16
LEAST_POWER = 3


@functools.cache
def _not_composed() -> str:
    """A pattern of all characters that may differ in NFC: marks, vowels and finals of Hangul, characters with a canonical decomposition that NFC keeps.

    All are U+0300 or above, which is asked first: the class itself is slow.
    """
    spans: list[list[int]] = []
    for code in range(0x300, 0x30000):
        if not 0xD800 <= code < 0xE000 and unicodedata.normalize("NFC", chr(code)) != chr(code):
            if spans and code == spans[-1][1] + 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return r"(?=[^\x{0}-\x{2FF}])[\p{M}\x{1161}-\x{1175}\x{11A8}-\x{11C2}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def normalised(text: Column) -> Column:
    """NFC. Texts in which nothing can change, nearly all, pass after one regular expression; the others go through the JVM's Unicode library, which Spark has for its collations."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(_not_composed()), composed).otherwise(text)


def canonical(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds column `name`: text normalised, case-folded, white space folded to one blank and trimmed; null counts as empty."""
    df = df.withColumn(name, normalised(F.coalesce(text, F.lit(""))))  # a projection of its own: the others stay compiled
    folded = F.lower(F.upper(F.replace(F.col(name), F.lit("ß"), F.lit("ss"))))  # upper() leaves ß alone
    return df.withColumn(name, F.trim(F.regexp_replace(folded, SPACE, " ")))


def _lanes(form: str, power: str) -> str:
    return f"CASE WHEN length({form}) = 0 THEN cast(array() as array<bigint>) ELSE transform(sequence(0L, (length({form}) - 1) div shiftleft(1L, {power})), i -> xxhash64(substring({form}, cast(i * shiftleft(1L, {power}) as int) + 1, cast(shiftleft(1L, {power}) as int)))) END"


def digest(form: str, bits: int = 128) -> tuple[Column, Column]:
    """High and low half of a form's digest; with fewer than 64 bits, for tests, digests collide."""
    high, low = F.xxhash64(form), F.xxhash64(F.lit("weft"), F.col(form))
    return (high, low) if bits >= 64 else (F.pmod(high, F.lit(1 << bits)), F.lit(0).cast("long"))


def with_fingerprint(df: DataFrame, text: Column, name: str, bits: int = 128) -> DataFrame:
    """Adds struct column `name`: high and low half of the digest, power of the block length, lanes and coarse lanes."""
    form, power = f"{name}_form", f"{name}_power"
    df = canonical(df, text, form)
    df = df.withColumn(power, F.greatest(F.lit(LEAST_POWER), F.ceil(F.log2(F.greatest(F.length(form), F.lit(1)) / MOST_BLOCKS))).cast("int"))
    high, low = digest(form, bits)
    made = F.struct(high.alias("high"), low.alias("low"), F.col(power).alias("power"), F.expr(_lanes(form, power)).alias("lanes"), F.expr(_lanes(form, f"({power} + 1)")).alias("coarse"))
    return df.withColumn(name, made).drop(form, power)


def as_text(fp: str) -> Column:
    """A fingerprint struct as text: digest, power and lanes in lowercase hex."""
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(hexed(F.col(f"{fp}.high")), hexed(F.col(f"{fp}.low")), F.lit("."), F.lower(F.hex(F.col(f"{fp}.power").cast("long"))), F.lit("."), F.array_join(F.transform(f"{fp}.lanes", hexed), ""))


def likeness(a: str, b: str) -> Column:
    """1 for equal digests, else the share of blocks that agree at the finest block length both have."""
    share = lambda x, y: f"size(filter(zip_with({x}, {y}, (p, q) -> coalesce(p = q, false)), e -> e)) / cast(greatest(size({x}), size({y}), 1) as double)"
    return F.expr(
        f"CASE WHEN {a}.high = {b}.high AND {a}.low = {b}.low THEN 1D WHEN {a}.power = {b}.power THEN {share(f'{a}.lanes', f'{b}.lanes')}"
        f" WHEN {a}.power + 1 = {b}.power THEN {share(f'{a}.coarse', f'{b}.lanes')} WHEN {a}.power = {b}.power + 1 THEN {share(f'{a}.lanes', f'{b}.coarse')} ELSE 0D END"
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, dh, text): the key of a row, and its text; null ids are one smallest id, null texts empty."""
    return docs.select(row_id(id_col).alias("did"), text_key(text_col).alias("dh"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, dh (hash of the raw text) and fp (with_fingerprint's struct).

    Null and empty texts have the digest of the empty form and no lanes; repeated
    rows and null ids are rows of their own; other columns are ignored; texts are
    read whole, however long; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), text_key(text_col).alias("dh"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    return with_fingerprint(rows, F.col("raw"), "fp").drop("raw")


def links(rows: DataFrame) -> DataFrame:
    """(did, dh, copies, twin, prev): each distinct key of keyed() rows with fp, how many rows have it, whether another row has its digest, and the key before it in order, as (did, dh, chars).

    Before the first comes the last. Keys, without texts, are sorted by ranges;
    what meets in one task is one row a range. Ties between rows of one id are
    broken by dh, so that no id, null or not, makes a range of its own.
    """
    per = rows.groupBy("did", "dh").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).cast("long").alias("chars"), F.max("fp.high").alias("high"), F.max("fp.low").alias("low"))
    placed = cut(per.repartitionByRange("did", "dh").withColumn("part", F.spark_partition_id()))
    shared = placed.groupBy("high", "low").agg(F.sum("copies").alias("n")).where("n > 1")
    twins = cut(placed.join(shared, ["high", "low"], "left_semi").select("did", "dh", F.lit(True).alias("twin")))
    own = F.struct("did", "dh", "chars")
    last = placed.groupBy("part").agg(F.max(own).alias("last"))
    before = last.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.max("last").over(Window.partitionBy(F.lit(1)))).alias("before"))
    within = Window.partitionBy("part").orderBy("did", "dh")
    linked = placed.join(before, "part").select("did", "dh", "copies", F.coalesce(F.lag(own).over(within), F.col("before")).alias("prev"))
    return linked.join(twins, ["did", "dh"], "left").select("did", "dh", "copies", F.coalesce("twin", F.lit(False)).alias("twin"), "prev")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Adds to keyed() rows with fp head, the first chars / 4 characters of the next row's text, next_<c> for each carried column, and twin, whether another row has the digest.

    The next row is that of the next key; of rows that repeat a key, each is
    followed by the next of them. Whole texts move once, to their key; from there
    only heads and carried columns go to the key before.
    """
    copy = F.row_number().over(Window.partitionBy("did", "dh").orderBy("did"))
    at_home = rows.join(links(rows), ["did", "dh"]).withColumn("copy", copy)
    head = lambda chars: F.substring("text", F.lit(1), F.floor(chars / 4).cast("int"))
    sent = at_home.where("copy = 1").select(F.col("prev.did").alias("did"), F.col("prev.dh").alias("dh"), head(F.col("prev.chars")).alias("sent_head"), F.struct(*carried).alias("sent"))
    both = at_home.join(sent, ["did", "dh"])
    own = F.col("copy") < F.col("copies")
    given = {"head": F.when(own, head(F.length("text"))).otherwise(F.col("sent_head"))} | {f"next_{c}": F.when(own, F.col(c)).otherwise(F.col(f"sent.{c}")) for c in carried}
    return both.select(*rows.columns, "twin", *(c.alias(name) for name, c in given.items()))


def classes(found: DataFrame) -> DataFrame:
    """found, which has did, dh, high, low and form of all rows, the canonical text where several rows share a digest and else null, with class_id and class_size of the rows with equal canonical texts.

    Rows of a digest are grouped by their canonical text, byte by byte; where a
    digest has several, each is a class. class_id is the smallest did. No other text moves.
    """
    again = found.where("form IS NOT NULL").select("did", "dh", "form", "high", "low")
    forms = again.groupBy("high", "low", "form").agg(F.min("did").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    forms = cut(forms.select("high", "low", "class_id", "class_size", F.sha2("form", 256).alias("form_sha")))
    several = forms.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("high", "low")
    one = forms.join(several, ["high", "low"], "left_anti").drop("form_sha")
    out = found.drop("form").join(one, ["high", "low"], "left")
    if not several.isEmpty():
        named = again.select("did", "dh", "high", "low", F.sha2("form", 256).alias("form_sha")).distinct()
        named = named.join(forms.join(several, ["high", "low"], "left_semi"), ["high", "low", "form_sha"]).select("did", "dh", F.col("class_id").alias("own_id"), F.col("class_size").alias("own_size"))
        out = out.join(named, ["did", "dh"], "left").withColumns({"class_id": F.coalesce("own_id", "class_id"), "class_size": F.coalesce("own_size", "class_size")}).drop("own_id", "own_size")
    return out.withColumns({"class_id": F.coalesce("class_id", "did"), "class_size": F.coalesce("class_size", F.lit(1).cast("long"))})


def fingerprint_edits(docs: DataFrame, bits: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its fingerprint, that of its edited text, their likeness and that to the next row, and its class.

    The edited text has its last quarter, rounded down, replaced by the start of
    the next row's text in order of id, or by all of it where that is shorter;
    after the last row comes the first. Null texts are empty; null ids are the
    smallest; rows that share an id are in order of a hash of their texts; other
    columns are ignored; an empty table gives no rows.
    """
    rows = with_next(with_fingerprint(keyed(docs, id_col, text_col), F.col("text"), "fp", bits), ["fp"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept.cast("int")), F.col("head")))
    rows = with_fingerprint(rows, F.col("edited"), "efp", bits)
    rows = canonical(rows, F.when(F.col("twin"), F.col("text")), "form")
    rows = cut(rows.select(
        F.when(F.col("twin"), F.col("form")).alias("form"), "did", "dh", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp.high", "fp.low", as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    ))
    null = F.lit(NULL_ID)
    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return classes(rows).select(F.nullif("did", null).alias(id_col), *names, F.nullif("class_id", null).alias("class_id"), "class_size")


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprints of documents and of their edited texts, with the class of equal canonical texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
