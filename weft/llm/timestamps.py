"""Timestamps of mixed layouts as microseconds of UTC, by a dictionary of date tokens.

Every valid date of 2000 to 2099 is written in each layout, with both readings of
a slashed one, which makes a table of fixed size (about 205,000 rows). Stamps
meet it in a broadcast hash join on their date token; a token that is no date finds
nothing. The time behind the token is parsed by itself. Slashed stamps that are
dates in one order alone vote for it in their source; the counts, one row per
source, are broadcast up to a stated size and beyond it joined by source and a
salt, so that no source's stamps meet in one task.

A wall time's offset is that of one of two instants around it, one before and one
after any instant that it can mean; they differ only around a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.frames import cut, table

# The layouts of dates and the form of times.
PLAIN_LAYOUTS = ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "dd MMM yyyy")
FIRST_DAY, DAYS = 10957, 36525  # 2000-01-01 to 2099-12-31, in days since 1970
TOKEN = r"^([0-9]{2} [A-Z][a-z]{2} [0-9]{4}|[^T ]+)"
TIME = r"^[T ](?:(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?|(?:0[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9])? ?[AP]M)(?: ?(?:Z|[+-](?:0[0-9]|1[0-4]):?[0-5][0-9]))?\z"
ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})\z"
SPACE = " \t\n\x0b\x0c\r"
#: One order wins by more than this many times the other's votes.
MAJORITY = 10
#: Bytes of source names and counts that are broadcast at most.
BROADCAST_BYTES = 8 << 20
#: Keys that the stamps of a source are dealt to where the counts are not broadcast.
SALTS = 256
_EARLIEST, _LATEST = 15 * 3600, 13 * 3600  # more than any offset, so that both instants lie beyond the one meant


def date_tokens(spark: SparkSession) -> DataFrame:
    """(token, day_first, month_first): every date string with its day since 1970 by both readings, null where it is none."""
    days = spark.range(FIRST_DAY, FIRST_DAY + DAYS).select(F.col("id").cast("int").alias("n"), F.date_from_unix_date(F.col("id").cast("int")).alias("d"))
    month, day, n = F.month("d"), F.day("d"), F.col("n")
    other = F.when(day <= 12, F.unix_date(F.make_date(F.year("d"), day, month)))
    readings = [F.struct(F.date_format("d", layout).alias("token"), n.alias("day_first"), n.alias("month_first")) for layout in PLAIN_LAYOUTS]
    readings.append(F.struct(F.date_format("d", "dd/MM/yyyy").alias("token"), n.alias("day_first"), other.alias("month_first")))
    readings.append(F.struct(F.when(day > 12, F.date_format("d", "MM/dd/yyyy")).alias("token"), F.lit(None).cast("int").alias("day_first"), n.alias("month_first")))
    return days.select(F.explode(F.array(*readings)).alias("r")).where("r.token is not null").select("r.*")


def _zones(spark: SparkSession) -> list[str]:
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _second_of_day(rest: Column) -> Column:
    """Of a time that TIME matches; no time is midnight."""
    two = lambda at: F.substring(rest, at, 2).cast("int")
    hour, seconds = two(2), F.when(F.substring(rest, 7, 1) == ":", two(8)).otherwise(0)
    hour = F.when(rest.contains("PM"), hour % 12 + 12).when(rest.contains("AM"), hour % 12).otherwise(hour)
    return F.when(rest == "", 0).otherwise(hour * 3600 + two(5) * 60 + seconds)


def _offset(rest: Column) -> Column:
    """Seconds east of UTC as the time states them, else null."""
    stated = F.regexp_extract(rest, ZONE, 1)
    digits = F.regexp_replace(stated, "[^0-9]", "")
    size = F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60
    return F.when(stated == "Z", 0).when(stated != "", F.when(stated.startswith("-"), -size).otherwise(size))


def _parsed(stamps: DataFrame, stamp: str, source: str, zone: str, raw: str) -> DataFrame:
    """(id, source, zone, epoch, day_first, month_first, second, offset): both days null for bad stamps without epoch, both set for dates.

    zone is null unless the zone is known.
    """
    known = F.col(zone).isin(_zones(stamps.sparkSession))
    rows = stamps.select(F.col(stamp).alias("id"), F.col(source).alias("source"), F.when(known, F.col(zone)).alias("zone"), F.btrim(F.col(raw), F.lit(SPACE)).alias("s"))
    epoch = F.when(F.col("s").rlike(r"^[0-9]{10}\z"), F.col("s").cast("long") * 1_000_000).when(F.col("s").rlike(r"^[0-9]{13}\z"), F.col("s").cast("long") * 1000)
    rows = rows.select("id", "source", "zone", "s", epoch.alias("epoch"), F.regexp_extract("s", TOKEN, 1).alias("token"))
    rows = rows.withColumn("rest", F.substr("s", F.length("token") + 1))
    good = (F.col("rest") == "") | F.col("rest").rlike(TIME)
    rows = rows.select("id", "source", "zone", "epoch", F.when(F.col("epoch").isNull() & good, F.col("token")).alias("token"), F.when(good, F.col("rest")).alias("rest"))
    rows = rows.select("id", "source", "zone", "epoch", "token", _second_of_day(F.col("rest")).alias("second"), _offset(F.col("rest")).alias("offset"))
    rows = rows.withColumn("token", F.when(F.coalesce("zone", F.col("offset").cast("string")).isNotNull(), F.col("token")))
    return rows.join(F.broadcast(date_tokens(stamps.sparkSession)), "token", "left")


def _votes(parsed: DataFrame) -> DataFrame:
    """(voter, order): of each source with votes the order that wins, day or month, or default."""
    one = parsed.where(F.col("day_first").isNull() != F.col("month_first").isNull())
    per = one.groupBy(F.col("source").alias("voter")).agg(F.count("day_first").alias("day"), F.count("month_first").alias("month"))
    order = F.when(F.col("day") > MAJORITY * F.col("month"), "day").when(F.col("month") > MAJORITY * F.col("day"), "month").otherwise("default")
    return per.select("voter", order.alias("order"))


def _ordered(parsed: DataFrame, votes: DataFrame, most: int) -> DataFrame:
    """parsed with order: null for all but dates that both readings give differently."""
    open_ = F.col("day_first") != F.col("month_first")
    size = votes.agg(F.sum(F.coalesce(F.octet_length("voter"), F.lit(0)) + 32)).first()[0] or 0
    on = F.col("source").eqNullSafe(F.col("voter"))
    if size <= most:
        found = parsed.join(F.broadcast(votes), on & open_, "left")
        return found.withColumn("order", F.when(open_, F.coalesce("order", F.lit("default")))).drop("voter")
    asked = parsed.where(open_).withColumn("salt", F.pmod(F.xxhash64("id", "day_first", "second"), F.lit(SALTS)).cast("int"))
    dealt = votes.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = asked.join(dealt, on & (F.col("salt") == F.col("salt_")), "left").withColumn("order", F.coalesce("order", F.lit("default")))
    rest = parsed.where(~F.coalesce(open_, F.lit(False))).withColumn("order", F.lit(None).cast("string"))
    return found.select(*rest.columns).unionByName(rest)


def _instant(wall: Column, zone: Column) -> tuple[Column, Column]:
    """Seconds of UTC of a wall time in a zone, and whether the zone skips or repeats it; then the offset after the change holds."""
    offset = lambda at: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), zone)) - at
    before, after = offset(wall - _EARLIEST), offset(wall + _LATEST)
    early, late = wall - before, wall - after
    fits, fits_after = offset(early) == before, offset(late) == after
    plain = before == after
    return F.when(plain, early).when(fits & ~fits_after, early).otherwise(late), ~plain & (fits == fits_after)


def normalise(stamps: DataFrame, stamp: str = "stamp_id", source: str = "source", zone: str = "zone", raw: str = "raw", most: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: the id under its name, utc_us, rule (bad, epoch, votes, default, plain), ambiguous.

    Null, empty and very long texts are bad unless they are stamps. A date without
    offset whose zone is null or no name of the time zone database is bad, too, and
    does not vote. Null sources vote together as one source. Repeated rows and null
    ids are rows of their own and each votes; an empty table gives no rows; other
    columns are ignored. Counts of sources larger than `most` bytes are joined by
    source and salt instead of a broadcast, with the same result.
    """
    parsed = _parsed(stamps, stamp, source, zone, raw)
    slashed = stamps.where(F.col(raw).contains("/"))
    votes = cut(_votes(_parsed(slashed, stamp, source, zone, raw)))
    rows = _ordered(parsed, votes, most)
    day = F.when(F.col("order") == "month", F.col("month_first")).otherwise(F.coalesce("day_first", "month_first"))
    wall = day.cast("long") * 86400 + F.col("second")
    rows = rows.select("id", "epoch", "order", "zone", "offset", wall.alias("wall"))
    found, unsure = _instant(F.col("wall"), F.coalesce("zone", F.lit("UTC")))
    placed = F.when(F.col("offset").isNotNull(), F.struct((F.col("wall") - F.col("offset")).alias("at"), F.lit(False).alias("unsure"))).otherwise(F.struct(found.alias("at"), unsure.alias("unsure")))
    rows = rows.withColumn("placed", placed)
    rule = F.when(F.col("epoch").isNotNull(), "epoch").when(F.col("wall").isNull(), "bad").when(F.col("order").isNull(), "plain").when(F.col("order") == "default", "default").otherwise("votes")
    return rows.select(
        F.col("id").alias(stamp), F.coalesce("epoch", F.col("placed.at") * 1_000_000).alias("utc_us"), rule.alias("rule"),
        (F.col("wall").isNotNull() & (F.col("order").isNotNull() | F.coalesce("placed.unsure", F.lit(False)))).alias("ambiguous"),
    )


def op13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all stamps as microseconds of UTC."""
    return normalise(table(spark, sf_dir, "stamps"))


OP13_SQL = r"""
WITH trimmed AS (SELECT row_number() OVER () AS rid, stamp_id, source, zone, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS s FROM stamps),
forms AS (
  SELECT *, regexp_full_match(s, '[0-9]{10}') AS seconds, regexp_full_match(s, '[0-9]{13}') AS millis,
    regexp_extract(s, '^(20[0-9]{2}-[0-9]{2}-[0-9]{2}|20[0-9]{6}|[0-9]{2}[.][0-9]{2}[.]20[0-9]{2}|[0-9]{2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}|[0-9]{2}/[0-9]{2}/20[0-9]{2})(?:$|[T ])', 1) AS d
  FROM trimmed),
cut AS (
  SELECT *, substr(s, length(d) + 1) AS t FROM forms),
times AS (
  SELECT *, regexp_extract(t, '^[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP]M))?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?$', ['h', 'm', 's', 'half', 'o']) AS p FROM cut),
numbers AS (
  SELECT *, try_cast(p.h AS INT) AS h, try_cast(p.m AS INT) AS mi, coalesce(try_cast(nullif(p.s, '') AS INT), 0) AS sec, nullif(p.o, '') AS o FROM times),
valid AS (
  SELECT *, CASE WHEN t = '' THEN 0
      WHEN p.half <> '' AND h BETWEEN 1 AND 12 AND mi < 60 AND sec < 60 THEN (h % 12 + CASE WHEN p.half = 'PM' THEN 12 ELSE 0 END) * 3600 + mi * 60 + sec
      WHEN p.half = '' AND h < 24 AND mi < 60 AND sec < 60 THEN h * 3600 + mi * 60 + sec END AS tod,
    CASE WHEN o IS NULL OR o = 'Z' THEN true ELSE CAST(substr(o, 2, 2) AS INT) <= 14 AND CAST(right(o, 2) AS INT) < 60 END AS offset_fits,
    CASE WHEN o = 'Z' THEN 0 WHEN o IS NOT NULL THEN (CAST(substr(o, 2, 2) AS INT) * 3600 + CAST(right(o, 2) AS INT) * 60) * CASE WHEN o[1] = '-' THEN -1 ELSE 1 END END AS off
  FROM numbers),
dates AS (
  SELECT *, contains(d, '/') AS slashed,
    CASE WHEN contains(d, '/') THEN try_strptime(d, '%d/%m/%Y') WHEN contains(d, '-') THEN try_strptime(d, '%Y-%m-%d') WHEN contains(d, '.') THEN try_strptime(d, '%d.%m.%Y') WHEN contains(d, ' ') THEN try_strptime(d, '%d %b %Y') ELSE try_strptime(d, '%Y%m%d') END AS one,
    CASE WHEN contains(d, '/') THEN try_strptime(d, '%m/%d/%Y') END AS two
  FROM (SELECT * FROM valid WHERE d <> '' AND tod IS NOT NULL AND offset_fits)),
votes AS (
  SELECT source, count(one) AS dm, count(two) AS md FROM dates WHERE slashed AND (one IS NULL) <> (two IS NULL) GROUP BY source),
chosen AS (
  SELECT x.*, coalesce(slashed AND one <> two, false) AS open_, coalesce(dm, 0) AS dm, coalesce(md, 0) AS md FROM dates AS x LEFT JOIN votes AS v ON x.source IS NOT DISTINCT FROM v.source),
walls AS (
  SELECT rid, stamp_id, zone, off, CASE WHEN NOT open_ THEN 'plain' WHEN md > 10 * dm OR dm > 10 * md THEN 'votes' ELSE 'default' END AS rule,
    (CASE WHEN open_ AND md > 10 * dm THEN two ELSE coalesce(one, two) END) + to_seconds(tod) AS w
  FROM chosen WHERE coalesce(one, two) IS NOT NULL),
first AS (SELECT *, timezone('UTC', timezone(zone, w)) AS u, timezone(zone, timezone(zone, w)) AS back FROM walls),
second AS (SELECT *, CASE WHEN back <> w THEN w - (back - u) ELSE u END AS v, timezone(zone, timezone('UTC', u - INTERVAL 26 HOUR)) - (u - INTERVAL 26 HOUR) AS before FROM first),
third AS (SELECT *, back <> w OR (w - before <> v AND timezone(zone, timezone('UTC', w - before)) = w) AS unsure FROM second),
placed AS (
  SELECT rid, stamp_id, rule, CASE WHEN off IS NOT NULL THEN epoch_us(w) - CAST(off AS BIGINT) * 1000000 ELSE epoch_us(v) END AS utc_us, rule <> 'plain' OR (off IS NULL AND unsure) AS ambiguous FROM third)
SELECT stamp_id, CAST(s AS BIGINT) * CASE WHEN seconds THEN 1000000 ELSE 1000 END AS utc_us, 'epoch' AS rule, false AS ambiguous FROM forms WHERE seconds OR millis
UNION ALL SELECT stamp_id, utc_us, rule, ambiguous FROM placed
UNION ALL SELECT stamp_id, NULL, 'bad', false FROM forms WHERE NOT coalesce(seconds OR millis, false) AND rid NOT IN (SELECT rid FROM placed)
"""
