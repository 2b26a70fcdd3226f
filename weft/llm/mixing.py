"""Mixing sources to target weights with a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule w(x) = 1 + slope * (2x - 1) over training
progress x in [0, 1]. Its integral, scaled to the source's target, is the
cumulative token demand; documents queue in a fixed random order per source,
again and again where the target asks for repeats, and the inverse of the
demand at a document's place in the queue is its training position. Documents
are range-sorted by position.

Places in a queue are prefix sums in two levels, over the sums of a source's
order buckets and inside a bucket, so that no source meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.frames import row_id, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights and schedule slopes, dealt to the sources in code-point order, repeating; most repeats.
WEIGHTS = (5, 2, 1)
SLOPES = (0.5, 0.0, -0.5)
MOST_REPEATS = 3
_BUCKET_ROWS = 1 << 16  # documents of an order bucket, about


def _dealt(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """(skey, source_size, target, slope) from (skey, size): shares by weight, at most `repeats` times a source's size.

    What a cap leaves over is reshared by weight among the rest until none is
    above its cap: sources in order of cap per weight are capped while their cap
    is below their share of what is left. All sums are whole numbers. Only the
    table of sources meets in one task.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("skey")  # null sources have the key that sorts last
    per = per.withColumn("rank", F.row_number().over(by_name).cast("long") - 1)
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    per = per.withColumn("weight", _dealt(weights, F.col("rank")).cast("long")).withColumn("cap", F.col("source_size") * repeats)
    every, before = Window.partitionBy(F.lit(1)), Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    per = per.withColumns({"all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "cap_before": F.coalesce(F.sum("cap").over(before), none), "weight_before": F.coalesce(F.sum("weight").over(before), none)})
    left, weight_left = F.col("all_size") - F.col("cap_before"), F.col("all_weight") - F.col("weight_before")
    per = per.withColumn("capped", whole("cap") * weight_left.cast("decimal(12,0)") <= left.cast("decimal(20,0)") * F.col("weight").cast("decimal(6,0)"))
    per = per.withColumns({"capped_size": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every), "capped_weight": F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(every)})
    share = (F.col("weight") * (F.col("all_size") - F.col("capped_size"))).cast("double") / (F.col("all_weight") - F.col("capped_weight")).cast("double")
    return per.select("skey", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"), _dealt(SLOPES, F.col("rank")).alias("slope"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training order of docs: one row per input row with size, source_size, target, copies, taken and positions.

    A copy is taken if its middle word falls within its source's target, so a
    source's sum is off by half a document at most. Documents are whole: taken is
    copies * size. Null texts have size 0, null sources form the last source, a
    null id takes its turn by its text; empty documents are never taken. Rows come
    sorted by first position, those not taken last. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("skey"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), text))).alias("turn"), F.xxhash64(text).alias("tie"),
    )
    digits = max(3, math.ceil(math.log(max(1, docs.count() / _BUCKET_ROWS), 16)))  # 4,096 order buckets of each source at least
    rows = rows.withColumn("bucket", F.substring("turn", 1, digits))
    buckets = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0).cast("long")))
    targets = source_targets(buckets.select("skey", F.col("bucket_size").alias("size")), weights, repeats)
    buckets = buckets.join(targets, "skey").drop("bucket_size")
    queue = Window.partitionBy("skey", "bucket").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(buckets, ["skey", "bucket"]).withColumn("place", F.col("before") + F.sum("size").over(queue) - F.col("size"))
    middle = F.col("place") + F.col("size") / 2
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.lit(repeats), F.ceil((F.col("target") - middle) / F.col("source_size"))))).otherwise(0).cast("int")
    placed = placed.withColumn("copies", copies)
    share = "least(1D, (k * source_size + place) / target)"
    position = f"CASE WHEN slope = 0 THEN {share} ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * {share})) / (2 * slope) END"
    positions = F.when(F.col("copies") > 0, F.expr(f"transform(sequence(0, copies - 1), k -> {position})")).otherwise(F.expr("cast(array() as array<double>)"))
    out = placed.select(F.col("doc").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"), "tie")
    return out.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), id_col, "tie")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """op9: the mix of all documents by the weights 5, 2, 1."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, ''))) AS turn, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per
), weighed AS (
  SELECT *, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight, source_size * 3 AS cap FROM ranked
), summed AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, cap * (all_weight - weight_before) <= (all_size - cap_before) * weight AS capped FROM summed
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * (all_size - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()))::DOUBLE
         / (all_weight - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::DOUBLE END AS target
  FROM marked
), placed AS (
  SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY turn ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS place FROM sized
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN greatest(0, least(3, ceil((target - (place + size / 2.0)) / source_size)))::BIGINT * size ELSE 0 END AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
"""
