"""Mixing sources to target weights by systematic sampling (native).

Every document of a source has the same expected number of copies,
``rate = target / source_size``. Documents of a source are put in one order,
their expected copies are prefix-summed, one offset in [0, 1) is added, and a
document is emitted once for every integer that its interval crosses. Sorting
by size class before summing makes each stretch of the order alike in size, so
the words taken stay within about one large document of the target.

The prefix sum never gathers a source in one task: ranks are counted inside
(source, size class, salt) buckets, and only the bucket counts are summed
across a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 3
SALTS = 64


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target, start: one row a source.

    Weights are 1, 2, 3, repeating over the sources in code point order (null
    last); targets share the sum of all sizes by weight, none above max_repeat
    times its source's size. The level that solves this is the largest of the
    levels got by capping the j sources with the smallest cap per weight.
    start is the sampling offset, a fixed hash of the source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy()
    ranked = (
        totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", (F.col("rank") - 1) % 3 + 1)
        .withColumn("cap", max_repeat * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything))
    )
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    levels = ranked.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)),
    ).withColumn("level", F.max("level").over(everything))
    start = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("\0")))), 1, 6), 16, 10).cast("double") / 2**24
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"), start.alias("start"))


def mix_sources(docs: DataFrame, max_repeat: int = MAX_REPEAT, salts: int = SALTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= copies * size).

    Null text has size 0 and takes 0; null source is a source of its own;
    repeated rows are sampled one by one (ties in the order are alike, so it
    does not matter which comes first); an empty table gives no rows. Other
    columns of docs are ignored.
    """
    bits = "length(bin(size))"
    keyed = (
        word_sizes(docs)
        .withColumn("class", F.expr(f"4 * {bits} + (shiftright(size, cast(greatest({bits} - 3, 0) as int)) & 3)"))
        .withColumn("salt", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(salts)))
    )
    targets = source_targets(keyed, max_repeat)
    counts = keyed.groupBy("source", "class", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("class", "salt").rowsBetween(W.unboundedPreceding, -1))
    buckets = counts.withColumn("before", F.coalesce(before, F.lit(0))).alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    buckets = buckets.select(F.col("b.source").alias("bucket_source"), F.col("class").alias("bucket_class"), F.col("salt").alias("bucket_salt"), "before", "source_size", "target", "start")
    ranked = keyed.withColumn("at", F.row_number().over(W.partitionBy("source", "class", "salt").orderBy("size", "doc_id")))
    joined = ranked.join(buckets, F.col("source").eqNullSafe(F.col("bucket_source")) & (F.col("class") == F.col("bucket_class")) & (F.col("salt") == F.col("bucket_salt")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    end = F.col("before") + F.col("at")
    copies = (F.floor(F.col("start") + rate * end) - F.floor(F.col("start") + rate * (end - 1))).cast("long")
    return joined.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
keyed AS (SELECT *, 4 * length(bin(size)) + ((size >> greatest(length(bin(size)) - 3, 0)) & 3) AS class,
                 ((coalesce(doc_id, 0) % 64) + 64) % 64 AS salt FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
                  row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, sum(source_size) OVER () AS total FROM totals),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                     / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM ranked),
targets AS (SELECT source, source_size, least(cap::DOUBLE, max(lv) OVER () * weight) AS target,
                   ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 6))::BIGINT::DOUBLE / 16777216 AS start FROM levels),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id) AS pos FROM keyed),
rated AS (SELECT doc_id, p.source, size, source_size, target, start, pos,
                 CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
          FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (floor(start + rate * pos) - floor(start + rate * (pos - 1)))::BIGINT AS copies,
       ((floor(start + rate * pos) - floor(start + rate * (pos - 1))) * size)::BIGINT AS taken FROM rated
"""


def emit_copies(docs: DataFrame, max_repeat: int = MAX_REPEAT, salts: int = SALTS) -> DataFrame:
    """docs with a row for each copy that the mix takes.

    Sizes, order and copies are those of mix_sources. A document of no words
    counts for nothing in a mix of words and is kept as it is. The copies of
    rows with one doc_id, source and size are handed out among them in the
    order of their whole rows, so that a stage run again deals them alike.
    """
    mixed = mix_sources(docs, max_repeat, salts).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), words.alias("words"))
    joined = packed.join(mixed, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    once = joined.filter("rows = 1").select("row", "words", "copies")
    at = F.row_number().over(W.partitionBy("id", "of", "words").orderBy(F.to_json("row")))
    share = F.floor(F.col("copies") * F.col("at") / F.col("rows")) - F.floor(F.col("copies") * (F.col("at") - 1) / F.col("rows"))
    more = joined.filter("rows > 1").withColumn("at", at).select("row", "words", share.alias("copies"))
    every = once.unionByName(more).withColumn("copies", F.when(F.col("words") == 0, 1).otherwise(F.col("copies"))).filter("copies > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
