"""Sharding by extendible hashing (native).

The directory is indexed by the leading bits of a hash. A bucket is split on
one more bit only while it is over the byte limit, so a shard is the shortest
hash prefix whose documents fit. Instead of splitting level by level over the
data, bytes are summed once per cell of the deepest level that is likely to be
needed, the cells are summed upwards, and only documents of cells that are
still too large go through the remaining levels one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .storage import cut, free_name

LIMIT_BYTES = 1_000_000
HASH_BITS = 60


def hash_key() -> Column:
    """60 leading bits of an MD5 of the id and the text's MD5."""
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(key: str, depth: Column, bits: int) -> Column:
    return F.expr(f"shiftright({key}, cast({bits} - depth as int))") if depth is None else F.call_function("shiftright", F.col(key), (F.lit(bits) - depth).cast("int"))


def _fit(cells: DataFrame, bits: int, low: int, high: int, limit: int) -> DataFrame:
    """cell, depth, shard_bytes, shard_docs: the least depth in low..high at which the cell's prefix fits."""
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", _prefix("cell", F.col("depth"), bits))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")).filter(F.col("bytes") <= limit)
    first = sums.agg(F.min("depth")).first()[0]  # no shard is shallower, so the few prefixes above needn't meet all cells
    fits = levels.select("cell", "depth", "prefix").filter(F.col("depth") >= (high + 1 if first is None else first)).join(sums, ["depth", "prefix"])
    return fits.groupBy("cell").agg(F.min(F.struct("depth", "bytes", "docs")).alias("fit")).select("cell", "fit.depth", F.col("fit.bytes").alias("shard_bytes"), F.col("fit.docs").alias("shard_docs"))


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and keep), n_bytes, shard, depth, shard_bytes, shard_docs, oversize.

    shard is the directory prefix as a string of depth bits, followed by
    "#page" where rows with one and the same hash (repeated rows) exceed the
    limit together; such rows are dealt to pages of as many as fit. A document
    larger than the limit is a page of its own, marked oversize. Null text has
    0 bytes, null ids are hashed as empty, an empty table gives no rows; other
    columns are only carried where keep names them. A column of keep that is
    called like one of the result is followed by it under a name with an
    underscore more (shard and shard_).
    """
    spark = docs.sparkSession
    keep = [c for c in (keep or []) if c != "doc_id"]
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")
    sized = docs.select("doc_id", carried.alias("kept_"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_key().alias("hash_key_"))
    keys = cut(sized.select("hash_key_", "n_bytes"))  # narrow: the texts are read once for it and once for the result
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS - 1, max(8, math.ceil(math.log2(max(total, 1) / limit_bytes + 1)) + 6))
    cell = F.shiftright("hash_key_", HASH_BITS - bits).alias("cell")
    cells = cut(keys.groupBy(cell).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")))
    directory = cut(cells.select("cell").join(_fit(cells, bits, 0, bits, limit_bytes), "cell", "left"))
    over = keys.select("hash_key_", "n_bytes", cell).join(directory.filter("depth is null"), "cell", "left_semi")
    over = cut(over.groupBy(F.col("hash_key_").alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")))
    deep = over.select("cell").join(_fit(over, HASH_BITS, bits + 1, HASH_BITS, limit_bytes), "cell", "left")
    placed = sized.select("*", cell).join(directory, "cell")
    done = placed.filter(F.col("depth").isNotNull()).withColumn("page", F.lit(None).cast("long"))
    rest = placed.filter(F.col("depth").isNull()).drop("depth", "shard_bytes", "shard_docs", "cell").withColumn("cell", F.col("hash_key_"))
    rest = rest.join(deep, "cell")
    fits = F.col("depth").isNotNull()
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest("n_bytes", F.lit(1))))
    page = F.when(~fits, F.floor((F.row_number().over(W.partitionBy("cell", F.when(~fits, F.lit(1))).orderBy("n_bytes")) - 1) / per_page))
    rest = rest.withColumn("page", page)
    on_page = F.count("*").over(W.partitionBy("cell", "page", F.when(~fits, F.lit(1))))
    rest = (
        rest.withColumn("on_page", F.when(~fits, on_page))
        .withColumn("shard_docs", F.when(fits, F.col("shard_docs")).otherwise(F.col("on_page")))
        .withColumn("shard_bytes", F.when(fits, F.col("shard_bytes")).otherwise(F.col("on_page") * F.col("n_bytes")))
        .withColumn("depth", F.coalesce("depth", F.lit(HASH_BITS)))
    )
    columns = ["doc_id", "kept_", "n_bytes", "hash_key_", "depth", "page", "shard_bytes", "shard_docs"]
    both = done.select(*columns).unionByName(rest.select(*columns))
    prefix = F.call_function("substring", F.lpad(F.bin("hash_key_"), HASH_BITS, "0"), F.lit(1), F.col("depth"))
    shard = F.concat(prefix, F.coalesce(F.concat(F.lit("#"), F.col("page").cast("string")), F.lit("")))
    own = both.select("doc_id", *[F.col("kept_").getField(c).alias(c) for c in keep])
    named = {c: free_name(own, c) for c in ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversize")}
    result = {"n_bytes": F.col("n_bytes"), "shard": shard, "depth": F.col("depth").cast("int"), "shard_bytes": F.col("shard_bytes"), "shard_docs": F.col("shard_docs"), "oversize": F.col("n_bytes") > limit_bytes}
    return both.select("doc_id", *[F.col("kept_").getField(c).alias(c) for c in keep], *[x.alias(named[c]) for c, x in result.items()])


SHARD_SQL = """
WITH sized AS (SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k FROM {docs}),
levels AS (SELECT rid, k, n_bytes, d::INTEGER AS d, k >> (60 - d)::INTEGER AS p FROM sized, range(0, 61) AS t(d)),
sums AS (SELECT d, p, sum(n_bytes)::BIGINT AS b, count(*)::BIGINT AS c FROM levels GROUP BY d, p HAVING sum(n_bytes) <= {limit}),
fits AS (SELECT rid, min(l.d) AS depth FROM levels l JOIN sums s ON l.d = s.d AND l.p = s.p GROUP BY rid),
pages AS (SELECT s.*, f.depth, CASE WHEN f.depth IS NULL THEN
    (row_number() OVER (PARTITION BY k, f.depth IS NULL ORDER BY n_bytes) - 1) // greatest(1, {limit} // greatest(n_bytes, 1)) END AS page
    FROM sized s LEFT JOIN fits f ON s.rid = f.rid)
SELECT doc_id, n_bytes, substr(lpad(bin(k), 60, '0'), 1, coalesce(depth, 60)) || coalesce('#' || page::VARCHAR, '') AS shard,
    coalesce(depth, 60)::INTEGER AS depth,
    CASE WHEN depth IS NULL THEN n_bytes * count(*) OVER (PARTITION BY k, depth, page)
         ELSE (SELECT b FROM sums WHERE sums.d = depth AND sums.p = k >> (60 - depth)) END::BIGINT AS shard_bytes,
    CASE WHEN depth IS NULL THEN count(*) OVER (PARTITION BY k, depth, page)
         ELSE (SELECT c FROM sums WHERE sums.d = depth AND sums.p = k >> (60 - depth)) END::BIGINT AS shard_docs,
    n_bytes > {limit} AS oversize
FROM pages
"""
