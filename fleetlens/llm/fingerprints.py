"""Document fingerprints from closed syncmers (native).

A k-mer of k units is kept when the smallest hash among its s-mers is the
first or the last of them. That depends on the k-mer alone, so an edit moves
only the anchors that it touches, and anchors of two documents can be matched
by position (match_positions). Units are words, in pieces of up to 16 code
points, and single letters of scripts without spaces. Every text begins and
ends with k - 1 blank units, so that texts of any length, even of one word,
have k-mers under one and the same rule. Blank s-mers are the greatest of all,
so the k-mers of the first and of the last unit alone are closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: k-mers of seven units hold six s-mers of two units; one k-mer in three is closed.
K, S = 7, 2
#: Code point ranges of scripts without spaces: South-East Asian ones, kana and Han.
_UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
UNIT = rf"[^\s{_UNSPACED}]{{1,16}}|[{_UNSPACED}]"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: array<struct<pos int, hash int>>, the closed syncmers of the text in order; pos is the k-mer's first unit, negative for blank ones.

    Null text and text of white space alone have no anchors; every other has.
    """
    u, h, sm, a = (f"{out}_{x}_" for x in ("units", "hashes", "smers", "all"))
    df = df.withColumn(u, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)))
    blank = F.array_repeat(F.lit(0).cast("long"), K - 1)
    df = df.withColumn(h, F.concat(blank, F.transform(u, lambda x: F.xxhash64(x)), blank)).withColumn(u, F.size(u))
    df = df.withColumn(sm, F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda x, y: F.when((x == 0) & (y == 0), F.lit(2**63 - 1)).otherwise(F.xxhash64(x, y))))
    n = K - S + 1
    windows = F.arrays_zip(*[F.slice(sm, j + 1, F.size(sm) - n + 1).alias(f"s{j}") for j in range(n)])
    kept = F.transform(
        windows,
        lambda w, i: F.when(
            F.least(w["s0"], w[f"s{n - 1}"]) <= F.least(*[w[f"s{j}"] for j in range(1, n - 1)]),
            F.struct((i - (K - 1)).cast("int").alias("pos"), F.hash(*[w[f"s{j}"] for j in (*range(0, n - 1, 2), n - 1)]).alias("hash")),
        ),
    )
    df = df.withColumn(a, F.filter(kept, lambda x: x.isNotNull()))
    none = F.array().cast("array<struct<pos:int,hash:int>>")
    return df.withColumn(out, F.when(F.col(u) == 0, none).otherwise(F.col(a))).drop(u, h, sm, a)


def anchor_set(anchors: Column) -> Column:
    return F.array_distinct(F.transform(anchors, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of anchor hashes; 1 for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def printed(hashes: Column) -> Column:
    """Eight hexadecimal digits an anchor."""
    return F.array_join(F.transform(hashes, lambda x: F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))), "")


def match_positions(anchored: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shift, n, first, last: for each of the pairs (a, b) of doc_ids, the anchors that both have at one and the same shift.

    anchored has doc_id and anchors; shift is the position in a less that in b,
    n the anchors met at it, first and last their range of positions in a.
    """
    each = anchored.select("doc_id", F.explode("anchors").alias("x")).select("doc_id", "x.pos", "x.hash")
    left = pairs.join(each.select(F.col("doc_id").alias("a"), F.col("pos").alias("at"), "hash"), "a")
    met = left.join(each.select(F.col("doc_id").alias("b"), "pos", "hash"), ["b", "hash"])
    return met.groupBy("a", "b", (F.col("at") - F.col("pos")).alias("shift")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def _seats(spark, n: int) -> list[int]:  # noqa: ANN001
    """For each of n shuffle partitions an integer that Spark's hash deals to it, so that no two ranges share one."""
    found: dict[int, int] = {}
    for r in spark.range(0, 64 * n, 1, 1).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect():
        found.setdefault(r.p, r.id)
    return [found.get(p, p) for p in range(n)]


def with_next(docs: DataFrame, column: str, out: str) -> tuple[DataFrame, object]:
    """docs with the value of column of the next row by descending doc_id (after the last: the first), and the window used.

    Rows are cut into ranges of doc_id, one a shuffle partition. The first row
    of each range is also dealt, as a guest, to the range before it, so one
    shuffle is enough and no task holds more than a range. What reaches the driver is a splitter and a
    head for each range, as many as there are shuffle partitions. Equal ids
    are ordered by the text's hash; null ids come last.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    splits = sorted({int(x) for x in splits or []})
    bucket = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in splits]).cast("array<bigint>"), lambda x: x < F.coalesce("doc_id", F.lit(-(2**63))))) if splits else F.lit(0)
    heads = docs.select("doc_id").withColumn("bucket", bucket).groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy(F.desc("bucket")).collect()
    guests = [(heads[i].head, heads[i - 1].bucket) for i in range(len(heads))]
    seats = F.array(*[F.lit(x) for x in _seats(spark, n)])
    values = ", ".join(f"(cast({'null' if g is None else g} as bigint), {b})" for g, b in guests) or "(cast(null as bigint), 0)"
    host = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(head, host)"))
    dealt = docs.withColumn("bucket", bucket).join(host, F.col("doc_id").eqNullSafe(F.col("head")), "left")
    dealt = dealt.withColumn("tie_", F.xxhash64("text"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    dealt = dealt.withColumn("seat", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    dealt = dealt.drop("bucket", "host", "head").withColumns({"bucket_": F.element_at(seats, F.col("seat.bucket") + 1), "guest_": F.col("seat.guest")}).drop("seat")
    w = W.partitionBy("bucket_").orderBy("guest_", F.desc_nulls_last("doc_id"), F.desc("tie_"))
    return dealt.withColumn(out, F.lead(column).over(w)), w


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, anchors, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n/2) code points by the first as
    many (or all) of the next document. doc_id is a bigint. Null text counts as
    empty: empty fingerprint, likeness 1 to another empty one and 0 to any other. Repeated
    rows are rows of their own. A single document is its own next. Other
    columns of docs are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, w = with_next(docs, "text", "next_text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = with_anchors(with_anchors(rows, "text", "anchors"), "edited", "edited_anchors")
    rows = rows.withColumns({"own_set": anchor_set(F.col("anchors")), "edited_set": anchor_set(F.col("edited_anchors"))})
    rows = rows.withColumns({"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)}).drop("text", "edited", "edited_anchors")
    rows = rows.withColumn("next_set", F.lead("own_set").over(w)).filter("guest_ = 0")
    return rows.select(
        "doc_id", "n_chars", "anchors", "edited_sha256", printed(F.col("own_set")).alias("fingerprint"), printed(F.col("edited_set")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
