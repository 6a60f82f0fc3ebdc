"""The bounded sample of labelled texts that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id is not held out (and never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label of at most `most` labelled rows of the training folds (crc32 mod 5 isn't 0), in hash order; one row an id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


#: Most bytes of labelled texts that are learned from.
MAX_BYTES = 128 << 20


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, label of the sample: in hash order, each text that still fits into most_bytes.

    A text that doesn't fit is left out by itself; those behind it are still
    taken. Of the texts of a repeated id the one of least hash counts. Labels
    whose texts are all too long raise ValueError: a classifier that has
    learned nothing would keep everything. Sizes and ids pass the driver (at
    most `most` rows), the texts don't.
    """
    ids = F.broadcast(training_ids(labels, label, most))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").withColumn("hash", F.xxhash64("text"))
    of_id = found.groupBy("doc_id").agg(F.min(F.struct("hash", F.octet_length("text").alias("n"))).alias("one"))
    sized = of_id.select("doc_id", "one.hash", "one.n", F.xxhash64("doc_id").alias("order"))
    chosen, held = [], 0
    rows = sorted(sized.collect(), key=lambda r: (r.order, r.doc_id))
    for r in rows:
        if held + r.n <= most_bytes:
            held += r.n
            chosen.append((r.doc_id, r.hash))
    if rows and not chosen:
        raise ValueError(f"none of {len(rows)} labelled texts has at most {most_bytes} bytes")
    wanted = docs.sparkSession.createDataFrame(chosen, sized.select("doc_id", "hash").schema)
    return found.join(F.broadcast(wanted), ["doc_id", "hash"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """(text, label) of sampled_texts by doc_id, fetched to the driver."""
    kept = sampled_texts(docs, labels, label, most, most_bytes).collect()
    return [(r.text, r.label) for r in sorted(kept, key=lambda r: r.doc_id)]
