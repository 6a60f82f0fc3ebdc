"""Target-distribution importance resampling over hashed word n-grams.

Texts become rows of a sparse document-by-bucket count matrix, which is written
once as CSR blocks. Two passes over the blocks do the rest: column sums give the
distribution of the corpus, and the product of the matrix with the vector of
gains gives each document's weight. Gumbel noise from the id turns "draw without
replacement by weight" into "the highest scores", and those are numbered by a
range-partitioned sort.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship, stored
from .counting import planes, unplanes
from .storage import checkpoint_dir, numbered

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased bytes: what isn't [\x00-\x2F\x3A-\x60\x7B-\x7F]
GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")

#: Bytes of text that are hashed at once, and stored entries of a block.
WINDOW_BYTES, BLOCK_ENTRIES = 1 << 20, 1 << 20

BLOCK = "doc_ids array<{kind}>, words binary, starts binary, buckets binary, counts binary"


def text_row(text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, buckets in order, counts) of a text: its runs of 1 to longest words, joined by a space, by crc32 modulo buckets.

    The crc of a longer run goes on from that of the shorter one. Long texts are
    taken a window at a time, with the last words of the window before.
    """
    n, at = 0, 0
    held: list[bytes] = []
    sums = np.zeros(buckets, np.int64)
    while at < len(text):
        gap = GAP.search(text, at + WINDOW_BYTES) if len(text) - at > 2 * WINDOW_BYTES else None
        end = gap.end() if gap else len(text)
        fresh = WORD.findall(text[at:end].lower())
        words = held + fresh
        spaced = [b" " + w for w in words]
        crcs = list(map(crc32, words))
        for k in range(longest):  # crcs[i]: of words i to i + k; it is new if its last word is
            if k:
                crcs = list(map(crc32, spaced[k:], crcs))
            new = crcs[max(0, len(held) - k) :]
            if new:
                sums += np.bincount(np.array(new, np.uint32) % np.uint32(buckets), minlength=buckets)
        n += len(fresh)
        held = words[-(longest - 1) :] if longest > 1 else []
        at = end
    where = np.flatnonzero(sums)
    return n, where, sums[where]


def _block(ids: list, rows: list[tuple[int, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    """Documents' rows as one CSR block: bucket numbers as differences within a row, all of them in compressed byte planes."""
    steps = [np.diff(b, prepend=0) for _, b, _ in rows]
    cells = [planes(np.concatenate(x) if x else np.zeros(0, np.int64), width) for x, width in ((steps, 4), ([c for _, _, c in rows], 5))]
    sizes = planes(np.array([len(b) for _, b, _ in rows], np.int64), 4)
    columns = [pa.array([ids], pa.list_(kind)), *(pa.array([x], pa.binary()) for x in (planes(np.array([n for n, _, _ in rows], np.int64), 5), sizes, *cells))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_ids", "words", "starts", "buckets", "counts"])


def _unblock(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, row starts and the end, bucket and count of each entry)."""
    words, sizes, steps, counts = (unplanes(block[c], w).astype(np.int64) for c, w in (("words", 5), ("starts", 4), ("buckets", 4), ("counts", 5)))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    run = np.cumsum(steps)
    before = np.where(starts[:-1] > 0, run[np.maximum(starts[:-1], 1) - 1], 0) if len(run) else np.zeros(len(sizes), np.int64)
    return words, starts, run - np.repeat(before, sizes), counts


def csr_blocks(docs: DataFrame, key: str = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The count matrix of docs' texts, a block a row: ids, words a row, row sizes, bucket steps, counts. It has not been written yet."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, entries, of = [], [], 0, None
        for batch in batches:
            of = batch.schema.field("doc_id").type
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                rows.append(text_row(t.as_py(), buckets, longest))
                ids.append(i)
                entries += len(rows[-1][1])
                if entries >= BLOCK_ENTRIES:
                    yield _block(ids, rows, of)
                    ids, rows, entries = [], [], 0
        if ids:
            yield _block(ids, rows, of)

    return docs.select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, BLOCK.format(kind=kind))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The matrix' column sums: each task adds up its blocks, so a column comes to the shuffle once a task; the result has a number a bucket."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                _, _, at, counts = _unblock(block)
                np.add.at(total, at, counts)
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(total[where], pa.int64())], names=["bucket", "n"])

    own = blocks.select("buckets", "counts", "starts", "words").mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    big, goal, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: float((t + 1) * (big + n)) / float((s + 1) * (goal + n))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weights(blocks: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row: the matrix times the gains (10,000 numbers, which go out with the tasks)."""
    ship(blocks.sparkSession)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.select(["words", "starts", "buckets", "counts"]).to_pylist()):
                words, starts, at, counts = _unblock(block)
                run_up = np.concatenate(([0], np.cumsum(gains[at] * counts)))
                features = sum(np.maximum(words - k, 0) for k in range(longest))
                ids = batch.column("doc_ids")[i].values
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (words, features, run_up[starts[1:]] - run_up[starts[:-1]]))], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def with_scores(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """weighted with score = weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from sha256("<seed>:<doc_id>"); a null id is hashed as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighted.withColumn("score", F.col("weight") + noise.cast("bigint"))


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where a row isn't drawn.

    target: rows with a text, whose distribution the draw goes after. Of the N
    rows with at least min_words words floor(percent * N / 100) are drawn, by
    score, then the smaller doc_id (null first), then the fewer features and the
    smaller weight: rows that are equal in all of these are interchangeable. A
    null or empty text has no features and weight 0, and so has every text where
    there are no words at all. An empty target is a flat distribution. Repeated
    rows count and are drawn one by one. Other columns are not read.
    """
    spark = docs.sparkSession
    kept = lambda blocks: stored(blocks, f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}")
    matrix = kept(csr_blocks(docs, buckets=buckets))
    goal = column_sums(csr_blocks(target.select(F.lit(0).alias("doc_id"), "text"), buckets=buckets), buckets)
    scored = with_scores(weights(matrix, bucket_gains(column_sums(matrix, buckets), goal)), seed)
    able = F.col("n_words") >= min_words
    order = [(~able).asc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = numbered(scored, order)
    drawn = ranked.agg(F.count_if(able)).first()[0] * percent // 100
    rank = F.when(able & (F.col("position") <= drawn), F.col("position"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


#: Words and crc32 spelled out in DuckDB: the table of the polynomial 0xEDB88320 is made by its rule, eight steps a byte.
RESAMPLE_SQL = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)::BIGINT AS v FROM (SELECT unnest(range(256))::BIGINT AS i))),
texts AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM {docs} UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM {target}),
words AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, row, array_to_string(w[i : i + k], ' ') AS f FROM (SELECT side, row, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest([0, 1, 2]) AS k) WHERE i + k <= len(w)),
distinct_runs AS (SELECT f, unhex_list AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)), LATERAL (SELECT list_transform(range(0, len(h) // 2), lambda j: ('0x' || h[2 * j + 1 : 2 * j + 2])::BIGINT) AS unhex_list)),
named AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {buckets} AS bucket FROM distinct_runs, crc),
cells AS (SELECT side, row, bucket, count(*) AS n FROM runs JOIN named USING (f) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM cells GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {buckets}) / ((s + 1) * (sum(t) OVER () + {buckets}))))::BIGINT AS g FROM totals),
weighed AS (SELECT row, sum(n * g)::BIGINT AS weight FROM cells JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (SELECT doc_id, len(w) AS n, (greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (row) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= {min_words} ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS nth, count(*) FILTER (n >= {min_words}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= {min_words} AND nth <= {percent} * able // 100 THEN nth END::BIGINT AS rank FROM ranked
"""
