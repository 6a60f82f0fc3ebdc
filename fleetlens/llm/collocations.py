"""Phrase collocation mining by counted id n-grams.

1. Texts become blocks of a million words: a local dictionary with counts, and
   the words as numbers of it, 0 where a piece ends. Blocks are written once.
2. The dictionary of frequent words is summed from the blocks' own counts, and
   its entries are numbered. Blocks learn the numbers of their words by a join
   of distinct words, so the dictionary is never broadcast.
3. Words that aren't frequent break pieces (no phrase with one can be a
   candidate). What is left gives runs of 2 and 3 ids, packed into one key of
   3 * bits bits; a block sorts and counts its own keys before anything is sent.
4. Keys are dealt to ranges, whose bounds are quantiles of evenly spaced keys of
   all blocks, radix-sorted and run-length counted. A hot key comes once a block.
5. Frequent n-grams are a table like any other: parts, scores, the phrases
   inside longer ones and ranks are joins and windows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ship, stored
from .counting import planes, unplanes
from .storage import checkpoint_dir, numbered

LEAST, TOP, INSIDE_PERCENT = 10, 2000, 50
TOKEN = re.compile(rb"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+")
GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
BREAKS = b".,;:!?\n\x0b\x0c\r"

#: Bytes of text that are cut into words at once, words of a block, words that a task holds for all languages, keys of a range, and keys a sampled one stands for.
WINDOW_BYTES, BLOCK_WORDS, HELD_WORDS, RANGE_KEYS, STRIDE = 1 << 20, 1 << 20, 1 << 21, 1 << 19, 512


class Vocabulary(dict):
    """Word to its number in the block, from 1 in order of appearance; what ends a piece is 0."""

    def __init__(self) -> None:
        super().__init__({bytes([b]): 0 for b in BREAKS})
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = len(self.words)
        return len(self.words)


class Block:
    """Words of one language on their way into a row."""

    def __init__(self) -> None:
        self.known, self.parts, self.n = Vocabulary(), [], 0

    def add(self, text: bytes) -> None:
        """A whole text, a window at a time; windows end beside words, and a piece may go on over them."""
        at = 0
        while at < len(text):
            gap = GAP.search(text, at + WINDOW_BYTES) if len(text) - at > 2 * WINDOW_BYTES else None
            end = gap.end() if gap else len(text)
            found = np.fromiter(map(self.known.__getitem__, TOKEN.findall(text[at:end].lower())), np.uint32)
            self.parts.append(found)
            self.n += len(found)
            at = end
        self.parts.append(np.zeros(1, np.uint32))

    def row(self, lang: str, block: int) -> dict:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.known.words) + 1)[1:]
        return {"block": block, "lang": lang, "n": int(counts.sum()), "words": [w.decode() for w in self.known.words], "counts": counts, "ids": planes(ids, 4)}


BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])


def word_blocks(docs: DataFrame) -> DataFrame:
    """block, lang (null: und), n (words), words, counts, ids: the texts of docs as words of a local dictionary."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Block] = {}
        block = TaskContext.get().partitionId() << 32

        def closed(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal block
            for lang in langs:
                yield pa.RecordBatch.from_pylist([open_.pop(lang).row(lang, block)], BLOCKS)
                block += 1

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                own = open_.setdefault(lang, Block())
                own.add(text.as_py())
                if own.n >= BLOCK_WORDS:
                    yield from closed([lang])
                if sum(b.n for b in open_.values()) >= HELD_WORDS:
                    yield from closed(sorted(open_))
        yield from closed(sorted(open_))

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "block bigint, lang string, n bigint, words array<string>, counts array<bigint>, ids binary")


def dictionary(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, f, id: words with at least `least` occurrences in their language, numbered from 1 over all languages."""
    own = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    frequent = own.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return numbered(frequent, [F.col("lang").asc(), F.col("word").asc()]).withColumnRenamed("position", "id")


def pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three ids as a key of 3 * bits bits: one word up to 63 bits, else two, the first id by itself."""
    a, low = a.astype(np.uint64), (b.astype(np.uint64) << np.uint64(bits)) | c.astype(np.uint64)
    return [(a << np.uint64(2 * bits)) | low] if 3 * bits <= 63 else [a, low]


def unpack(key: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask, low = np.uint64((1 << bits) - 1), key[-1]
    first = key[0] >> np.uint64(2 * bits) if len(key) == 1 else key[0]
    return tuple(x.astype(np.int64) for x in (first, (low >> np.uint64(bits)) & mask, low & mask))


def leading(key: list[np.ndarray], bits: int) -> np.ndarray:
    """The first 63 bits of keys at most, in their order."""
    if len(key) == 1:
        return key[0].astype(np.int64)
    return ((key[0] << np.uint64(63 - bits)) | (key[1] >> np.uint64(3 * bits - 63))).astype(np.int64)


def radix_order(key: list[np.ndarray], bits: int) -> np.ndarray:
    """The stable order of keys by digits of 16 bits, the last digit first."""
    order = np.arange(len(key[0]))
    for word, width in reversed(list(zip(key, [3 * bits] if len(key) == 1 else [bits, 2 * bits], strict=True))):
        for shift in range(0, width, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]  # for 16 bits this is numpy's radix sort
    return order


def run_lengths(key: list[np.ndarray], counts: np.ndarray | None, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, and the sum of their counts (1 each without counts)."""
    order = radix_order(key, bits)
    key = [k[order] for k in key]
    if not len(order):
        return key, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0))))
    sums = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    return [k[first] for k in key], sums


def _written(key: list[np.ndarray], counts: np.ndarray) -> dict[str, bytes]:
    """Keys in order, as differences, and counts as compressed byte planes."""
    return {"head": planes(np.diff(key[0], prepend=np.uint64(0)), 8), "tail": planes(key[1], 8) if len(key) > 1 else b"", "counts": planes(counts, 5)}


def _read(row: dict) -> tuple[list[np.ndarray], np.ndarray]:
    head = np.cumsum(unplanes(row["head"], 8), dtype=np.uint64)
    return [head, unplanes(row["tail"], 8)] if row["tail"] else [head], unplanes(row["counts"], 5).astype(np.int64)


def block_grams(blocks: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """head, tail, counts, size, sample: each block's distinct runs of 2 and 3 frequent words with counts, and every STRIDE-th key's leading bits."""
    ship(blocks.sparkSession)
    own = blocks.select("block", "lang", F.posexplode("words").alias("pos", "word"))
    numbers = own.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list("id").alias("id"))
    ready = blocks.select("block", "ids", F.size("words").alias("size")).join(numbers, "block").select("ids", "size", "pos", "id")
    schema = pa.schema([("head", pa.binary()), ("tail", pa.binary()), ("counts", pa.binary()), ("size", pa.int64()), ("sample", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names = np.zeros(batch.column("size")[i].as_py() + 1, np.uint64)  # 0: a break, or a word that isn't frequent
                names[batch.column("pos")[i].values.to_numpy() + 1] = batch.column("id")[i].values.to_numpy()
                t = names[unplanes(batch.column("ids")[i].as_py(), 4).astype(np.int64)]
                two = (t[:-1] > 0) & (t[1:] > 0)
                three = two[:-1] & two[1:]
                at2, at3 = np.flatnonzero(two), np.flatnonzero(three)
                pairs, triples = pack(t[at2], t[at2 + 1], np.zeros(len(at2), np.uint64), bits), pack(t[at3], t[at3 + 1], t[at3 + 2], bits)
                key, counts = run_lengths([np.concatenate(x) for x in zip(pairs, triples, strict=True)], None, bits)
                if len(counts):
                    yield pa.RecordBatch.from_pylist([_written(key, counts) | {"size": len(counts), "sample": leading(key, bits)[::STRIDE].tolist()}], schema)

    return ready.mapInArrow(run, "head binary, tail binary, counts binary, size bigint, sample array<bigint>")


def frequent_grams(grams: DataFrame, bits: int, least: int = LEAST, range_keys: int = RANGE_KEYS) -> DataFrame:
    """id1, id2, id3 (0: a pair), a of the n-grams that occur at least `least` times, from the blocks' counts (a stored table)."""
    ship(grams.sparkSession)
    parts = max(1, -(-(grams.agg(F.sum("size")).first()[0] or 0) // range_keys))
    bounds = np.zeros(0, np.int64)
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        found = grams.select(F.explode("sample").alias("s")).agg(F.percentile_approx("s", at, max(10_000, 8 * parts)).alias("b")).first()["b"]
        bounds = np.unique(np.array(found, np.int64))  # a number a range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                key, counts = _read(row)
                part = np.searchsorted(bounds, leading(key, bits), "right")
                edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_pylist([{"part": int(part[x])} | _written([k[x:y] for k in key], counts[x:y]) for x, y in cuts], schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks' keys are merged as they come, so a task holds its distinct keys, however many blocks have them."""
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = merged = 0

        def merge() -> None:
            nonlocal held, size, merged
            if len(held) > 1:
                held = [run_lengths([np.concatenate(x) for x in zip(*(k for k, _ in held), strict=True)], np.concatenate([c for _, c in held]), bits)]
            size = merged = len(held[0][1]) if held else 0

        for batch in batches:
            for row in batch.to_pylist():
                held.append(_read(row))
                size += len(held[-1][1])
                if size > merged + range_keys:
                    merge()
        merge()
        for key, counts in held:
            often = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*unpack([k[often] for k in key], bits), counts[often])], names=["id1", "id2", "id3", "a"])

    dealt = grams.select("head", "tail", "counts").mapInArrow(deal, "part bigint, head binary, tail binary, counts binary")
    return dealt.repartition(max(1, len(bounds) + 1), "part").mapInArrow(count, "id1 bigint, id2 bigint, id3 bigint, a bigint")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) without loss: products have up to 38 digits."""
    return F.expr(f"(cast(1000000 as decimal(38,0)) * cast({a} as decimal(38,0)) * cast({a} as decimal(38,0))) div (cast({left} as decimal(38,0)) * cast({right} as decimal(38,0)))")


def scored_phrases(found: DataFrame, words: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of candidates (found: frequent_grams) that no longer candidate mostly stands for."""
    pairs = found.filter("id3 = 0").select("id1", "id2", "a")
    triples = found.filter("id3 > 0")
    word = lambda k: words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))
    pair = lambda x, y, name: pairs.select(F.col("id1").alias(x), F.col("id2").alias(y), F.col("a").alias(name))
    around = triples.select("id1", "id2", "a").unionByName(triples.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a"))
    longest = around.groupBy("id1", "id2").agg(F.max("a").alias("longer"))
    alone = pairs.join(longest, ["id1", "id2"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent))
    twos = alone.join(word(1), "id1").join(word(2), "id2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    cut = triples.join(pair("id1", "id2", "front"), ["id1", "id2"]).join(pair("id2", "id3", "back"), ["id2", "id3"]).join(word(1), "id1").join(word(2), "id2").join(word(3), "id3")
    cut = cut.withColumns({"s1": _score("a", "f1", "back"), "s2": _score("a", "front", "f3")})
    pick = lambda first, second: F.when(F.col("s1") <= F.col("s2"), F.col(first)).otherwise(F.col(second))
    threes = cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("f1", "front").alias("l"), pick("back", "f3").alias("r"), pick("s1", "s2").alias("score"))
    return twos.unionByName(threes)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT, bits: int | None = None, range_keys: int = RANGE_KEYS, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 or 3 words.

    docs: rows with text and lang; no other column is read. A null lang is
    "und", a null text is empty; repeated rows count each time. Rows without
    words give nothing, nor does an empty table. Ties in score and a go by the
    phrase's UTF-8 bytes, so a run gives the same ranks always. bits: bits of an
    id, as many as the dictionary needs unless given. A language may hold most
    phrases: the first `top` are found within salts, then among those.
    """
    where = lambda: f"{checkpoint_dir(docs.sparkSession)}/{uuid.uuid4().hex}"
    blocks = stored(word_blocks(docs), where())
    words = stored(dictionary(blocks, least), where())
    if bits is None:
        bits = max(1, int(words.agg(F.max("id")).first()[0] or 1).bit_length())
    found = stored(frequent_grams(stored(block_grams(blocks, words, bits), where()), bits, least, range_keys), where())
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = scored_phrases(found, words, inside_percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    nth = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")
    first = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", nth("lang", "salt")).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", nth("lang")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM
  (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM {docs})),
runs AS (SELECT lang, w[i : i + k] AS g FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (SELECT unnest([0, 1, 2]) AS k) WHERE i + k <= len(w)),
f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
parts AS (SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a::HUGEINT * c.a::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : len(c.g)]),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_pairs AS (SELECT lang, h, max(a) AS longer FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS h, a FROM f WHERE len(g) = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN inner_pairs i ON i.lang = c.lang AND i.h = c.g WHERE i.longer IS NULL OR 100 * i.longer < {inside} * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
