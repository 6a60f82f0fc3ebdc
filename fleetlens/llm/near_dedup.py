"""MinHash near-dedup by improved consistent weighted sampling (ICWS).

A text is the weighted set of its five-word shingles, weight = tf * idf. idf is
log2((N + 1) / df), where df, the number of texts that hold the shingle, is
counted exactly for every shingle of the corpus (see counting: shingles travel
once a chunk of texts, in blocks, and the counts come back to the chunk). A
text's counts stay with its signature, so that whatever weighs its shingles
later needs no further count. most_idf cuts the idf off; at 1, the default of
near_duplicates, a shingle in at most half of the texts weighs its tf and one in
more weighs less. The queries cut nothing off.

Every shingle falls into one of BINS bins and gets its ICWS draw there, so a
signature costs one draw a shingle; empty bins borrow from the nearest full
one. Signatures are banded; texts that share a band are candidates, verified by
exact weighted Jaccard similarity, and links are closed to classes. In large
buckets this is done in two steps: leaders first, then every pair of the bucket
that the links so far leave in different classes is verified, in blocks (see
open_links). So the classes are those of all similar pairs that share a band.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from . import counting, kernels
from .components import connected_components
from .lm_score import hash_mask
from .storage import cut

BINS, BAND = 64, 4
THRESHOLD = 0.8
#: Buckets of up to so many texts are compared pair by pair, larger ones by leaders.
SMALL_BUCKET = 8
#: Texts that are compared at once for shingles that most of them hold.
PEERS = 32
#: Cells by which texts that are in no pair are kept out of shuffles (the most rows of that broadcast).
CELLS = 1 << 20
#: Bytes of text that a worker shingles at once.
SLICE_BYTES = 1 << 19
#: Pairs of texts that are verified at once.
PAIRS = 32
#: Bytes of text that a block of a large bucket holds.
BLOCK_BYTES = 4 << 20


def _peers(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Row, hash (distinct) and number of rows for runs of at least PEERS rows, or all."""
    runs, rows, hashes, held = list(kernels.slices(texts, SLICE_BYTES)), [], [], 0
    for i, (at, end, data, offsets) in enumerate(runs):
        r, h, _ = kernels.counted(*kernels.shingles(data, offsets))
        rows.append(r + held)
        hashes.append(h)
        held += end - at
        if held >= PEERS or i == len(runs) - 1:
            yield np.concatenate(rows), np.concatenate(hashes), held
            rows, hashes, held = [], [], 0


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles in over half of all texts, and their idf.

    Such a shingle is in over half of the texts of some run, so every run of
    texts names its own, and those named are then counted over all texts.
    near_duplicates counts every shingle instead.
    """
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, n in _peers(batch.column("text")):
                h, times = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[times * 2 > n].view(np.int64))], ["h"])

    candidates = cut(docs.select("text").mapInArrow(named, "h bigint").distinct())
    n_candidates, n = candidates.count(), docs.count()
    found: list[tuple[int, int]] = []
    parts = -(-n_candidates // (1 << 18))
    for part in range(parts):
        wanted = np.sort(np.array([r.h for r in candidates.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) == part).collect()], np.int64).view(np.uint64))
        if not len(wanted):
            continue

        def tally(batches: Iterator[pa.RecordBatch], wanted: np.ndarray = wanted) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for _, _, data, offsets in kernels.slices(batch.column("text"), SLICE_BYTES):
                    _, h, _ = kernels.counted(*kernels.shingles(data, offsets))
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    total += np.bincount(at[wanted[at] == h], minlength=len(wanted))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["h", "df"])

        counts = docs.select("text").mapInArrow(tally, "h bigint, df bigint").groupBy("h").agg(F.sum("df").alias("df"))
        found += [(r.h, r.df) for r in counts.filter(F.col("df") * 2 > n).collect()]
    found.sort(key=lambda x: x[0] & (2**64 - 1))
    h = np.array([x for x, _ in found], np.int64).view(np.uint64)
    return h, np.maximum(np.log2((n + 1) / np.array([x for _, x in found], float)), 1e-3)


@dataclass(frozen=True)
class Idf:
    """log2((n + 1) / df) of shingles in df of n texts, most at most."""

    n: int
    most: float = math.inf

    def __call__(self, df: np.ndarray) -> np.ndarray:
        return np.clip(np.log2((self.n + 1) / df), 1e-3, self.most)


def _held(dfs: list[bytes]) -> np.ndarray:
    """The counts of texts' shingles, one text behind the other."""
    return np.concatenate([np.zeros(0, np.uint64), *(counting.unplanes(b, 5) for b in dfs)]).astype(float)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    return ((kernels.mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(float) + 0.5) / 2**53


def icws(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and the identity (hash, t) of the consistent sample of each weighted element: r, c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    r = -np.log(_uniform(h, 1) * _uniform(h, 2))
    c = -np.log(_uniform(h, 3) * _uniform(h, 4))
    beta = _uniform(h, 5)
    t = np.floor(np.log(w) / r + beta)
    return np.log(c) - r * (t - beta) - r, kernels.mix(h ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def signatures(rows: int, row: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """BINS values a text, as uint64, from the row, hash and weight of the distinct shingles; a text without words has zeros."""
    out = np.zeros(rows * BINS, np.uint64)
    if not len(h):
        return out.reshape(rows, BINS)
    ln_a, name = icws(h, w)
    cell = row * BINS + (kernels.mix(h + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)
    order = np.lexsort((name, ln_a, cell))
    cell, name = cell[order], name[order]
    first = np.concatenate(([True], cell[1:] != cell[:-1]))
    out[cell[first]] = name[first]
    out = out.reshape(rows, BINS)
    full = out != 0
    at = np.arange(BINS)
    left = np.maximum.accumulate(np.where(np.tile(full, 2), np.arange(2 * BINS), -1), axis=1)[:, BINS:] % BINS
    right = np.minimum.accumulate(np.where(np.tile(full, 2), np.arange(2 * BINS), 4 * BINS)[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
    coin = (kernels.mix(at.astype(np.uint64) + np.uint64(991)) & np.uint64(1)).astype(bool)
    source = np.where(full, at, np.where(coin, left, right))
    return np.where(full.any(1)[:, None], np.take_along_axis(out, source, 1), np.uint64(0))


def text_key() -> Column:
    """64-bit hash of the text (null: empty); equal texts are one node of the graph of links."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _packed(docs: DataFrame) -> DataFrame:
    """chunk, packed: runs of rows (doc_id, key, text) of up to CHUNK_BYTES of text, compressed and named by their content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, _, _ in kernels.slices(batch.column("text"), counting.CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(at, end - at))
                packed = sink.getvalue().to_pybytes()
                name = int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([packed], pa.binary())], ["chunk", "packed"])

    rows = docs.select("doc_id", text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "chunk bigint, packed binary")


def _unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("packed").to_pylist()])


def _shingled(texts: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and end row of a slice; row (in the slice), hash and tf of its texts' distinct shingles."""
    for at, end, data, offsets in kernels.slices(texts, SLICE_BYTES):
        yield at, end, *kernels.counted(*kernels.shingles(data, offsets))


def signature_rows(docs: DataFrame, size: int, idf: Idf) -> DataFrame:
    """doc_id, key (hash of the text), bands array<long> (empty for a text without words), dfs (in how many texts each of its shingles is, by order of hash).

    size: bytes of all texts. Hashes are first asked for by so few leading bits
    that one in 32 meets another by chance; a shingle that meets none is in one
    text, and only the others are asked for by all their bits.
    """
    mask = hash_mask(size)
    short = mask & np.uint64((1 << 64) - (1 << (64 - min(48, max(size, 64).bit_length() + 3))))
    chunks = _packed(docs)

    def often(hashes: np.ndarray, totals: counting.Totals) -> np.ndarray:
        """Whether each hash is asked for by all its bits."""
        _, where = np.unique(hashes & short, return_inverse=True)
        return totals["short"][where] > 1 if len(where) else np.zeros(0, bool)

    def held(table: pa.Table) -> np.ndarray:
        return np.concatenate([h for *_, h, _ in _shingled(_unpacked(table).column("text"))])

    def first(table: pa.Table, _: counting.Totals) -> counting.Keys:
        return {"short": counting.tally([held(table) & short])[0]}

    def then(table: pa.Table, totals: counting.Totals) -> counting.Keys:
        hashes = held(table)
        return {"df": counting.tally([hashes[often(hashes, totals)] & mask])[0]}

    def result(table: pa.Table, totals: counting.Totals) -> pa.Table:
        table = _unpacked(table)
        slices = list(_shingled(table.column("text")))
        hashes = np.concatenate([h for *_, h, _ in slices])
        asked = often(hashes, totals)
        counts = np.ones(len(hashes), np.int64)
        _, where = np.unique(hashes[asked] & mask, return_inverse=True)
        if len(where):
            counts[asked] = totals["df"][where]
        bands, sizes, dfs, done = [], [], [], 0
        for at, end, row, h, tf in slices:
            df, done = counts[done : done + len(h)], done + len(h)
            sig = signatures(end - at, row, h, tf * idf(df))
            some = sig.any(1)
            band = np.zeros((end - at, BINS // BAND), np.uint64)
            for j in range(BAND):
                band = kernels.mix(band + sig[:, j::BAND])
            bands.append(band[some].ravel().view(np.int64))
            sizes.append(np.where(some, BINS // BAND, 0))
            dfs += [counting.planes(own, 5) for own in np.split(df, np.searchsorted(row, np.arange(1, end - at)))]
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
        return pa.table({"doc_id": table.column("doc_id"), "key": table.column("key"), "bands": listed, "dfs": pa.array(dfs, pa.binary())})

    answers = counting.ask(chunks, first, ["short"], size)
    answers = answers.unionByName(counting.ask(chunks, then, ["df"], size, answers, ("short",)), allowMissingColumns=True)
    return counting.tell(chunks, answers, ["short", "df"], result, "doc_id bigint, key bigint, bands array<bigint>, dfs binary")


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """Distinct pairs a < b of keys that share a band, from key, bands.

    A small bucket gives all its pairs. A larger one gives each member with its
    first and last member and, of those that share one of the next three bands
    too, with the first: linear in the bucket. The closure of links joins groups
    of copies by them; open_pairs finds the links that they miss.
    """
    n = BINS // BAND
    bands = texts.select("key", F.posexplode("bands").alias("i", "band"))
    buckets = bands.groupBy("i", "band").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).filter("n > 1")
    members = bands.join(buckets, ["i", "band"])
    few = members.filter(F.col("n") <= SMALL_BUCKET).groupBy("i", "band").agg(F.sort_array(F.collect_list("key")).alias("ks"))
    few = few.select(F.explode(F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    many = members.filter(F.col("n") > SMALL_BUCKET)
    ends = many.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("key").alias("b")), F.struct(F.col("key").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.a", "p.b")
    finer = many.select("key", "i", "band").join(texts.select("key", "bands"), "key")
    finer = finer.select("key", "i", "band", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.element_at("bands", (F.col("i") + j) % n + 1).alias("next")) for j in (1, 2, 3)])).alias("s")).select("key", "i", "band", "s.j", "s.next")
    leaders = finer.groupBy("i", "band", "j", "next").agg(F.min("key").alias("a"), F.count("*").alias("n2")).filter("n2 > 1")
    finer = finer.join(leaders, ["i", "band", "j", "next"]).select("a", F.col("key").alias("b"))
    return few.union(ends).union(finer).filter("a < b").distinct()


def among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs (doc_id, text) without most of those whose text is not in keys (key): a wanted key's cell is kept whole."""
    cell = lambda key: F.pmod(F.xxhash64(key), F.lit(CELLS))
    cells = keys.select(cell(F.col("key")).alias("cell_")).distinct()
    return docs.join(F.broadcast(cells), cell(text_key()) == F.col("cell_"), "left_semi")


def _id(column: str) -> Column:
    return F.coalesce(column, F.lit(-(2**63)))


def fetched(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key, id, ...) with the text of each; it is joined on key and id, so that a text with many copies is no hot key."""
    source = among(docs, keys).select(text_key().alias("key"), _id("doc_id").alias("id_"), F.coalesce("text", F.lit("")).alias("text"))
    return keys.withColumn("id_", _id("id")).join(source, ["key", "id_"]).drop("id_")


def open_buckets(texts: DataFrame, of: DataFrame) -> DataFrame:
    """key, id, component, bands, dfs, open (the bands in which the text is in a large bucket of several components)."""
    named = texts.join(of, F.col("key") == F.col("node"), "left").select("key", F.col("first_id").alias("id"), F.coalesce("component", "key").alias("component"), "bands", "dfs")
    bands = named.select("key", "component", F.posexplode("bands").alias("i", "band"))
    mixed = bands.groupBy("i", "band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter((F.col("n") > SMALL_BUCKET) & (F.col("low") < F.col("high")))
    opened = bands.join(mixed.select("i", "band"), ["i", "band"]).groupBy("key").agg(F.collect_list("i").alias("open"))
    return named.join(opened, "key")


def open_links(docs: DataFrame, opened: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """u, v: components that a similar pair of some open bucket links.

    The members of a bucket are dealt to blocks of BLOCK_BYTES by a hash, and
    every two blocks meet in one task, which verifies their pairs of different
    components itself: a text is laid out as weights over the shingles of the
    task, and all others are summed against it. A pair that shares several bands
    is taken in the first of them. Only linked components leave the task.
    """
    held = cut(fetched(docs, opened).distinct().withColumn("n_bytes", F.octet_length("text")))
    member = held.select("key", "component", "bands", "dfs", "text", "n_bytes", F.explode("open").alias("i")).withColumn("band", F.element_at("bands", F.col("i") + 1))
    sizes = held.select("bands", "n_bytes", F.explode("open").alias("i")).groupBy("i", F.element_at("bands", F.col("i") + 1).alias("band")).agg(F.ceil(F.sum("n_bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = member.join(sizes, ["i", "band"]).withColumn("own", F.pmod(F.xxhash64("key"), F.greatest("blocks", F.lit(1))).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("other"))
    dealt = dealt.select("i", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("second"), "component", "bands", "dfs", "text")

    def run(table: pa.Table) -> pa.Table:
        i, p, q = (table.column(c)[0].as_py() for c in ("i", "p", "q"))
        second, component = table.column("second").to_numpy(), table.column("component").to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        row, ids, w, total = laid_out(table.column("text"), table.column("dfs").to_pylist(), idf)
        begin = np.searchsorted(row, np.arange(len(table) + 1))
        weight = np.zeros(int(ids.max()) + 1 if len(ids) else 1)
        left, right = (np.arange(len(table)),) * 2 if p == q else (np.flatnonzero(~second), np.flatnonzero(second))
        found: set[tuple[int, int]] = set()
        for x in left.tolist():
            ys = right[right > x] if p == q else right
            ys = ys[(component[ys] != component[x]) & (np.minimum(total[ys], total[x]) >= (threshold - 1e-9) * np.maximum(total[ys], total[x]))]
            ys = ys[(bands[ys] == bands[x]).argmax(1) == i]
            if not len(ys):
                continue
            own = slice(begin[x], begin[x + 1])
            weight[ids[own]] = w[own]
            size = begin[ys + 1] - begin[ys]
            at = np.repeat(begin[ys] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            low = np.add.reduceat(np.minimum(weight[ids[at]], w[at]), np.concatenate(([0], np.cumsum(size)[:-1])))
            weight[ids[own]] = 0
            linked = ys[low / (total[x] + total[ys] - low) >= threshold]
            found.update((min(component[x], c), max(component[x], c)) for c in component[linked].tolist())
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("i", "band", "p", "q").applyInArrow(run, "u bigint, v bigint").distinct()


def laid_out(texts: pa.ChunkedArray, dfs: list[bytes], idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the shingle (equal ones have equal numbers) and weight of the distinct shingles of all texts, in order of rows, and each text's total."""
    rows, hashes, counts = [], [], []
    for at, _, data, offsets in kernels.slices(texts, SLICE_BYTES):
        r, h, tf = kernels.counted(*kernels.shingles(data, offsets))
        rows.append(r + at)
        hashes.append(h)
        counts.append(tf)
    row, h, tf = (np.concatenate(x) for x in (rows, hashes, counts))
    w = tf * idf(_held(dfs))
    _, ids = np.unique(h, return_inverse=True)
    return row, ids, w, np.bincount(row, w, minlength=len(texts))


def pair_similarity(a: pa.Array, b: pa.Array, a_dfs: pa.Array, b_dfs: pa.Array, idf: Idf) -> np.ndarray:
    """Exact weighted Jaccard similarity of a[i] and b[i]; 0 where neither has a word."""
    both = pa.array([x for pair in zip(a.to_pylist(), b.to_pylist(), strict=True) for x in pair], pa.large_utf8())
    dfs = [x for pair in zip(a_dfs.to_pylist(), b_dfs.to_pylist(), strict=True) for x in pair]
    low, total = np.zeros(len(a)), np.zeros(len(a))
    for at, end, data, offsets in kernels.slices(both, 1 << 40):
        row, h, tf = kernels.counted(*kernels.shingles(data, offsets))
        w = tf * idf(_held(dfs[at:end]))
        pair = (row + at) >> 1
        total += np.bincount(pair, w, minlength=len(a))
        order = np.lexsort((h, pair))
        pair, h, w = pair[order], h[order], w[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
        low += np.bincount(pair[same], np.minimum(w[same], w[same + 1]), minlength=len(a))
    return np.divide(low, total - low, out=np.zeros(len(a)), where=total > low)


def verified_pairs(docs: DataFrame, texts: DataFrame, pairs: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """u, v, similarity of the pairs (a, b) that reach the threshold. A text is fetched from its row with the least doc_id."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", F.col("first_id").alias("id"), "dfs"), "key")
    held = cut(fetched(docs, wanted).select("key", "text", "dfs").distinct())
    for s in ("a", "b"):
        pairs = pairs.join(held.select(F.col("key").alias(s), F.col("text").alias(f"{s}_text"), F.col("dfs").alias(f"{s}_dfs")), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                own = batch.slice(at, PAIRS)
                s = pair_similarity(*(own.column(c) for c in ("a_text", "b_text", "a_dfs", "b_dfs")), idf)
                yield pa.RecordBatch.from_arrays([own.column("a"), own.column("b"), pa.array(s)], ["u", "v", "similarity"])

    return pairs.select("a", "b", "a_text", "b_text", "a_dfs", "b_dfs").mapInArrow(run, "u bigint, v bigint, similarity double").filter(F.col("similarity") >= threshold)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, most_idf: float = 1.0) -> DataFrame:
    """doc_id, text_key, class_id, kept.

    class_id is the least doc_id of the class (null if it has null ids only),
    kept marks the row (of repeated rows: all) with the class's id and, of its
    texts with that id, the one with the least key. doc_id is a bigint. Null text counts as empty; equal texts, empty ones among them, are
    one class. A text with words but fewer than five is one shingle. An empty
    table gives no rows. Other columns are ignored. most_idf cuts the idf off
    (math.inf: nowhere).
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    size, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    idf = Idf(n, most_idf)
    rows = cut(signature_rows(docs, size, idf))
    texts = cut(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("dfs").alias("dfs")))
    of = connected_components(verified_pairs(docs, texts, cut(candidate_pairs(texts)), idf, threshold).select("u", "v"))
    opened = cut(open_buckets(texts, of))
    if not opened.isEmpty():
        joined = connected_components(open_links(docs, opened, idf, threshold)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        of = of.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")).unionByName(joined.select(F.col("component").alias("node"), F.col("joined").alias("component")))
        of = of.distinct()
    keyed = texts.select("key", "first_id").join(of, F.col("key") == F.col("node"), "left").select("key", "first_id", F.coalesce("component", "key").alias("component"))
    classes = keyed.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")).alias("best"))
    named = keyed.join(classes, "component").select(F.col("key").alias("text_key"), F.col("best.first_id").alias("class_id"), (F.col("key") == F.col("best.key")).alias("first"))
    out = rows.select("doc_id", F.col("key").alias("text_key")).join(named, "text_key")
    return out.select("doc_id", "text_key", "class_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, most_idf: float = 1.0) -> DataFrame:
    """docs with one row of each class, all columns kept; of rows with the kept id and text, the one whose JSON text comes first."""
    kept = near_duplicates(docs, threshold, most_idf).filter("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_key().alias("key"))
    joined = packed.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")))
    once = joined.filter("copies = 1").select("row")
    more = joined.filter("copies > 1").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(more).select("row.*")
