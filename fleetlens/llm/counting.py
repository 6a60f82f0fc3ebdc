"""Exact counts of 64-bit keys over a whole corpus, asked for and answered in blocks.

Texts are dealt to chunks of a few MB. A chunk sorts its distinct keys, cuts
them by hash range into one block a partition, and asks; a partition merges the
blocks it gets, sums the counts of each key, and answers every block in its own
order. A key travels once a chunk however often it occurs, so a hot key costs
no more than any other, and blocks are coded as byte planes of differences,
compressed to the bytes that carry information.

A chunk has a row for each partition at most, which is few while there are few
partitions. Beyond FAN of them the way has two legs: chunks ask nodes, each of
which merges the blocks of many chunks in one coarse range and asks the
partitions of that range. So a chunk has about the square root as many rows, and
rows grow as the input to the power of 1.5 instead of 2.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK_BYTES = 2 << 20
PART_BYTES = 16 << 20

#: Partitions that chunks ask directly.
FAN = 4096

Keys = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]  # name: sorted distinct keys, checks, counts
Totals = dict[str, np.ndarray]  # name: a total for each of the chunk's keys


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers below 256**width as byte planes, compressed behind their count."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unplanes(b: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def tally(keys: list[np.ndarray], checks: list[np.ndarray] | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]:
    """(distinct keys in order, their checks, their counts), and the place in them of each key of each array.

    A check is 32 more bits of a key's name: keys with different checks are
    different. Without checks they are all 0.
    """
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    ends = np.cumsum([len(x) for x in keys])[:-1]
    if checks is None:
        distinct, where, n = np.unique(k, return_inverse=True, return_counts=True)
        return (distinct, np.zeros(len(distinct), np.uint64), n), np.split(where, ends) if keys else []
    v = np.concatenate(checks) if checks else np.zeros(0, np.uint64)
    order = np.argsort(k)
    same = k[order][1:] == k[order][:-1]
    other = v[order][1:] != v[order][:-1]
    if (same & other).any():  # equal keys with different checks, which a hash hardly ever gives, have to stand together by check
        order = np.lexsort((v, k))
        same, other = k[order][1:] == k[order][:-1], v[order][1:] != v[order][:-1]
    new = np.concatenate((np.ones(min(len(k), 1), bool), ~same | other))
    first = np.flatnonzero(new)
    where = np.empty(len(k), np.int64)
    where[order] = np.cumsum(new) - 1
    at = order[first]
    return (k[at], v[at], np.diff(np.append(first, len(k)))), np.split(where, ends) if keys else []


def chunked(docs: DataFrame, total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, text, chunk; the same rows always get the same chunk."""
    n = max(1, -(-total_bytes // chunk_bytes))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(n)))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _requests(chunk: int, keys: Keys, names: list[str], parts: int, always: bool = True) -> pa.Table:
    """A row for each partition with keys; with always, partition 0 has one in any case."""
    edges = {}
    for name in names:
        part = ((keys[name][0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges[name] = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    some = np.flatnonzero(np.any([np.diff(edges[n]) > 0 for n in names], axis=0) | ((np.arange(parts) == 0) & always)).tolist()
    columns: dict[str, list] = {"part": some, "chunk": [chunk] * len(some)}
    for name in names:
        k, v, c = keys[name]
        cut = [(edges[name][p], edges[name][p + 1]) for p in some]
        columns[f"k_{name}"] = [planes(np.diff(k[a:b], prepend=np.uint64(0)), 8) for a, b in cut]
        columns[f"v_{name}"] = [planes(v[a:b] if v.any() else v[:0], 4) for a, b in cut]
        columns[f"c_{name}"] = [planes(c[a:b], 5) for a, b in cut]
    return pa.table(columns, _request_schema(names))


def _request_schema(names: list[str]) -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("chunk", pa.int64()), *((f"{x}_{n}", pa.binary()) for n in names for x in "kvc")])


def _answer_schema(names: list[str]) -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("chunk", pa.int64()), *((f"t_{n}", pa.binary()) for n in names)])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'bigint'}" for f in schema)


def _merged(table: pa.Table, name: str) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]:
    """Distinct keys of all blocks with their sums, and the place in them of each block's keys."""
    read = lambda x, width: [unplanes(b, width) for b in table.column(f"{x}_{name}").to_pylist()]
    keys, checks = [np.cumsum(k, dtype=np.uint64) for k in read("k", 8)], read("v", 4)
    checks = [v if len(v) else np.zeros(len(k), np.uint64) for k, v in zip(keys, checks, strict=True)] if any(map(len, checks)) else None
    (k, v, _), where = tally(keys, checks)
    sums = np.bincount(np.concatenate(where), np.concatenate(read("c", 5)), minlength=len(k)) if len(k) else np.zeros(0)
    return (k, v, sums.astype(np.uint64)), where


def _told(table: pa.Table, names: list[str], totals: Callable[[str], tuple[np.ndarray, list[np.ndarray]]]) -> pa.Table:
    """The answer to every block of the table: the totals of its keys."""
    out = {"part": table.column("part"), "chunk": table.column("chunk")}
    for name in names:
        total, where = totals(name)
        out[f"t_{name}"] = pa.array([planes(total[w], 5) for w in where], pa.binary())
    return pa.table(out, _answer_schema(names))


def _answer(table: pa.Table, names: list[str]) -> pa.Table:
    def totals(name: str) -> tuple[np.ndarray, list[np.ndarray]]:
        (_, _, sums), where = _merged(table, name)
        return sums, where

    return _told(table, names, totals)


def _totals(table: pa.Table, names: list[str]) -> Totals:
    order = np.argsort(table.column("part").to_numpy())
    out = {}
    for name in names:
        blobs = table.column(f"t_{name}").to_pylist()
        got = [unplanes(blobs[i], 5) for i in order if blobs[i] is not None]
        out[name] = np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)
    return out


def ask(chunks: DataFrame, keys: Callable[[pa.Table, Totals], Keys], names: list[str], total_bytes: int, before: DataFrame | None = None, before_names: tuple[str, ...] = (), part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """Answers (part, chunk, t_<name>...) for the keys of every chunk; before: answers that keys() gets to see."""
    parts = max(1, -(-total_bytes // part_bytes))
    coarse = parts if parts <= fan else math.isqrt(parts) + 1
    schema, answers = _request_schema(names), _answer_schema(names)
    if before is None:
        def first(table: pa.Table) -> pa.Table:
            return _requests(table.column("chunk")[0].as_py(), keys(table, {}), names, coarse)

        asked = chunks.groupBy("chunk").applyInArrow(first, _ddl(schema))
    else:
        def later(table: pa.Table, seen: pa.Table) -> pa.Table:
            return _requests(seen.column("chunk")[0].as_py(), keys(table, _totals(seen, list(before_names))), names, coarse)

        asked = chunks.groupBy("chunk").cogroup(before.groupBy("chunk")).applyInArrow(later, _ddl(schema))
    if coarse == parts:
        return asked.groupBy("part").applyInArrow(lambda t: _answer(t, names), _ddl(answers))
    # two legs: node = (group of about coarse chunks, coarse range); its partitions are the coarse range's share of coarse * coarse
    nodes = asked.withColumn("node", F.floor(F.col("chunk") / coarse).cast("bigint") * coarse + F.col("part"))

    def on(table: pa.Table) -> pa.Table:
        return _requests(table.column("node")[0].as_py(), {n: _merged(table, n)[0] for n in names}, names, coarse * coarse, False)

    def back(table: pa.Table, seen: pa.Table) -> pa.Table:
        total = _totals(seen, names) if len(seen) else {n: np.zeros(0, np.int64) for n in names}
        return _told(table, names, lambda n: (total[n], _merged(table, n)[1]))

    sums = nodes.groupBy("node").applyInArrow(on, _ddl(schema)).groupBy("part").applyInArrow(lambda t: _answer(t, names), _ddl(answers))
    return nodes.groupBy("node").cogroup(sums.groupBy("chunk")).applyInArrow(back, _ddl(answers))


def tell(chunks: DataFrame, answers: DataFrame, names: list[str], result: Callable[[pa.Table, Totals], pa.Table], ddl: str) -> DataFrame:
    """result(texts of a chunk, totals of its keys) for every chunk."""
    def run(table: pa.Table, seen: pa.Table) -> pa.Table:
        return result(table, _totals(seen, names))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ddl)
