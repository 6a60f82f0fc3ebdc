"""Exact quantiles of whole columns without a task that holds all of their values.

A double becomes a 64-bit key in the same order, read from the front in digits of
16 bits. A pass counts the next digit of the values whose digits so far are those
of some wanted rank, so the ranks of all columns are known to 16 more bits after
each: four passes give the values themselves. A task holds counts of digits,
never values, and the driver gets a row for each wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import ship

DIGIT, PASSES = 16, 4


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """uint64 keys in the order of the doubles; -0 counts as 0."""
    bits = (x + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign != 0, ~bits, bits | sign)


def key_values(keys: np.ndarray) -> np.ndarray:
    sign = np.uint64(1 << 63)
    return np.where(keys & sign != 0, keys & ~sign, ~keys).astype(np.uint64).view(np.float64)


def _digit_counts(rows: DataFrame, names: Sequence[str], prefixes: Mapping[int, np.ndarray], level: int) -> DataFrame:
    """c (place of the column), prefix (place among the column's prefixes), digit, n of the values behind a wanted prefix."""
    ship(rows.sparkSession)
    shift = np.uint64(64 - DIGIT * (level + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {c: np.zeros(len(p) << DIGIT, np.int64) for c, p in prefixes.items() if len(p) <= 4}
        rare: dict[int, list[np.ndarray]] = {c: [] for c in prefixes if c not in seen}

        def out() -> Iterator[pa.RecordBatch]:
            for c in prefixes:
                if c in seen:
                    at = np.flatnonzero(seen[c])
                    n = seen[c][at]
                else:
                    at, n = np.unique(np.concatenate([*rare[c], np.zeros(0, np.int64)]), return_counts=True)
                    rare[c] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(at >> DIGIT, pa.int32()), pa.array(at & ((1 << DIGIT) - 1), pa.int32()), pa.array(n, pa.int64())], names=["c", "prefix", "digit", "n"])

        held = 0
        for batch in batches:
            for c, wanted in prefixes.items():
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                keys = ordered_keys(x[~np.isnan(x)]) >> shift
                before = keys >> np.uint64(DIGIT) if level else np.zeros(len(keys), np.uint64)
                at = np.minimum(np.searchsorted(wanted, before), len(wanted) - 1)
                own = wanted[at] == before
                slot = (at[own] << DIGIT) | (keys[own] & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                if c in seen:
                    seen[c] += np.bincount(slot, minlength=len(seen[c]))
                else:
                    rare[c].append(slot)
                    held += len(slot)
            if held > 1 << 22:
                yield from out()
                held = 0
                for s in seen.values():
                    s[:] = 0
        yield from out()

    own = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    return own.mapInArrow(run, "c int, prefix int, digit int, n bigint").groupBy("c", "prefix", "digit").agg(F.sum("n").alias("n"))


def order_statistics(rows: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, list[float]]:
    """The values at the given ranks (from 0) of each column; nulls and NaN don't count."""
    spark, names = rows.sparkSession, list(ranks)
    wanted = {(c, r): (0, r) for c, name in enumerate(names) for r in set(ranks[name])}  # (column, rank): (prefix, rank behind it)
    for level in range(PASSES if wanted else 0):
        prefixes = {c: np.array(sorted({p for (k, _), (p, _) in wanted.items() if k == c}), np.uint64) for c in {c for c, _ in wanted}}
        counts = _digit_counts(rows, names, prefixes, level)
        cum = counts.withColumn("upto", F.sum("n").over(W.partitionBy("c", "prefix").orderBy("digit")))
        asked = spark.createDataFrame([(c, int(np.searchsorted(prefixes[c], np.uint64(p))), r, rest) for (c, r), (p, rest) in wanted.items()], "c int, prefix int, rank bigint, rest bigint")
        found = cum.join(F.broadcast(asked), ["c", "prefix"]).filter((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
        for f in found.select("c", "prefix", "rank", "digit", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")).collect():  # a row a wanted rank
            wanted[f.c, f.rank] = (int(prefixes[f.c][f.prefix]) << DIGIT | f.digit, f.rest)
    value = {k: float(key_values(np.array([p], np.uint64))[0]) for k, (p, _) in wanted.items()}
    return {name: [value[c, r] for r in ranks[name]] for c, name in enumerate(names)}


def exact_quantiles(rows: DataFrame, probabilities: Mapping[str, Sequence[float]], discrete: bool = False) -> dict[str, list[float]]:
    """Quantiles of each column, interpolated between neighbours, or (discrete) the least value with that share of the rows at or below it.

    A column without values has an empty list.
    """
    counted = rows.agg(*[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1)).alias(f"n{i}") for i, c in enumerate(probabilities)]).first()
    n = {c: counted[i] for i, c in enumerate(probabilities)}
    if discrete:
        return order_statistics(rows, {c: [max(math.ceil(p * n[c]), 1) - 1 for p in ps] for c, ps in probabilities.items() if n[c]}) | {c: [] for c in probabilities if not n[c]}
    places = {c: [(n[c] - 1) * p for p in ps] for c, ps in probabilities.items() if n[c]}
    value = order_statistics(rows, {c: [r for x in xs for r in (math.floor(x), math.ceil(x))] for c, xs in places.items()})
    between = lambda x, low, high: low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high
    return {c: [between(x, *value[c][2 * i : 2 * i + 2]) for i, x in enumerate(places.get(c, []))] for c in probabilities}


def grouped_rank(rows: DataFrame, keys: Sequence[str], value: str, rank: Sequence | object, out: str) -> DataFrame:
    """keys, n, out: the value at a rank (a Column of n, from 0) of each group, by counts of distinct values instead of a list of all."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c_"))
    w = W.partitionBy(*keys)
    placed = counts.withColumns({"n": F.sum("c_").over(w), "upto_": F.sum("c_").over(w.orderBy(value))})
    return placed.filter((rank < F.col("upto_")) & (rank >= F.col("upto_") - F.col("c_"))).select(*keys, "n", F.col(value).alias(out))
