"""Removal of every byte that a repeated 200-byte string covers.

No suffix array is built: sorting one record a byte writes over ten times the
input (see README). Whether a 200-byte string starts anywhere else is decided by
naming strings and counting the names, for few of them one by one:

1. Of every 200-byte string, the k-gram with the least hash is its anchor.
   Equal strings have equal anchors at equal places. The strings with one and
   the same anchor are a run of neighbouring starts (1 position in 60 is an
   anchor).
2. The anchors, and the runs (all bytes that the strings of a run cover), are
   named, and names are counted over the corpus. An anchor met once ends the
   matter for its run: none of it repeats. A run met twice ends it too: all of
   it repeats.
3. Only where the anchor repeats and the run is not the only one around it are
   the 200-byte strings themselves named and counted.

What decides that bytes go, the names of runs and strings, has 96 bits of two
independent hashes; anchors, which only decide what is looked at, have 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import counting, kernels

LENGTH = 200
ANCHOR = 50


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> dict[str, np.ndarray]:
    """Runs of string starts with one anchor: row, low, n (starts), anchor (name), run and check (name), sums and other (running hashes)."""
    size = len(data)
    none = np.zeros(0, np.int64)
    sums, other = kernels.prefix_hash(data), kernels.prefix_hash(data, second=True)
    nothing = {"row": none, "low": none, "n": none, "anchor": none.view(np.uint64), "run": none.view(np.uint64), "check": none.view(np.uint64), "sums": sums, "other": other}
    if size < length:
        return nothing
    at = np.arange(size - k + 1)
    h = kernels.spans(sums, at, at + k)
    mask = np.uint64((1 << int(size).bit_length()) - 1)
    least = (h & ~mask) | at.astype(np.uint64)  # of equal hashes the leftmost
    wide, reach = length - k + 1, 1
    while reach * 2 <= wide:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if rest := wide - reach:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & mask).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(offsets, start, "right") - 1
    whole = start + length <= offsets[row + 1]
    start, anchor, row = start[whole], anchor[whole], row[whole]
    if not len(start):
        return nothing
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    low, n = start[new], np.diff(np.append(new, len(start)))
    run = kernels.mix(kernels.spans(sums, low, low + n - 1 + length) + (anchor[new] - low).astype(np.uint64))
    check = kernels.spans(other, low, low + n - 1 + length, second=True) >> np.uint64(32)
    return {"row": row[new], "low": low, "n": n, "anchor": h[anchor[new]], "run": run, "check": check, "sums": sums, "other": other}


def _starts(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[i], ..., low[i] + n[i] - 1 for all i, in one array."""
    return np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _parts(table: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    return list(kernels.slices(table.column("text"), 1 << 19))


def _collect(table: pa.Table, length: int, k: int) -> list[dict[str, np.ndarray]]:
    return [runs_of(data, offsets, length, k) for _, _, data, offsets in _parts(table)]


def _named(found: list[dict[str, np.ndarray]]) -> tuple[tuple, tuple]:
    """Anchors and runs of a chunk as tally() gives them."""
    return counting.tally([f["anchor"] for f in found]), counting.tally([f["run"] for f in found], [f["check"] for f in found])


def _open(found: list[dict[str, np.ndarray]], totals: counting.Totals) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each run of each slice: whether it repeats as a whole, and whether its strings are to be compared one by one."""
    (_, anchors), (_, runs) = _named(found)
    return [(totals["run"][r] > 1, totals["anchor"][a] > totals["run"][r]) for a, r in zip(anchors, runs, strict=True)]


def _strings(f: dict[str, np.ndarray], todo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and name (two hashes) of the strings of some runs."""
    at = _starts(f["low"][todo], f["n"][todo])
    return at, kernels.spans(f["sums"], at, at + length), kernels.spans(f["other"], at, at + length, second=True) >> np.uint64(32)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """doc_id (a bigint), n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and end bytes).

    Texts are UTF-8 bytes; null counts as empty. A text shorter than length
    has nothing to remove. Repeated rows are documents of their own, so all of
    a repeated text of length bytes or more goes. Other columns are ignored.
    """
    ship(docs.sparkSession)
    size = counting.text_bytes(docs)
    chunks = counting.chunked(docs, size)

    def names(table: pa.Table, _: counting.Totals) -> counting.Keys:
        (anchors, _), (runs, _) = _named(_collect(table, length, k))
        return {"anchor": anchors, "run": runs}

    def strings(table: pa.Table, totals: counting.Totals) -> counting.Keys:
        found = _collect(table, length, k)
        parts = [_strings(f, todo, length) for f, (_, todo) in zip(found, _open(found, totals), strict=True)]
        return {"string": counting.tally([h for _, h, _ in parts], [v for _, _, v in parts])[0]}

    def cover(table: pa.Table, totals: counting.Totals) -> pa.Table:
        found = _collect(table, length, k)
        opened = _open(found, totals)
        parts = [_strings(f, todo, length) for f, (_, todo) in zip(found, opened, strict=True)]
        _, places = counting.tally([h for _, h, _ in parts], [v for _, _, v in parts])
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        for (first, end, data, offsets), f, (whole, _), (at, _, _), place in zip(_parts(table), found, opened, parts, places, strict=True):
            twice = at[totals["string"][place] > 1]
            begins = np.concatenate((f["low"][whole], twice))
            ends = np.concatenate(((f["low"] + f["n"] - 1)[whole], twice)) + length
            depth = np.cumsum(np.bincount(begins, minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1))[: len(data)]
            gone = depth > 0
            for r in range(end - first):
                a, b = int(offsets[r]), int(offsets[r + 1])
                mine = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
                out["n_bytes"].append(b - a)
                out["n_removed"].append(int(mine.sum()))
                out["n_spans"].append(len(edges) // 2)
                out["kept_sha256"].append(hashlib.sha256(data[a:b][~mine].tobytes()).hexdigest())
                out["spans"].append(edges.tolist())
        return pa.table({"doc_id": table.column("doc_id"), **out}, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))]))

    named = counting.ask(chunks, names, ["anchor", "run"], size)
    compared = counting.ask(chunks, strings, ["string"], size, named, ("anchor", "run"))
    answers = named.unionByName(compared, allowMissingColumns=True)
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"
    return counting.tell(chunks, answers, ["anchor", "run", "string"], cover, ddl)
