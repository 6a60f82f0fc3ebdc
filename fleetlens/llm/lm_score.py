"""Stupid-backoff language-model scores of every document.

Tables of n-gram counts, n = 1 to 3, are partitioned by the n-gram's hash; the
n-grams of each document are joined to them and their scores summed. Counts
leave the scored document out, so that a text is not predicted from itself:

    S(w | u v) = c(u v w) / c(u v)     if c(u v w) > 0
               = 0.4 S(w | v)          otherwise, and so on down to
    S(w)       = max(c(w), 0.5) / N

The tables travel in blocks (see counting), each n-gram once a chunk of texts.
An n-gram can only be met in another text if both of its (n-1)-grams can, so
the tables are built from short to long and n-grams with a part that occurs
once are not asked for. Their counts elsewhere are 0, which is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import counting, kernels

BACKOFF = 0.4
NAMES = ["n1", "n2", "n3", "all"]
CHUNK_BYTES = 4 << 20


def hash_mask(total_bytes: int) -> np.uint64:
    """Leading bits of n-gram hashes that are kept, whole bytes of them.

    Up to about 16 GB of text so many that hardly any two n-grams of the corpus
    share them; beyond, 64: then n / 2**64 of n distinct n-grams share theirs
    with another one (1e-7 of them at n = 1e12), whose counts add up.
    """
    bits = min(64, max(48, 8 * math.ceil((2 * math.log2(max(total_bytes, 2)) - 4) / 8)))
    return np.uint64((1 << 64) - (1 << (64 - bits)))


def _ngrams(table: pa.Table, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row and place of each word in a chunk, and the hash of the n-gram that ends there (place >= n - 1 only counts)."""
    rows, places, hashes, base = [], [], [[], [], []], 0
    for at, end, data, offsets in kernels.slices(table.column("text"), 1 << 20):
        start, stop, row = kernels.words(data, offsets)
        h = kernels.spans(kernels.prefix_hash(data), start, stop)
        count = np.bincount(row, minlength=end - at)
        places.append(np.arange(len(row)) - np.concatenate(([0], np.cumsum(count)))[row])
        rows.append(row + base)
        gram = h
        for n in range(3):
            hashes[n].append(kernels.mix(gram + np.uint64(n + 1)) & mask)
            h = _before(h)
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + h
        base += end - at
    return np.concatenate(rows), np.concatenate(places), [np.concatenate(x) for x in hashes]


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, x.dtype), x[:-1])) if len(x) else x


def _asked(grams: list[np.ndarray], place: np.ndarray, totals: counting.Totals, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words whose n-gram is asked for, and a total for each of those (once totals has them); by the totals of shorter ones."""
    ok = place >= n - 1
    if n > 1:
        shorter, seen = _asked(grams, place, totals, n - 1)
        often = np.zeros(len(place), bool)
        often[shorter] = seen > 1
        ok &= often & _before(often)
    at = np.flatnonzero(ok)
    if f"n{n}" not in totals:
        return at, np.zeros(0, np.int64)
    distinct, where = np.unique(grams[n - 1][at], return_inverse=True)
    return at, totals[f"n{n}"][where] if len(distinct) else np.zeros(0, np.int64)


def _scores(table: pa.Table, totals: counting.Totals, mask: np.uint64) -> pa.Table:
    row, place, grams = _ngrams(table, mask)
    n_rows = table.num_rows
    words = np.bincount(row, minlength=n_rows)
    others = []
    for n in (1, 2, 3):
        at, total = _asked(grams, place, totals, n)
        left = np.zeros(len(place), np.int64)
        _, where = np.unique(grams[n - 1][at], return_inverse=True)
        _, own_at, own = np.unique(where * n_rows + row[at], return_inverse=True, return_counts=True)
        if len(at):
            left[at] = total - own[own_at]
        others.append(left)
    c1, c2, c3 = others
    rest = np.maximum(totals["all"].sum() - words, 1)[row]
    score = np.log(np.maximum(c1, 0.5) / rest) + np.minimum(place, 2) * np.log(BACKOFF)
    two = (place >= 1) & (c2 > 0)
    score = np.where(two, np.log(np.maximum(c2, 1) / np.maximum(_before(c1), 1)) + (place >= 2) * np.log(BACKOFF), score)
    three = (place >= 2) & (c3 > 0)
    score = np.where(three, np.log(np.maximum(c3, 1) / np.maximum(_before(c2), 1)), score)
    total = np.bincount(row, score, minlength=n_rows)
    return pa.table({
        "doc_id": table.column("doc_id"), "n_words": pa.array(words.astype(np.int64)), "log_score": pa.array(np.round(total, 4) + 0.0),
        "mean_log_score": pa.array(np.round(np.divide(total, words, out=np.zeros(n_rows), where=words > 0), 4) + 0.0),
    })


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed over words), mean_log_score.

    Words are runs of anything but ASCII white space. Null and empty texts
    have no words and score 0. Repeated rows are documents of their own, each
    predicted from the others. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    size = counting.text_bytes(docs)
    mask = hash_mask(size)
    chunks = counting.chunked(docs, size, CHUNK_BYTES)

    def keys(n: int):
        def of(table: pa.Table, totals: counting.Totals) -> counting.Keys:
            _, place, grams = _ngrams(table, mask)
            at, _ = _asked(grams, place, totals, n)
            own = {f"n{n}": counting.tally([grams[n - 1][at]])[0]}
            return own | ({"all": (np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([len(place)]))} if n == 1 else {})

        return of

    answers = counting.ask(chunks, keys(1), ["n1", "all"], size)
    answers = answers.unionByName(counting.ask(chunks, keys(2), ["n2"], size, answers, ("n1",)), allowMissingColumns=True)
    answers = answers.unionByName(counting.ask(chunks, keys(3), ["n3"], size, answers, ("n1", "n2")), allowMissingColumns=True)
    return counting.tell(chunks, answers, NAMES, lambda t, x: _scores(t, x, mask), "doc_id bigint, n_words bigint, log_score double, mean_log_score double")


LM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
t AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT *, lag(w, 1) OVER (PARTITION BY rid ORDER BY i) AS p1, lag(w, 2) OVER (PARTITION BY rid ORDER BY i) AS p2 FROM t),
c AS (SELECT rid, i,
        count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY rid, w) AS c1,
        CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY p1, w) - count(*) OVER (PARTITION BY rid, p1, w) ELSE 0 END AS c2,
        CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY p2, p1, w) - count(*) OVER (PARTITION BY rid, p2, p1, w) ELSE 0 END AS c3,
        greatest(count(*) OVER () - count(*) OVER (PARTITION BY rid), 1) AS rest FROM g),
l AS (SELECT *, lag(c1) OVER (PARTITION BY rid ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY rid ORDER BY i) AS b2 FROM c),
s AS (SELECT rid, CASE WHEN i >= 3 AND c3 > 0 THEN ln(c3::DOUBLE / b2)
        WHEN i >= 2 AND c2 > 0 THEN ln(c2::DOUBLE / b1) + CASE WHEN i >= 3 THEN ln(0.4::DOUBLE) ELSE 0 END
        ELSE ln(greatest(c1::DOUBLE, 0.5::DOUBLE) / rest) + (least(i, 3) - 1) * ln(0.4::DOUBLE) END AS s FROM l),
a AS (SELECT rid, count(*) AS n, sum(s) AS total FROM s GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(round(total, 4), 0.0::DOUBLE) + 0.0::DOUBLE AS log_score,
       coalesce(round(total / n, 4), 0.0::DOUBLE) + 0.0::DOUBLE AS mean_log_score
FROM d LEFT JOIN a ON d.rid = a.rid
"""
