"""Token counts, importance resampling and collocations against brute force and DuckDB, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import collocations, resampling, storage, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_tokens int, rank int, position int, id int, word string, block int, score double"


def table(spark, rows):
    """rows of (doc_id, text, lang) with columns that clash with names inside the operators."""
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, 4, "w", 5, 0.5) for i, t, lang in rows], SCHEMA)


def phrases(rng, n):
    words = ["the", "A", "Cat", "sat", "on", "mat", "été", "日本", "x1", "and"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", ";", " - ", " "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    body = phrases(rng, 60)
    some = [(i, phrases(rng, rng.randint(0, 120)), rng.choice(["en", "de", None])) for i in range(60)]
    long = (900, phrases(rng, 20_000), "en")
    return [*some, long, (None, body, "en"), (None, None, None), (100, None, "en"), (101, "", "en"), (102, " \n", "en"), (103, body, "de"), (103, body, "de"), (104, "▁▁ <s> a</s>\x00", "und"), (105, "x" * 3000, "fr")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, (columns, found) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(found[0]))})", found)
    return con.execute(sql).fetchall()


def as_sorted(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_token_counts_are_the_librarys(docs, empty, rows, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = token_counts.token_counts(docs, model, limit=50)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"] and dict(got.dtypes)["n_tokens"] == "bigint"
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t, _ in rows]
    assert as_sorted(r[:4] for r in got.collect()) == as_sorted(want)
    assert got.filter("n_whole > n_tokens").count() == 0 and got.agg(F.sum("n_whole")).first()[0] > 5_000
    assert token_counts.token_counts(empty, model).count() == 0
    assert token_counts.token_counts(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), model).filter("doc_id = 'd101'").first().n_tokens == 0


def test_units_have_the_texts_tokens(model, monkeypatch):
    """Random strings of spaces, marks, unseen characters and special strings, over windows of a few bytes."""
    monkeypatch.setattr(token_counts, "WINDOW_BYTES", 40)
    monkeypatch.setattr(token_counts, "KEPT_UNITS", 200)
    whole = token_counts.whole_tokens(model)
    costs = token_counts.Costs(model, tuple(whole))
    rng = random.Random(3)
    letters = [*" ▁  ab\t\n\x00é日本　​😀́", "the ", "</s>", "ing", "    ", " The", "=====", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        assert costs.of(text.encode())[0] == len(costs.library.encode(text)), repr(text)
    assert len(whole) > 10_000 and all(len(costs.library.encode(u[1:].decode())) == 1 for u in whole[1:] if u != b" ")


def test_models_whose_units_are_not_independent_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2 as spec

    for change in (lambda m: m.pieces.add(piece="a▁b", score=-1.0, type=1), lambda m: m.pieces.add(piece="zz", score=0.0, type=4), lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True)):
        proto = spec.ModelProto.FromString(model)
        change(proto)
        with pytest.raises(ValueError):
            token_counts.whole_tokens(proto.SerializeToString())


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(words), [b" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_sample(rows, target, percent, min_words, buckets):
    own = [features(t) for _, t, _ in rows]
    count = lambda texts: collections.Counter(crc32(f) % buckets for _, fs in texts for f in fs)
    s, t = count(own), count([features(x) for x in target])
    big, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in range(buckets)]
    out = []
    for (i, _, _), (n, fs) in zip(rows, own, strict=True):
        weight = sum(gain[crc32(f) % buckets] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    rank = [(*r[:1], *r[2:], k if k <= len(able) * percent // 100 else None) for k, r in enumerate(able, 1)]
    return as_sorted(rank + [(*r[:1], *r[2:], None) for r in out if r[1] < min_words])


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_resampling_equals_brute_force(spark, docs, empty, rows, percent):
    target = ["the cat sat on the mat", None, "", "日本 x1 x1"]
    goal = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id int, text string, doc_id string")
    got = resampling.importance_sample(docs, goal, percent=percent, buckets=97)
    assert as_sorted(got.collect()) == brute_sample(rows, target, percent, 20, 97)
    if percent == 5:
        assert resampling.importance_sample(empty, goal).count() == 0
        assert as_sorted(resampling.importance_sample(docs, empty, percent=50).collect()) == brute_sample(rows, [], 50, 20, 10_000)
        sql = resampling.RESAMPLE_SQL.format(docs="d", target="b", buckets=97, seed=42, min_words=20, percent=5)
        known = [r for r in rows if "\x00" not in (r[1] or "")]
        want = in_duckdb(sql, d=("doc_id BIGINT, text VARCHAR, lang VARCHAR", known), b=("text VARCHAR", [(t,) for t in target]))
        assert as_sorted(want) == brute_sample(known, target, 5, 20, 97)


def test_text_rows_do_not_depend_on_windows(rows, monkeypatch):
    whole = [resampling.text_row((t or "").encode()) for _, t, _ in rows]
    monkeypatch.setattr(resampling, "WINDOW_BYTES", 7)
    for (n, at, counts), (_, t, _) in zip(whole, rows, strict=True):
        m, where, sums = resampling.text_row((t or "").encode())
        assert n == m and np.array_equal(at, where) and np.array_equal(counts, sums)


def test_blocks_and_positions(spark, docs, monkeypatch):
    """Small blocks hold the same matrix, and positions are 1..n in order over several ranges, with a third of the rows alike."""
    monkeypatch.setattr(resampling, "BLOCK_ENTRIES", 50)
    sums = resampling.column_sums(resampling.csr_blocks(docs))
    assert sums.sum() == sum(len(features(r.text)[1]) for r in docs.collect())
    rows = spark.range(9000).select((F.col("id") % 3 * F.col("id") % 700).alias("v"), F.lit("p").alias("part"))
    got = [(r.position, r.v) for r in storage.numbered(rows.repartition(5), [F.col("v").desc()]).collect()]
    assert [p for p, _ in sorted(got)] == list(range(1, 9001)) and [v for _, v in sorted(got)] == sorted((v for _, v in got), reverse=True)


def brute_phrases(rows, least, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if a < least or len(g) == 1:
                continue
            if len(g) == 2 and any(len(h) == 3 and b >= least and g in (h[:2], h[1:]) and 100 * b >= 50 * a for h, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, b" ".join(g), f[g[:k]], f[g[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "range_keys", "top"), [(None, 1 << 21, 2000), (24, 40, 2000), (31, 7, 5)])
def test_collocations_equal_brute_force(docs, empty, rows, monkeypatch, bits, range_keys, top):
    if bits:
        monkeypatch.setattr(collocations, "STRIDE", 3)
    got = collocations.collocations(docs, top=top, bits=bits, range_keys=range_keys)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 10, top)
    if not bits:
        assert collocations.collocations(empty).count() == 0
        assert len(got.collect()) > 50
        known = [r for r in rows if "\x00" not in (r[1] or "")]
        sql = collocations.PHRASE_SQL.format(docs="d", least=10, inside=50, top=2000)
        assert sorted(in_duckdb(sql, d=("doc_id BIGINT, text VARCHAR, lang VARCHAR", known))) == brute_phrases(known, 10, 2000)


def test_scores_past_64_bits_are_exact(spark):
    """Counts of a trillion: 1000000 a a has 31 digits."""
    a = 10**12 + 39
    grams = spark.createDataFrame([(1, 2, 0, a), (2, 3, 0, 5)], "id1 bigint, id2 bigint, id3 bigint, a bigint")
    words = spark.createDataFrame([("en", "x", a + 7, 1), ("en", "y", a + 11, 2), ("en", "z", 10**13, 3)], "lang string, word string, f bigint, id bigint")
    got = {r.phrase: r.score for r in collocations.scored_phrases(grams, words).collect()}
    assert got == {"x y": 10**6 * a * a // ((a + 7) * (a + 11)), "y z": 0}


def test_words_go_on_over_windows(monkeypatch):
    text = ("one two three. four,five " * 30).encode()
    whole = collocations.Block()
    whole.add(text)
    monkeypatch.setattr(collocations, "WINDOW_BYTES", 5)
    parts = collocations.Block()
    parts.add(text)
    assert np.array_equal(np.concatenate(whole.parts), np.concatenate(parts.parts)) and len(parts.parts) > 10


@pytest.mark.parametrize("bits", [5, 21, 22, 31])
def test_radix_sort_and_packing(bits):
    rng = np.random.default_rng(bits)
    a, b, c = rng.integers(0, 1 << bits, (3, 500)) % np.array([[1 << bits], [3], [2]])
    key = collocations.pack(a, b, c, bits)
    assert all(np.array_equal(x, y) for x, y in zip(collocations.unpack(key, bits), (a, b, c), strict=True))
    assert np.array_equal(collocations.radix_order(key, bits), np.lexsort((c, b, a)))
    order = collocations.radix_order(key, bits)
    assert (np.diff(collocations.leading(key, bits)[order]) >= 0).all()
    distinct, sums = collocations.run_lengths(key, np.ones(500, np.int64), bits)
    assert dict(zip(zip(*(x.tolist() for x in collocations.unpack(distinct, bits)), strict=True), sums.tolist(), strict=True)) == collections.Counter(zip(a.tolist(), b.tolist(), c.tolist(), strict=True))
