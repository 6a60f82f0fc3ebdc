"""Each operator against brute force, and on awkward tables: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import components, counting, decontam, fingerprints, kernels, lm_score, mixing, near_dedup, quality, sampling, sharding, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, key string, score double, shard string, bucket int, copies int"


def words_of(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def table(spark, rows):
    """rows of (doc_id, text, source) with columns that clash with names inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "k", 0.5, "x", 2, 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(1)
    long = words_of(rng, 30_000)
    body = words_of(rng, 60)
    rows = [(None, body, "a"), (None, None, None), (1, None, "a"), (2, "", "a"), (3, "   \n", None), (4, long, "b"), (5, body, "b"), (5, body, "b"), (6, body + " tail", "a"), (7, "one", "c"), (8, "日本語のテキスト", "c"), (9, words_of(rng, 40), "a")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(1, "x", "a")]).filter("doc_id = 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 1), (5, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_awkward_tables_keep_their_rows(spark, awkward, empty, labels):
    n = awkward.count()
    for f in (fingerprints.fingerprint_documents, mixing.mix_sources, suffix_dedup.remove_repeats, near_dedup.near_duplicates, lm_score.score_documents, sharding.assign_shards, lambda d: quality.quality_scores(d, labels), lambda d: toxicity.toxicity_scores(d, labels)):
        assert len(f(awkward).collect()) == n
        assert f(empty).collect() == []
    bench = spark.createDataFrame([(1, "not in there"), (2, None), (3, " .")], "item_id bigint, text string")
    whole = spark.createDataFrame([(1, "One!"), (2, "one one")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(awkward, whole).collect()] == [(7, 1, 1.0)]
    body = spark.createDataFrame([(1, awkward.filter("doc_id = 6").first().text)], "item_id bigint, text string")
    assert {r.doc_id for r in decontam.drop_contaminated(awkward, body).collect()} == {None, 1, 2, 3, 4, 7, 8, 9} and decontam.drop_contaminated(awkward, body).count() == awkward.count() - 4
    assert decontam.contaminated(awkward, bench).collect() == [] and decontam.contaminated(empty, bench).collect() == []
    for f in (near_dedup.drop_near_duplicates, mixing.emit_copies, lambda d: decontam.drop_contaminated(d, bench), lambda d: sharding.assign_shards(d, keep=["lang", "n_chars", "key", "size", "score"])):
        assert set(f(awkward).columns) >= {"doc_id", "lang", "key"} and f(empty).count() == 0


# 1


def test_fingerprints(spark):
    rng = random.Random(2)
    rows = [(i, words_of(rng, rng.choice([1, 5, 30, 300])), "a") for i in range(0, 60, 2)] + [(100, "", "a"), (101, None, "a")]
    rows.append((77, rows[3][1], "b"))
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(table(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert 0 <= r.near_edited <= 1 and len(r.fingerprint) % 8 == 0
    assert got[77].fingerprint == got[rows[3][0]].fingerprint and got[100].fingerprint == "" and got[101].near_next == 1.0
    big = [got[i].near_edited for i, t, _ in rows if t and len(t) > 1000]
    assert all(x > 0.2 for x in big)
    sets = lambda x: {x[i : i + 8] for i in range(0, len(x), 8)}
    for (i, _), (j, _) in zip(order, order[1:] + order[:1], strict=True):  # likeness is that of the printed fingerprints
        for a, b, j_ in ((got[i].fingerprint, got[i].edited_fingerprint, got[i].near_edited), (got[i].fingerprint, got[j].fingerprint, got[i].near_next)):
            a, b = sets(a), sets(b)
            assert j_ == (len(a & b) / len(a | b) if a | b else 1.0)


def test_fingerprints_follow_one_rule_at_every_length(spark):
    rng = random.Random(23)
    texts = [words_of(rng, 35)[:188], "tiny", "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(90)), "".join(rng.choice("abcdefgh") for _ in range(900)), words_of(rng, 9)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    after = {r.doc_id: r for r in fingerprints.fingerprint_documents(table(spark, [(1, texts[0], "a"), (0, "tiny", "a")])).collect()}
    assert 0.15 < after[1].near_edited < 0.9 and after[0].near_edited < 1
    assert all(r.fingerprint for r in got.values())
    assert all(0.15 < got[i].near_edited < 0.9 for i in (2, 3)) and got[0].near_next < 0.1


def test_anchors_are_context_free(spark):
    rng = random.Random(3)
    core = words_of(rng, 80)
    df = fingerprints.with_anchors(table(spark, [(1, words_of(rng, 30) + " " + core, "a"), (2, core + " " + words_of(rng, 50), "a")]).select("doc_id", "text"), "text", "anchors")
    a, b = (r.anchors for r in df.orderBy("doc_id").collect())
    shared = {x.hash: x.pos for x in a}
    moves = [shared[y.hash] - y.pos for y in b if y.hash in shared]
    assert len(moves) > 20 and set(moves) == {30}
    # closed: the smallest s-mer of each kept k-mer is the first or last
    again = df.filter("doc_id = 1").first().text.split()
    smer = spark.createDataFrame([(i, again[i], again[i + 1]) for i in range(len(again) - 1)], "i int, a string, b string").select("i", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).orderBy("i").collect()
    h = [x.h for x in smer]
    want = [i for i in range(len(h) - 5) if min(h[i], h[i + 5]) <= min(h[i + 1 : i + 5])]
    assert [x.pos for x in a if 0 <= x.pos <= len(again) - 7] == want
    pairs = spark.createDataFrame([(1, 2), (2, 9)], "a bigint, b bigint")
    met = fingerprints.match_positions(df, pairs).collect()
    assert [(r.a, r.b, r["shift"], r.n) for r in met] == [(1, 2, 30, len(moves))] and met[0].first >= 30


# 2


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        capped |= set(over)


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, words_of(rng, rng.randint(0, 60)), rng.choice(["s1", "s2", "s2", "s2", "Z", "é", None])) for i in range(2000)] + [(9000, words_of(rng, 3), "tiny")]
    got = mixing.mix_sources(table(spark, rows)).collect()
    sizes = collections.Counter()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1] if r.doc_id < 9000 else rows[-1][1])) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
    want = brute_targets(dict(sizes))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= 200
    again = mixing.mix_sources(table(spark, rows).repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
    copies = mixing.emit_copies(table(spark, rows)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r.copies if r.size else 1 for r in got if r.copies or not r.size}


def test_ties_among_repeated_ids_are_dealt_alike(spark):
    """Rows of one id, source and size get the same copies, and the same row stays, however the rows are dealt."""
    rng = random.Random(5)
    body = [words_of(rng, 30) for _ in range(6)]
    rows = [(7, body[i % 6], "a", i) for i in range(90)] + [(i, words_of(rng, 30), "b", i) for i in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, at int")
    for f in (mixing.emit_copies, near_dedup.drop_near_duplicates):
        seen = [sorted((r.doc_id, r.text, r.at) for r in f(docs.repartition(n, "at")).collect()) for n in (1, 5)]
        assert seen[0] == seen[1] and seen[0]


def test_an_outsized_text_is_left_out_of_the_sample_alone(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:50]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id bigint, quality int, toxic int")
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows = [(i, "x" * (5000 if i == order[0] else 100), "a") for i in ids]
    assert sorted(sampling.labelled_sample(table(spark, rows), labels, "toxic", 1000, 4900)) == sorted(("x" * 100, i % 2) for i in ids if i != order[0])
    some = sampling.labelled_sample(table(spark, rows), labels, "toxic", 1000, 1000)
    assert some == [("x" * 100, i % 2) for i in sorted(order[1:11])]
    assert len(sampling.labelled_sample(table(spark, rows + rows + [(order[1], "y", "b")]), labels, "toxic", 1000)) == 50
    assert sampling.labelled_sample(table(spark, rows), labels.filter("doc_id < 0"), "toxic", 1000) == []
    with pytest.raises(ValueError):
        sampling.labelled_sample(table(spark, rows), labels, "toxic", 1000, 99)


# 3


def brute_repeats(texts, length):
    count = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("length", "k"), [(200, 50), (40, 10), (8, 3)])
def test_repeats(spark, length, k):
    rng = random.Random(length)
    part = [words_of(rng, 40, "abé") for _ in range(4)]
    rows = []
    for i in range(40):
        t = words_of(rng, rng.randint(0, 40), "abé")
        if i % 3:
            cut = rng.choice(part)
            t += cut[rng.randint(0, 30) :] + words_of(rng, rng.randint(0, 5))
        rows.append((i, t, "a"))
    rows += [(50, rows[1][1], "a"), (51, "ab" * 300, "a"), (52, "x" * (length + 1), "a"), (53, None, "a")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, rows), length, k).collect()}
    for (i, t, _), gone in zip(rows, brute_repeats([(t or "").encode() for _, t, _ in rows], length), strict=True):
        b = np.frombuffer((t or "").encode(), np.uint8)
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), int((edges == 1).sum())), i
        assert r.kept_sha256 == hashlib.sha256(b[~gone].tobytes()).hexdigest() and r.spans == np.flatnonzero(edges).tolist()


# 4


def bag(t):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.split(r"[ \t-\r]+", t) if x]
    return collections.Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows, base = [], [words_of(rng, rng.randint(30, 200)).split() for _ in range(30)]
    common = words_of(rng, 25)
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = words_of(rng, 1)
        rows.append((i, " ".join(w) + (" " + common if i % 2 else ""), "a"))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    bags = {i: bag(t) for i, t, _ in rows}
    n = len({t for _, t, _ in rows})
    df = collections.Counter(s for i, t, _ in rows for s in bags[i])
    weight = {s: max(math.log2((len(rows) + 1) / d), 1e-3) if 2 * d > len(rows) else 1.0 for s, d in df.items()}
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in bags:
        for j in range(i):
            low = sum(weight[s] * min(c, bags[j][s]) for s, c in bags[i].items() if s in bags[j])
            high = sum(weight[s] * c for x in (bags[i], bags[j]) for s, c in x.items()) - low
            if low / high >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in bags} and n < len(rows)
    kept = near_dedup.drop_near_duplicates(table(spark, rows + rows[:3]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i in bags}) and kept.columns == table(spark, rows).columns


def test_shingling_takes_little_memory_at_once():
    """What a worker holds follows the slice, not the batch; the hashes are those of the texts one by one."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 500)) for _ in range(2000)]
    kernels._powers.clear()
    tracemalloc.start()
    held = sum(len(h) for _, h, _ in near_dedup._peers(pa.array(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and held == sum(len(h) for t in texts for _, h, _ in near_dedup._peers(pa.array([t])))


def test_near_copies_in_a_template_family_are_found(spark):
    rng = random.Random(16)
    template = words_of(rng, 150).split()
    rows = []
    for i in range(2000):
        own = [f"own{i}"] + words_of(rng, 19).split()
        rows.append((2 * i, " ".join(template + own), "a"))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(template + own[:6] + words_of(rng, 14).split()), "a"))
    filler = [(10_000 + i, words_of(rng, 20), "a") for i in range(2500)]
    got = near_dedup.near_duplicates(table(spark, rows + filler)).filter("doc_id < 10000").collect()
    bags = {i: bag(t) for i, t, _ in rows}
    alike = lambda a, b: (a & b).total() / (a | b).total()
    assert max(alike(bags[0], bags[i]) for i, _, _ in rows[2:]) < 0.8 and min(alike(bags[i - 1], bags[i]) for i in bags if i % 2) >= 0.8
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in bags}


def test_icws_collides_as_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 40).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 3, 40), rng.uniform(0.5, 3, 40)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    hits = 0
    for trial in range(3000):
        x = kernels.mix(h + np.uint64(trial * 1_000_003))
        (la, na), (lb, nb) = near_dedup.icws(x, wa), near_dedup.icws(x, wb)
        hits += na[la.argmin()] == nb[lb.argmin()]
    assert abs(hits / 3000 - want) < 0.04


def test_common_shingles_are_found(spark):
    rng = random.Random(8)
    common = words_of(rng, 10)
    df = table(spark, [(i, words_of(rng, 20) + (" " + common if i % 10 < 6 else ""), "a") for i in range(400)])
    h, idf = near_dedup.common_shingles(df.select("text"))
    assert len(h) == 6 and np.allclose(idf, np.log2(401 / 240))


def test_queries_weigh_by_the_whole_idf(spark, tmp_path):
    """op4 and the pipeline's stage against brute force: a shingle's weight follows its df below half of the texts too."""
    import corpus_pipeline
    from fleetlens.llm import queries

    rng = random.Random(26)
    shared, rows = [words_of(rng, 45).split() for _ in range(4)], []
    for i in range(60):
        own = words_of(rng, 20).split()
        rows.append((3 * i, " ".join(shared[i % 4] + own), "a"))
        rows.append((3 * i + 1, " ".join(shared[i % 4] + own[: 20 - i % 7] + words_of(rng, i % 7).split()), "a"))
        rows.append((3 * i + 2, words_of(rng, 60), "a"))
    rows += [(1000, "", "a"), (1001, None, "a"), (1002, "one", "a")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    bags = {i: bag(t or "") for i, t, _ in rows}
    df = collections.Counter(s for b in bags.values() for s in b)

    def classes(weight):
        of = {i: i for i in bags}
        for i, j in ((i, j) for i in bags for j in bags if j < i and (bags[i] & bags[j] or not bags[i] + bags[j])):
            low = sum(weight(s) * c for s, c in (bags[i] & bags[j]).items())
            if low >= 0.8 * sum(weight(s) * c for s, c in (bags[i] | bags[j]).items()):
                a, b = sorted((of[i], of[j]))
                of = {k: a if c == b else c for k, c in of.items()}
        return of

    want, flat = classes(lambda s: math.log2((len(rows) + 1) / df[s])), classes(lambda s: 1.0)
    assert want != flat and len(set(want.values())) < len(rows)
    assert {r.doc_id: r.class_id for r in queries.QUERIES["op4_near_dedup"](spark, str(tmp_path)).collect()} == want
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200 and len(got) == 40 + 60 + 2


@pytest.mark.parametrize("fan", [1, 3, 4096])
def test_counts_are_exact_over_one_leg_or_two(spark, fan):
    rng = random.Random(22)
    rows = [(i, " ".join(str(rng.randrange(200) ** 2 % 97) for _ in range(rng.randrange(30))), "a") for i in range(120)]
    df = spark.createDataFrame([(i, t, i % 17) for i, t, _ in rows], "doc_id bigint, text string, chunk bigint")
    number = lambda w: (kernels.mix(np.array([int(x) // 2 for x in w], np.uint64)), np.array([int(x) % 2 for x in w], np.uint64))  # noqa: E731  equal keys, different checks

    def keys(table, _):
        k, v = number(" ".join(table.column("text").to_pylist()).split())
        return {"w": counting.tally([k], [v])[0], "all": (np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([len(k)]))}

    def result(table, totals):
        words = " ".join(table.column("text").to_pylist()).split()
        k, v = number(words)
        _, where = counting.tally([k], [v])
        return pa.table({"w": pa.array(words), "n": pa.array(totals["w"][where[0]] if words else np.zeros(0, np.int64), pa.int64()), "rest": pa.array(np.full(len(words), totals["all"].sum()), pa.int64())})

    answers = counting.ask(df, keys, ["w", "all"], 900, part_bytes=100, fan=fan)
    got = {(r.w, r.n, r.rest) for r in counting.tell(df, answers, ["w", "all"], result, "w string, n bigint, rest bigint").collect()}
    want = collections.Counter(w for _, t, _ in rows for w in t.split())
    assert got == {(w, n, want.total()) for w, n in want.items()}


# 5


def test_lm_scores(spark):
    rng = random.Random(9)
    vocabulary = words_of(rng, 12).split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))), "a") for i in range(40)] + [(40, "unseen words here", "a")]
    grams = [collections.Counter() for _ in range(3)]
    own = {}
    for i, t, _ in rows:
        w = t.split()
        own[i] = [collections.Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for n in (1, 2, 3)]
        for g, o in zip(grams, own[i], strict=True):
            g.update(o)
    total = sum(grams[0].values())
    for r in lm_score.score_documents(table(spark, rows)).collect():
        w = rows[r.doc_id][1].split()
        c = lambda g: grams[len(g) - 1][g] - own[r.doc_id][len(g) - 1][g]  # noqa: B023, E731
        want = 0.0
        for j in range(len(w)):
            u, v, x = tuple(w[max(0, j - 2) : j]), tuple(w[max(0, j - 1) : j]), (w[j],)
            if j >= 2 and c(u + x):
                want += math.log(c(u + x) / c(u))
            elif j >= 1 and c(v + x):
                want += math.log(c(v + x) / c(v)) + (math.log(0.4) if j >= 2 else 0)
            else:
                want += math.log(max(c(x), 0.5) / (total - len(w))) + min(j, 2) * math.log(0.4)
        assert r.n_words == len(w) and r.log_score == pytest.approx(want, abs=1e-4)


# 6


def test_decontamination(spark):
    rng = random.Random(10)
    vocabulary = words_of(rng, 400).split()
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: pick([1, 2, 3, 5, 6, 12, 36, 60][i % 8]) for i in range(25)}
    docs = {}
    for d in range(200):
        x = list(items[rng.randrange(25)]) if rng.random() < 0.8 else []
        for _ in range(rng.choice([0, 1, 2]) if x else 0):
            k, r = rng.randrange(len(x)), rng.random()
            if r < 0.4:
                x[k] = rng.choice(vocabulary)
            elif r < 0.7:
                x.insert(k, rng.choice(vocabulary))
            elif len(x) > 1:
                del x[k]
        docs[d] = pick(rng.randint(0, 80)) + x + pick(rng.randint(0, 80) if rng.random() < 0.8 else 0)
    df = table(spark, [(d, "  ".join(w).upper() + ".", "a") for d, w in docs.items()])
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(df, bench).collect()}
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    want = {}
    for i, w in items.items():
        k = min(5, len(w))
        item = grams(w, k)
        for d, x in docs.items():
            own = grams(x, k)
            if not set(own) & set(item):
                continue
            for s in range(max(1, len(own) - len(item) + 1)):
                a, b = collections.Counter(own[s : s + len(item)]), collections.Counter(item)
                low = sum((a & b).values())
                j = low / (sum(a.values()) + len(item) - low)
                if j >= 0.8 - 1e-12:
                    want[d, i] = max(j, want.get((d, i), 0))
    assert any(len(items[i]) < 4 for _, i in want)
    assert got == pytest.approx(want) and len(want) > 20
    clean = decontam.drop_contaminated(df, bench)
    assert {r.doc_id for r in clean.collect()} == set(docs) - {d for d, _ in want} and clean.columns == df.columns


def test_items_without_their_first_words_are_found(spark):
    rng = random.Random(18)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    items = {}
    for i, n in enumerate(range(30, 45)):
        w = [word(5) for _ in range(n + 4)]
        w[4], w[5] = word(11), word(11)
        items[i] = w
    docs = table(spark, [(i, " ".join(w[6:]), "a") for i, w in items.items()])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs, bench).collect()}
    assert got == pytest.approx({(i, i): (len(w) - 10) / (len(w) - 4) for i, w in items.items()})


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert df.filter(F.size(F.array_intersect(decontam.blocks(F.col("a")), decontam.blocks(F.col("b")))) == 0).count() == 0


def test_simhash_and_bags():
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(400):  # windows that just reach 0.8
        n = int(rng.integers(9, 70))
        kept = math.ceil(1.6 * n / 1.8)
        common, a, b = (rng.integers(0, 2, (k, 64)) for k in (kept, n - kept, n - kept))
        votes = [(np.concatenate((common, x)).sum(0) * 2 > n) for x in (a, b)]
        lost += (votes[0] != votes[1]).sum() > decontam.RADIUS
    assert lost == 0


def test_simhash_is_the_majority(spark):
    rng = random.Random(19)
    bags = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 30)]
    bags.append(bags[2] + bags[2][:3])
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, b array<bigint>")
    got = {r.i: r for r in df.select("i", decontam.simhash(F.col("b")).alias("h"), decontam.weighted_jaccard(decontam.numbered(F.col("b")), decontam.numbered(F.array_distinct("b"))).alias("j")).collect()}
    for i, b in enumerate(bags):
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in b) > len(b))
        assert got[i].h % (1 << 64) == want
    assert got[4].j == 0.7 and got[3].j == 1.0
    assert spark.range(1).select(decontam.simhash(F.array_repeat(F.lit(5).cast("long"), 70_000)).alias("h")).first().h == 5


# 7


def test_sharding(spark):
    rng = random.Random(12)
    rows = [(i, words_of(rng, rng.randint(0, 30)), "a") for i in range(500)] + [(1000, "z" * 5000, "a")] + [(2000, "same text " * 10, "b")] * 50
    got = sharding.assign_shards(table(spark, rows), 2000, keep=["lang"]).collect()
    sums, docs = collections.Counter(), collections.Counter()
    for r in got:
        sums[r.shard] += r.n_bytes
        docs[r.shard] += 1
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard_bytes, r.shard_docs) == (sums[r.shard], docs[r.shard]) and (sums[r.shard] <= 2000 or (r.oversize and docs[r.shard] == 1))
    leaves = sorted({r.shard.split("#")[0] for r in got})
    assert not any(b.startswith(a) and a != b for a in leaves for b in leaves)  # no shard is inside another
    plain = {r.shard for r in got if "#" not in r.shard}
    for s in plain:  # and none could have stayed with its sibling
        assert s == "" or sum(v for k, v in sums.items() if k.startswith(s[:-1])) > 2000


# 8, 9


def test_quality_learns_a_ranking(spark):
    rng = random.Random(13)
    rows = [(i, words_of(rng, 60) if i % 3 else " ".join(w + "###" for w in words_of(rng, 60).split()), "a") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_scores(table(spark, rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_pairs_are_all_of_them():
    """The weights are where the gradient over every pair of the two labels is 0, at any block size."""
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.6).astype(int)
    x = rng.normal(size=(60, len(quality.FEATURES))) + y[:, None] * 0.3
    models = [quality.fit_bradley_terry(x, y, 1e-2, block) for block in (7, 1000)]
    assert np.allclose(models[0].weights, models[1].weights, atol=1e-7)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    p = 1 / (1 + np.exp(-d @ models[0].weights))
    assert np.abs(d.T @ (p - 1) / len(d) + 1e-2 * models[0].weights).max() < 1e-7


def test_automaton_is_the_edit_distance():
    rng = random.Random(14)
    terms = ["idiotic", "moron", "scum", "lowe*", "abcde*"]
    a = toxicity.build_automaton(terms)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    def want(word):
        best = 9
        for t in terms:
            stem = t.rstrip("*")
            most = 1 if len(stem) >= 5 else 0
            ends = range(len(word) + 1) if t.endswith("*") else [len(word)]
            best = min([best, *(d for e in ends if (d := distance(word[:e], stem)) <= most)])
        return best

    tests = ["idiotic", "idiotc", "idiottic", "xidiotic", "idiot", "moron", "oron", "morron", "scum", "scun", "lowering", "lowr", "abcdx", "abde", "abcdefgh", "bcdezz", "q"]
    tests += ["".join(rng.choice("abcdeilmnoprstuw") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    data, offsets = toxicity.lowered([" ".join(tests)])
    start, end, _ = toxicity.word_spans(data, offsets)
    assert toxicity.find(a, data, start, end).tolist() == [want(t) for t in tests]


def test_toxicity_is_learned_without_fetching_texts(spark, monkeypatch):
    rng = random.Random(16)
    rows = [(i, words_of(rng, 20) + (" grumbold snarfle" if i % 4 == 1 else ""), "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    docs = table(spark, rows)
    sample = sampling.labelled_sample(docs, labels, "toxic", 300)
    fetched, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: fetched.append(self.columns) or collect(self))
    model = toxicity.train(docs, labels, 300)
    assert not [c for c in fetched if "text" in c]
    assert model.lexicon and model.to_json() == toxicity.learn([t for t, _ in sample], np.array([y for _, y in sample], float)).to_json()
    assert toxicity.train(docs, labels.filter("doc_id < 0")).lexicon == [] == toxicity.train(docs.filter("doc_id < 0"), labels).lexicon


def test_toxicity_learns_terms_and_context(spark):
    rng = random.Random(15)
    bad = ["grumbold", "snarfle", "wozzik"]
    rows, marks = [], []
    for i in range(600):
        w = words_of(rng, 40).split()
        kind = i % 4
        if kind == 1:
            w[5:5] = rng.sample(bad, 2)
        if kind == 2:
            w[5:5] = ["he", "said", '"' + bad[i % 3] + '"', "once"]
        rows.append((i, " ".join(w), "a"))
        marks.append((i, 1, int(kind == 1)))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(table(spark, rows), labels)
    got = toxicity.toxicity_scores(table(spark, rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 == 1) for r in held) / len(held) > 0.95 and '"lexicon"' in model.to_json()


def test_misspelt_terms_score_high(spark):
    rng = random.Random(16)
    rows = [(i, words_of(rng, 40) + (" grumbold snarfle" if i % 2 else ""), "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(table(spark, rows), labels)
    assert {"grumbold", "snarfle"} <= set(model.lexicon)
    x = toxicity.hit_features(toxicity.build_automaton(model.lexicon), ["you grumbld and snarfel snarfl", "plain words"])
    assert x[0, 1] > 0 and not x[1].any()


# 10


def test_url_filter(spark):
    entries = spark.createDataFrame([
        ("bad.org", "block", "add", "2024-02-01"), ("bad.org", "block", "remove", "2024-03-01"), ("bad.org", "block", "add", "2024-02-10"), ("example.com", "block", "add", "2024-01-10"),
        ("ok.example.com/en/", "allow", "add", "2024-01-20"), ("tie.net", "allow", "add", "2024-01-01"), ("tie.net", "block", "add", "2024-01-01"), ("x.org", "block", "remove", "2024-01-01"), (None, "block", "add", "2024-01-01"),
    ], "pattern string, action string, op string, day string").withColumn("day", F.to_date("day"))
    rows = [
        (1, "http://bad.org/a", "2024-01-31"), (2, "http://BAD.org/a", "2024-02-01"), (3, "http://bad.org", "2024-02-29"), (4, "http://bad.org", "2024-03-01"), (5, "https://ok.example.com/en/1", "2024-02-01"),
        (6, "https://ok.example.com/en/1", "2024-01-15"), (7, "https://ok.example.com/de/1", "2024-02-01"), (8, "https://tie.net/", "2024-05-01"), (9, "https://x.org/", "2024-05-01"), (10, None, "2024-05-01"), (11, "nonsense", "2024-05-01"), (12, "http://example.com/", None), (None, "http://u:p@sub.bad.org:80/", "2060-01-01"), (13, "http://a.example.com/", "2060-02-02"),
    ]
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetched string").withColumn("fetched", F.to_date("fetched"))
    got = {r.page_id: r for r in url_filter.filter_captures(captures, entries).collect()}
    assert {k for k, r in got.items() if r.blocked} == {2, 3, 6, 7, 8, 13} and len(got) == len(rows)
    assert got[5].rule == "allow:ok.example.com/en/" and got[7].rule == "block:example.com" and str(got[2].since) == "2024-02-01" and got[1].rule is None
    spans = {(r.pattern, r.action, str(r.since), str(r.until)) for r in url_filter.validity_intervals(entries).collect()}
    assert ("bad.org", "block", "2024-02-01", "2024-03-01") in spans and len(spans) == 5
    assert url_filter.filter_captures(captures.limit(0), entries).count() == 0 and url_filter.filter_captures(captures, entries.limit(0)).filter("blocked").count() == 0


# Kernels


def test_kernels():
    texts = ["a b  c", "", None, "É x\ty " * 3, "one"]
    runs = list(kernels.slices(pa.array(texts), 5))
    assert [r[:2] for r in runs][0] == (0, 1) and runs[-1][1] == 5
    words = [bytes(d[s:e]) for _, _, d, o in runs for s, e, _ in zip(*kernels.words(d, o), strict=True)]
    assert words == [w.encode() for t in texts for w in (t or "").split()]
    data = np.frombuffer(b"abcabcabd", np.uint8)
    sums = kernels.prefix_hash(data)
    h = kernels.spans(sums, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]
