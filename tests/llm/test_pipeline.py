import collections
import random

import pytest

import corpus_pipeline
from fleetlens.llm import queries


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    where = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    item = prose(rng, 40)
    for i in range(400):
        text = prose(rng, rng.randint(60, 120))
        if i % 8 == 1:
            text += " grumbold snarfle wozzik"
        if i % 50 == 2:
            text += " " + item
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 8 == 1)))
    rows += [(1000 + i, rows[i][1], "en", "s1", rows[i][4]) for i in range(20)]
    rows += [(2000 + i, rows[i][1] + " more", "en", "s2", rows[i][4] + 5) for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sharding":
            assert out.columns == docs.columns
        seen[name] = collections.Counter(r.doc_id for r in out.collect())
        docs = spark.createDataFrame(out.rdd, out.schema)
    base = {i for i in range(400) if i % 8 != 1}
    assert set(seen["toxicity"]) == base | {1000 + i for i in range(20) if i % 8 != 1} | {2000 + i for i in range(20) if i % 8 != 1}
    assert set(seen["near_dedup"]) == base and max(seen["near_dedup"].values()) == 1
    assert set(seen["decontamination"]) == {i for i in base if i % 50 != 2}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and max(seen["mixing"].values()) <= 3
    assert seen["sharding"] == seen["mixing"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows with nulls in every column, empty, blank and long texts, ties and repeats, and columns that clash with names inside the stages."""
    rng = random.Random(31)
    body = prose(rng, 80)
    rows = [(None, body, None, None, None), (None, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n", "en", None, 3), (4, prose(rng, 20_000), "en", "b", 1), (5, body, "en", "b", 1), (5, body, "en", "b", 1), (6, body + " tail", "en", "a", 1), (7, "one", "en", "c", 3), (8, "日本語のテキスト", "ja", "c", 8)]
    clash = {c: i for i, c in enumerate(("hits", "score", "shard", "depth", "copies", "row", "key", "size_", "text_key", "kept", "toxicity", "n_bytes"))}
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in clash)
    return spark.createDataFrame([(*r, *clash.values()) for r in rows], schema)


def test_stages_on_awkward_tables(spark, awkward, sf_dir):
    docs, left = awkward, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns if name == "sharding" else out.columns == docs.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        left[name] = sorted(((r.doc_id, r.text) for r in rows), key=str)
        assert all((r.hits, r.score, r.depth, r.copies, r.row, r.kept) == (0, 1, 3, 4, 5, 9) for r in rows)
    assert len(set(out.columns)) == len(out.columns) and "shard_" in out.columns
    assert len(left["toxicity"]) == awkward.count()
    assert sorted(str(i) for i, _ in left["near_dedup"]) == ["1", "3", "4", "5", "7", "8"]
    assert left["decontamination"] == left["near_dedup"] and {i for i, _ in left["mixing"]} >= {1, 3} and left["sharding"] == left["mixing"]


def test_stages_on_empty_tables(spark, awkward, sf_dir):
    none = spark.createDataFrame([], awkward.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == []


def test_run_writes_and_rereads(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 100 and "shard" in got.columns and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_thirteen_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
