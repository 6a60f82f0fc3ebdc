"""The operators on the generated tables: every link that brute force finds, and accuracy on the fold that is held out."""

import collections
import os
import re

import numpy as np
import pytest

from fleetlens.llm import near_dedup, queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def bag(text):
    """Five-word shingles; ASCII letters without case."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def test_no_link_is_lost(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    bags = {i: bag(t) for i, t in rows.items()}
    holders = collections.defaultdict(list)
    for i, b in bags.items():
        for s in b:
            holders[s].append(i)
    common = collections.Counter((i, j) for own in holders.values() for x, i in enumerate(own) for j in own[:x])
    links = {(i, j) for i, j in common if (low := (bags[i] & bags[j]).total()) >= 0.8 * (bags[i].total() + bags[j].total() - low) and rows[i] != rows[j]}
    same = collections.defaultdict(list)
    for i, t in rows.items():
        same[t or ""].append(i)
    assert len(links) > 3 and all(got[i] == got[j] for i, j in links) and all(len({got[i] for i in own}) == 1 for own in same.values())
    # and nothing else is joined: every class is connected by links and equal texts
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in [*links, *((own[0], i) for own in same.values() for i in own)]:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert got == {i: root(i) for i in rows}


@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.75)])
def test_held_out_ranking(spark, name, label, least):
    scored = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).filter("held_out").collect()}
    rows = [(scored[r.doc_id].score, r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in scored]
    good, bad = (np.array([s for s, y in rows if y == k]) for k in (1, 0))
    auc = ((good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2) if len(good) and len(bad) else 1.0
    assert auc >= least
