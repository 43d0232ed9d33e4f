"""The registered queries: against their SQL, or against brute force on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from labmesh.llm.queries import ORACLES, REGISTRY, TOKENIZER
from tools.compare import TABLES, bag

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def joined(nodes, links):
    """Smallest reachable node per node, by plain union."""
    above = {n: n for n in nodes}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def near_components(texts, n, percent):
    """Components by comparing every pair that shares a shingle."""
    sets = {i: shingles(t, n) for i, t in texts}
    holders, common = collections.defaultdict(list), collections.Counter()
    for i, own in sets.items():
        for s in own:
            for other in holders[s]:
                common[other, i] += 1
            holders[s].append(i)
    links = [
        (a, b)
        for (a, b), both in common.items()
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
    ]
    return joined(sets, links), sets


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, db, name):
    ours = REGISTRY[name](spark, FOLDER).toPandas()
    theirs = db.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours) == bag(theirs)


def test_quality(spark, db):
    rows = REGISTRY["op1_quality"](spark, FOLDER).toPandas().set_index("doc_id")
    ids = [r[0] for r in db.execute("SELECT doc_id FROM documents").fetchall()]
    assert sorted(rows.index) == sorted(ids)
    assert rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    assert all(rows["held_out"][i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in ids)


def test_quality_on_held_out_labels(spark):
    large = "/root/testdata/sf0.01"
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{large}/labels.parquet'").df()
    rows = REGISTRY["op1_quality"](spark, large).toPandas().merge(labels, on="doc_id")
    held = rows[rows["held_out"]]
    assert len(held) > 40 and (held["predicted"] == held["quality"]).mean() >= 0.95


def test_vectors(spark, db):
    rows = REGISTRY["op2_embedding_dedup"](spark, FOLDER).toPandas().set_index("vec_id")
    given = db.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, _ in given}
    links = [
        (a, b)
        for a, _, la in given
        for b, _, lb in given
        if a < b and la == lb and unit[a] @ unit[b] >= 0.93
    ]
    count = collections.Counter(x for pair in links for x in pair)
    want = joined(unit, links)
    for i in unit:
        assert (rows["n_links"][i], rows["component_id"][i]) == (count[i], want[i])
        assert rows["kept"][i] == (want[i] == i)


def test_near_copies(spark, db):
    rows = REGISTRY["op7_minhash_dedup"](spark, FOLDER).toPandas().set_index("doc_id")
    want, sets = near_components(db.execute("SELECT doc_id, text FROM documents").fetchall(), 3, 85)
    assert rows["component_id"].to_dict() == want
    assert rows["n_shingles"].to_dict() == {i: len(s) for i, s in sets.items()}
    assert all(rows["kept"][i] == (want[i] == i) for i in want)


def test_main_texts(spark, db):
    """The pages' articles, cut out by their tags."""
    import html
    import re

    rows = REGISTRY["op8_main_text"](spark, FOLDER).toPandas().set_index("page_id")
    for i, page in db.execute("SELECT page_id, html FROM pages").fetchall():
        article = re.search("<article>(.*)</article>", page, re.S).group(1)
        blocks = re.split("</?(?:p|h1|article)>", article)
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        want = "\n".join(b for b in plain if b)
        assert rows["text"][i] == want and rows["n_chars"][i] == len(want)


def test_fingerprints(spark, db):
    rows = REGISTRY["op9_fingerprints"](spark, FOLDER).toPandas().set_index("doc_id")
    texts = db.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY 1 DESC").fetchall()
    assert len(rows) == len(texts)
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows["n_chars"][i] == len(text)
        assert rows["edited_sha256"][i] == hashlib.sha256(edited.encode()).hexdigest()
    same = collections.defaultdict(set)
    for i, text in texts:
        same[text].add(rows["fingerprint"][i])
    assert all(len(f) == 1 for f in same.values())
    long = rows[rows["n_chars"] > 400]
    assert long["near_edited"].median() > 0.2 and long["near_next"].median() < 0.05


def test_pieces(spark, db):
    rows = REGISTRY["op10_pieces"](spark, FOLDER).toPandas()
    assert rows["round_trip"].all()
    given = dict(db.execute("SELECT doc_id, sha256(coalesce(text, '')) FROM documents").fetchall())
    assert dict(zip(rows["doc_id"], rows["decoded_sha256"])) == given


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")
def test_pipeline(spark, db):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = pipeline.good_quality(spark, docs, FOLDER).toPandas()
    labels = dict(db.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert list(good.columns) == docs.columns
    kept = set(good["doc_id"])
    assert sum(labels[i] == 1 for i in labels if i in kept) >= 0.98 * sum(labels.values())

    one = pipeline.one_of_each(spark, spark.createDataFrame(good), FOLDER).toPandas()
    want, _ = near_components(list(zip(good["doc_id"], good["text"])), 5, 80)
    assert sorted(one["doc_id"]) == sorted(i for i, c in want.items() if i == c)

    mixed = pipeline.mixed(spark, spark.createDataFrame(one), FOLDER).toPandas()
    assert list(mixed.columns) == docs.columns and set(mixed["doc_id"]) <= set(one["doc_id"])
    assert mixed.groupby("doc_id").size().max() <= 3

    out = pipeline.encoded(spark, spark.createDataFrame(mixed), FOLDER).toPandas()
    assert len(out) == len(mixed) and out["round_trip"].all()
    run = pipeline.run(spark, FOLDER).toPandas()
    assert sorted(run["doc_id"]) == sorted(out["doc_id"])
