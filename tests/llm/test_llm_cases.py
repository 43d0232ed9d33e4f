"""Null, empty, very long, repeated and tied rows, empty tables and clashing names."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from labmesh.llm import block_training, fingerprints, html_blocks, licences, minhash, pieces, shingles, warc
from labmesh.llm import vectors as vec
from labmesh.llm.components import components
from labmesh.llm.fingerprints import edited_fingerprints, fingerprint
from labmesh.llm.html_blocks import extract_text, main_texts
from labmesh.llm.licences import KNOWN, licence_scan
from labmesh.llm.minhash import near_duplicates
from labmesh.llm.mixing import mix_sources
from labmesh.llm.pieces import decode_ids, decode_pieces, encode_pieces, load_pieces
from labmesh.llm.quality import fit_trees, score_quality, statistics, train_quality
from labmesh.llm.queries import TOKENIZER
from labmesh.llm.urls import Vocabulary, url_verdicts
from labmesh.llm.vectors import near_vectors
from labmesh.llm.warc import parse_record, read_records, write_archives
from tests.conftest import rows_of

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, taken int"


def documents(spark, *rows):
    """Rows of (doc_id, text, source) with two columns that clash with results."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 7) for i, t, s in rows], DOC)


LONG = "word " * 60_000 + "end"


# --- 1 quality


def test_statistics_of_nothing_and_much():
    assert statistics(None) == statistics("") == [0.0] * len(statistics("a"))
    assert all(np.isfinite(statistics(t)).all() for t in (" ", "\n\n", "\x00", LONG, "é" * 9))


def test_trees_learn_a_rule_and_walk_as_they_grew():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 22))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    trees = fit_trees(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == (y[2000:] > 0.5)).mean() > 0.95

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                goes_left = row[trees.feature[node]] <= trees.threshold[node]
                node = (trees.left if goes_left else trees.right)[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])


def test_scores_without_labels_and_of_odd_texts(spark):
    docs = documents(spark, (1, None, "a"), (2, "", "a"), (2, "", "a"), (None, LONG, None))
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    trees = train_quality(docs, none)
    out = score_quality(docs, trees).collect()
    assert len(out) == 4 and {r.score for r in out} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert train_quality(docs, one).base != trees.base
    assert score_quality(docs.limit(0), trees).count() == 0


# --- 2 vectors


def test_vectors_that_cannot_link(spark):
    rows = [
        (1, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, [0.93, 0.37], 5), (4, [0.0, 0.0], 5),
        (5, None, 5), (6, [], 5), (7, [1.0, None], 5), (8, [1.0, float("nan")], 5),
        (9, [float("inf"), 0.0], 5), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 6),
        (None, [1.0, 0.0], 5), (12, [1.0, 0.0, 0.0], 5), (2, [3.0, 0.0], 5),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("unit", F.lit(1)).withColumn("class", F.lit("x"))
    out = rows_of(near_vectors(df, threshold=0.9291))
    assert out == sorted(
        [
            (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False),
            *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)), (None, 0, None, True),
        ],
        key=repr,
    )
    assert near_vectors(df.limit(0)).count() == 0


def test_tiles_find_what_brute_force_finds(spark, monkeypatch):
    """Small tiles, a large group of near copies and a chain."""
    monkeypatch.setattr(vec, "TILE", 64)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((200, 16))
    near = base[0] + 0.08 * rng.standard_normal((150, 16))
    turn = np.linspace(0, 2, 40)
    chain = np.outer(np.cos(turn), np.eye(16)[0]) + np.outer(np.sin(turn), np.eye(16)[1])
    x = np.concatenate([base, near, chain])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    got = near_vectors(df).toPandas().set_index("vec_id").sort_index()
    assert (got["n_links"].to_numpy() == linked.sum(axis=1)).all()
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert (got["component_id"].to_numpy() == label).all()


# --- 3 urls


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://A.Com/x", "x://a.net/es/1?q", "x://b.a.net/fr/", "x://net/de/",
        "http://WWW.Example.com/en/1#f", "http://example.com/en/1", "http://notexample.com/en/1",
        "http://a.org/heads/winter", "http://casino-x.org", "http://a.org/cheap?pills", "http://a.org/cheap",
        "http://a.org/cheap/free", "http://xn--free.org/free", "://a.com/", "http://é.org/\nx#y", "a://b://c/d",
    ]
    df = spark.createDataFrame([(u, "old") for u in urls] + [("", "old")], "url string, verdict string")
    out = {r.url: r for r in url_verdicts(df).collect()}
    assert len(out) == len(urls) and out[None].host == out[None].path == ""
    assert (out["http://A.Com/x"].host, out["http://A.Com/x"].rule) == ("a.com", "com/")
    assert out["x://a.net/es/1?q"].path == "/es/1" and out["x://a.net/es/1?q"].verdict == "block"
    blocked = {u for u, r in out.items() if r.verdict == "block"}
    assert blocked == {
        "x://a.net/es/1?q", "x://b.a.net/fr/", "http://example.com/en/1", "http://casino-x.org",
        "http://a.org/cheap?pills", "http://a.org/cheap/free",
    }
    assert out["http://www.Example.com/en/1#f".replace("www", "WWW")].rule == "www.example.com/en/"
    assert out["http://notexample.com/en/1"].rule == "com/" and out["x://net/de/"].rule is None
    assert out["a://b://c/d"].host == "b:" and out["a://b://c/d"].path == "//c/d"
    assert url_verdicts(df.limit(0)).count() == 0


def test_terms_count_between_boundaries():
    words = Vocabulary(strict=("bad",), soft=("one", "two"))
    find = words.automaton()
    assert words.hits(find, "bad") == (1, 0) and words.hits(find, "badly.nobad") == (0, 0)
    assert words.hits(find, "one/one-one") == (0, 1) and words.hits(find, "one_two") == (0, 2)


# --- 4 licences


def test_licence_copies(spark):
    mit = KNOWN["MIT"][0]
    changed = "Copyright (c) 2019 Some Body\n© 2020 Other\n\n" + mit.upper().replace(",", " ;").replace("LICENSE", "LICENCE")
    rows = [
        (1, mit, "a"), (2, changed, "a"), (3, mit + " and more", None), (4, None, "a"), (5, "", "a"),
        (6, "Text.\r\n  * Released under the M.I.T. licence!", "a"), (None, "All rights reserved.", "a"),
        (8, "é " + "\nAll Rights Reserved\nReleased under the MIT License", "a"), (9, LONG, "a"), (1, mit, "a"),
    ]
    out = rows_of(licence_scan(documents(spark, *rows)), "doc_id", "license", "line_licenses")
    assert [r[:2] for r in out] == sorted(
        [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (8, None), (9, None), (None, "reserved")],
        key=repr,
    )
    lines = {r[0]: r[2] for r in out}
    assert lines[8] == ["MIT", "reserved"] and lines[6] == [] and lines[9] == [] and lines[None] == ["reserved"]
    assert licence_scan(documents(spark)).count() == 0


def test_licence_files(spark):
    """Files as they are shipped: titles, notices of several lines and filled-in names."""
    wrapped = "Copyright (c) 2012-2021 Ann Author, Bob Builder,\nCarl Coder, Dora Doe,\nEve Editor\n\n"
    bsd3 = KNOWN["BSD-3-Clause"][0]
    named = bsd3.replace("the copyright holder nor", "Example Labs, Inc. nor")
    folder = Path(licences.__file__).parent / "licence_texts"
    files = {p.stem: p.read_text("utf-8") for p in folder.glob("*.txt")}
    mit, isc = KNOWN["MIT"][0], KNOWN["ISC"][0]
    cases = [
        ("MIT", "MIT License\n\nCopyright (c) 2022 Some Body\n\n" + mit),
        ("MIT", "The MIT License (MIT)\r\n=====\r\n\r\nCopyright 2020 Some Body\r\nAll rights reserved.\r\n\r\n" + mit),
        ("MIT", wrapped + mit), ("MIT", "Copyright Joined, Inc. and other contributors.\n" + mit),
        ("MIT", "// Copyright (c) A, B,\n// C and D\n//\n" + "\n".join("// " + x.strip() for x in mit.split("\n"))),
        ("ISC", "ISC License\n\nCopyright (c) 2004-2010 by Some Consortium (\"SC\")\n\n" + isc),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, Example Labs\nAll rights reserved.\n\n" + named),
        ("BSD-2-Clause", "Copyright 2019 The Authors.\n\n" + KNOWN["BSD-2-Clause"][1]), ("BSD-3-Clause", named),
        ("BSL-1.0", files["BSL-1.0"]), ("Unlicense", files["Unlicense"]), ("GPL-2.0", files["GPL-2.0"]),
        ("AGPL-3.0", "Copyright (C) 2020 A\n\n" + KNOWN["AGPL-3.0"][0]),
        *((name, text) for name, text in files.items()),
        (None, "Copyright law is a subject.\n\n" + mit + " and more"), (None, "MIT License"), (None, "Some words.\n\n" + mit),
        (None, "Copyright (c) 2020 A\n"), (None, "BSD 3-Clause License\n\n" + named + "\nNo use by robots."),
    ]
    rows = [(k, text, "a") for k, (_, text) in enumerate(cases)]
    out = {r.doc_id: r.license for r in licence_scan(documents(spark, *rows)).collect()}
    assert [(k, out[k]) for k in range(len(cases))] == [(k, name) for k, (name, _) in enumerate(cases)]


# --- 5 WARC


def test_archives(spark, tmp_path):
    body = "<p>" + "x" * 120 + "é</p>"
    rows = [(1, "http://a/\r\nx", body), (2, None, body), (3, "u", None), (4, "u", ""), (5, "u", "short"),
            (6, "u", "short"), (None, "u", body), (2, None, body), (7, "u", body + "\r\n\r\n" + body), (8, "u", "y" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(0))
    folder = str(tmp_path / "warc")
    index = write_archives(pages, folder, file_bytes=300)
    assert index.select("file").distinct().count() > 1
    out = read_records(index, folder)
    got = rows_of(out, "page_id", "payload_bytes", "record_type", "refers_to")
    long = len(body.encode())
    assert got == sorted(
        [(1, long, "response", None), (2, long, "revisit", 1), (2, long, "revisit", 1), (3, 0, "response", None),
         (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (None, long, "response", None),
         (7, 2 * long + 4, "response", None), (8, 500_000, "response", None)],
        key=repr,
    )
    kept = {r.page_id: bytes(r.payload) for r in out.collect()}
    assert kept[7] == (body + "\r\n\r\n" + body).encode() and kept[2] == b"" and kept[1] == body.encode()
    some = read_records(index.where("page_id = 7"), folder).collect()
    assert len(some) == 1 and bytes(some[0].payload) == kept[7]
    none = write_archives(pages.limit(0), folder)
    assert none.count() == 0 and read_records(none, folder).count() == 0


def test_a_record_parses_back():
    data = warc.record(1, "http://x/\n", b"a\r\n\r\nb", "d" * 64, None, None)
    found = parse_record(data)
    assert found["payload"] == b"a\r\n\r\nb" and found["headers"]["WARC-Target-URI"] == "http://x/%0A"
    with pytest.raises(ValueError):
        parse_record(data[:-4] + b"xxxx")


# --- 6 mixing


def mixed_by_hand(rows, weights=(1, 2, 3)):
    """target per source by repeated resharing."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s] + 1e-9}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else share * weight[s]
            left -= target[s]
        open_ -= over or set(open_)
    return target, sizes


def test_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), s) for i, s in enumerate(["b"] * 300 + ["a"] * 30 + ["É"] * 60 + [None] * 5)]
    rows += [(0, rows[0][1], "b"), (None, "x y", "a"), (None, None, "a"), (900, "", "empty")]
    out = mix_sources(documents(spark, *rows)).toPandas()
    target, sizes = mixed_by_hand(rows)
    assert len(out) == len(rows)
    named = {r[0]: r[2] for r in rows if r[0] is not None}
    out["source"] = [named.get(i, "a") if i == i else "a" for i in out["doc_id"]]
    for source, part in out.groupby("source", dropna=False):
        source = None if source != source else source
        assert np.allclose(part["target"], target[source]) and (part["source_size"] == sizes[source]).all()
        assert abs(part["taken"].sum() - target[source]) <= 20
        full = part[part["size"] > 0]
        times = (full["taken"] / full["size"]).tolist()
        assert set(times) <= {0, 1, 2, 3} and (not times or max(times) - min(times) <= 1)
    again = mix_sources(documents(spark, *rows).repartition(7)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert out.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    assert mix_sources(documents(spark)).count() == 0


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "one two three", "a" if i < 1500 else "b") for i in range(2000)]
    weights = spark.createDataFrame([(i, 9.0 if i % 2 else 1.0) for i in range(1990)] + [(1, None)], "doc_id long, w double")
    out = mix_sources(documents(spark, *rows), quality=weights, weights=(1, 1)).toPandas()
    part = out[(out["doc_id"] < 1500) & (out["taken"] > 0)]
    assert (part["doc_id"] % 2).mean() > 0.65


# --- 7 near copies


def test_shingles_equal_brute_force():
    texts = ["", " ", "a", "A b", "a b c d a b c", "é\x0bé é\x1cx\x85 y", LONG, "x" * 100_000, "a  b\tc\nd\re\x0cf"]
    lowered = [t.encode().lower() for t in texts]
    for n in (1, 3, 5):
        for text, found in zip(lowered, shingles.shingle_sets(lowered, n)):
            words = text.split()
            want = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
            assert len(found) == len(want) and (np.diff(found.astype(object)) > 0).all()


def test_near_copies_of_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [
        (5, base, "a"), (3, base.upper(), "a"), (9, base + " seventeen", None), (7, None, "a"), (8, "", "a"),
        (10, " \n", "a"), (11, "two words", "a"), (12, "TWO\twords", "a"), (None, base, "a"), (3, base.upper(), "a"),
        (13, "other text altogether here", "a"), (14, LONG, "a"), (15, LONG, "a"), (3, "a text of its own", "a"),
    ]
    out = rows_of(near_duplicates(documents(spark, *rows), words=3, percent=85), "doc_id", "n_shingles", "component_id", "kept")
    assert out == sorted(
        [(3, 14, 3, True), (3, 14, 3, True), (5, 14, 3, False), (9, 15, 3, False), (7, 0, 7, True), (8, 0, 8, True),
         (10, 0, 10, True), (11, 1, 11, True), (12, 1, 11, False), (None, 14, None, True), (13, 2, 13, True),
         (14, 2, 14, True), (15, 2, 14, False), (3, 3, 3, True)],
        key=repr,
    )
    assert near_duplicates(documents(spark)).count() == 0


def test_a_large_group_in_small_tiles(spark, monkeypatch):
    """Near copies of near copies, many tiles to a bucket: components as by brute force."""
    monkeypatch.setattr(minhash, "TILE_MEMBERS", 16)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(180):
        own = list(words)
        for k in rng.integers(0, 120, int(rng.integers(0, 9))):
            own[k] = f"x{rng.integers(0, 400)}"
        rows.append((i, " ".join(own), "a"))
    from tests.llm.test_llm_queries import near_components

    want, _ = near_components([r[:2] for r in rows], 3, 85)
    assert 1 < len(set(want.values())) < 180
    out = near_duplicates(documents(spark, *rows), words=3, percent=85).toPandas()
    assert dict(zip(out["doc_id"], out["component_id"])) == want


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, 90), (90, 7), (7, 7), (300, 299), (299, 300)]
    df = spark.createDataFrame(links + [(None, 5)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 1: 1, 90: 1, 7: 1, 299: 299, 300: 299}
    assert components(df.limit(0)).count() == 0


# --- 8 main text


def test_blocks():
    page = "<head><title>t</title></head><body><!-- x --><p>a&amp;b <b>c</b>d<p>e<br>f<script>g</script><div>h"
    assert [b.text for b in html_blocks.blocks(page)] == ["a&b cd", "e f", "h"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<") != [] and html_blocks.blocks("<p") == []
    assert [b.text for b in html_blocks.blocks("1 < 2 <p>x</p></nav></p>y")] == ["1 < 2", "x", "y"]


def test_labeller_on_unseen_layouts():
    assert block_training.accuracy(html_blocks.load_weights(), pages=150, seed=12) > 0.97


def test_articles_of_many_kinds():
    """Heads, numbered lists, tables, code, definitions and figures belong to an article."""
    sentence = "The river rises in the hills and runs for many miles before it meets the sea."
    kinds = (
        f"<h3>Early years</h3><p>{sentence}</p><h4>Sources</h4><p>{sentence}</p>",
        f"<p>{sentence}</p><ol><li>Take the first road.</li><li>Then the second one.</li></ol>",
        f"<p>{sentence}</p><table><tr><th>Town</th><th>People</th></tr><tr><td>Arden</td><td>512</td></tr></table>",
        f"<p>{sentence}</p><pre><code>for x in y: print(x)</code></pre><p>{sentence}</p>",
        f"<p>{sentence}</p><dl><dt>Ford</dt><dd>A place where one can cross a river.</dd></dl>",
        f"<p>{sentence}</p><figure><img src=a><figcaption>The ford in winter.</figcaption></figure>",
        f"<h2>Lists</h2><p>{sentence}</p><h5>More</h5><p>{sentence}</p><h6>Least</h6><p>{sentence}</p>",
        f"<h3>Part</h3><p>{sentence}</p><ol><li>One of them.</li></ol>" * 300,
    )
    around = '<nav><a href="/">Home</a></nav>%s<div class="cookie-notice">We use cookies.</div><footer>Contact us</footer>'
    weights = html_blocks.load_weights()
    for opening, closing in (("<article>", "</article>"), ('<div class="content">', "</div>")):
        for kind in kinds:
            body = f"{opening}<h1>On rivers</h1>{kind}{closing}"
            page = f"<html><body>{around % body}</body></html>"
            want = [b.text for b in html_blocks.blocks(body)]
            assert main_texts([page], weights)[0].split("\n") == want


def test_every_word_of_a_block_counts():
    """Blocks of equal length, path and first words differ if a later word does."""
    start = "word " * 40
    one, other = (html_blocks.Block(start + end, ("body", "div"), 0) for end in ("cookie", "custom"))
    assert (html_blocks.features([one]) != html_blocks.features([other])).any()
    long = html_blocks.features([html_blocks.Block(start * 500 + "end", ("body",), 0)])
    assert np.abs(long).max() < 4


def test_pages_in_a_batch_do_not_touch_each_other():
    grammar = block_training.Grammar(8)
    pages = [block_training.unmarked(grammar.page()[0]) for _ in range(20)]
    weights = html_blocks.load_weights()
    assert main_texts(pages, weights) == [main_texts([p], weights)[0] for p in pages]


def test_odd_pages(spark):
    long = "<article>" + "<p>A sentence with some words.</p>" * 3000 + "</article>"
    rows = [(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, long, None), (None, "<article><p>Só &eacute; so.</p></article>", "k")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = {r.page_id: r.text for r in extract_text(df).collect()}
    assert out[1] == out[2] == "" and out[None] == "Só é so." and out[3].count("\n") == 2999
    assert extract_text(df.limit(0)).count() == 0


# --- 9 fingerprints


def test_equal_substrings_share_names_at_any_offset():
    rng = np.random.default_rng(3)
    body = "".join(rng.choice(list("abcdefgh ijk"), 4000))
    names = fingerprints.parse([body, "zq" + body, "another start, " + body + " and end", "x" * 4000 + body])
    own = set(names[0].tolist())
    for other in names[1:]:
        assert len(own & set(other.tolist())) > 0.85 * len(own)
    again = fingerprints.parse([body])
    assert (again[0] == names[0]).all()


def test_likeness_of_short_texts():
    a, b = np.array([1, 9], np.uint64), np.array([2, 9], np.uint64)
    assert fingerprints.likeness(a, b) == pytest.approx(1 / 3)
    rng = np.random.default_rng(5)
    for size in (40, 120, 300, 900, 5000):
        near, far = [], []
        for _ in range(30):
            one, two = ("".join(rng.choice(list("abcdefgh ijklm"), size)) for _ in range(2))
            mine, edited, other = fingerprints.sketches([one, one[: size - size // 2] + two[: size // 2], two])
            near.append(fingerprints.likeness(mine, edited))
            far.append(fingerprints.likeness(mine, other))
            assert fingerprints.likeness(mine, mine) == 1.0
        # Half of the text is the same: a third of the names of both.
        assert 0.15 < np.mean(near) < 0.45 and np.mean(far) < 0.1
    # A long text beside its own short beginning shares few of the first names of both.
    whole, start = fingerprints.sketches([one, one[:200]])
    assert len(whole) == fingerprints.KEPT and fingerprints.likeness(whole, start) < 0.3


def test_labels_differ_between_neighbours():
    rng = np.random.default_rng(6)
    symbols = rng.integers(0, 2**63, 5000, np.uint64)
    for few in (symbols, symbols % np.uint64(3)):
        few = few[np.concatenate([[True], few[1:] != few[:-1]])]
        labels = fingerprints._labels(few, np.array([0]))
        assert labels.max() < 8 and (labels[1:] != labels[:-1]).all()


def test_fingerprints_of_odd_rows(spark):
    rows = [(5, None, "a"), (4, "", "a"), (3, "a", "a"), (2, LONG, "a"), (2, LONG, "a"), (None, "null id", None), (10**12, "ab" * 500, "a")]
    out = edited_fingerprints(documents(spark, *rows)).toPandas()
    assert len(out) == len(rows)
    by = {None if i != i else int(i): r for i, r in zip(out["doc_id"], out.to_dict("records"))}
    assert by[5]["fingerprint"] == by[4]["fingerprint"] == "" and by[5]["near_next"] == 1.0
    assert by[4]["near_next"] == 0.0 and by[5]["n_chars"] == 0
    import hashlib

    def edited(text, after):
        half = len(text) // 2
        return hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()

    assert by[None]["edited_sha256"] == edited("null id", "ab" * 500)
    assert by[10**12]["edited_sha256"] == edited("ab" * 500, "")
    assert by[3]["edited_sha256"] == edited("a", LONG)
    both = sorted(out[out["doc_id"] == 2]["edited_sha256"])
    assert both == sorted([edited(LONG, LONG), edited(LONG, "null id")])
    assert edited_fingerprints(documents(spark)).count() == 0
    alone = edited_fingerprints(documents(spark, (1, "alone here", "a"))).collect()
    assert alone[0].near_next == 1.0
    assert fingerprint(documents(spark, (1, None, "a")), name="lang").collect()[0].lang == ""


def test_blocks_of_ids_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 4)
    monkeypatch.setattr(fingerprints, "BLOCKS", 3)
    rng = np.random.default_rng(9)
    ids = sorted({int(i) for i in rng.integers(-50, 400, 90)}, reverse=True)
    rows = [(i, f"text number {i} with a few more words", "a") for i in ids]
    out = edited_fingerprints(documents(spark, *rows)).toPandas().set_index("doc_id")
    import hashlib

    for k, (i, text, _) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        want = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert out["edited_sha256"][i] == want


# --- 10 pieces

needs_model = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")


@needs_model
def test_viterbi_is_the_best_cut():
    """Against a plain search over all cuts of short words."""
    model = load_pieces(TOKENIZER)
    encoder = pieces.Encoder(model)
    scores = {}
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    for i in range(reader.get_piece_size()):
        if not (reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i)):
            scores[reader.id_to_piece(i)] = reader.get_score(i)

    def best(word):
        sums = [0.0] + [-float("inf")] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                piece = scores.get(word[start:end])
                if piece is None and end - start == 1:
                    piece = encoder.unknown_score
                if piece is not None:
                    sums[end] = max(sums[end], sums[start] + piece)
        return sums[-1]

    for word in ["▁hello", "▁▁the", "therehation", "▁été", "naïve", "▁中文字", "x", "▁"]:
        ids = encoder.cut(word)
        assert b"".join(model.surface[i] for i in ids).decode().replace(" ", "▁") == word
        assert not any(reader.is_byte(i) for i in ids)
        assert sum(model.scores[i] for i in ids) == best(word)


@needs_model
def test_words_cut_together_equal_words_cut_alone():
    encoder = pieces.Encoder(load_pieces(TOKENIZER))
    rng = np.random.default_rng(8)
    letters = list("abcdehilnorstéü中\U0001f600▁.,\x00\ue000") + ["the", "ing", "tion"]
    words = ["".join(rng.choice(letters, int(rng.integers(1, 40)))) for _ in range(600)] + ["y" * 200]
    found = [np.frombuffer(ids, np.int32).tolist() for ids in encoder.cut_many(words)]
    assert found == [encoder.cut(w) for w in words]


@needs_model
def test_every_text_comes_back():
    model = load_pieces(TOKENIZER)
    encoder = pieces.Encoder(model, remembered=50)
    texts = ["", " ", "   x  y ", "\t\n\r\x00", "▁", "a▁b ▁", "\U0001f600 é 中", "﷐\U0010ffff", LONG, "z" * 20_000]
    for text in texts:
        assert decode_ids(model, encoder.encode(text)) == text
    assert encoder.encode(None) == [] and decode_ids(model, [0, 1, 2, 10**6, -1]) == "��"


@needs_model
def test_trie_finds_exactly_its_words():
    words = {w.encode(): k for k, w in enumerate(["a", "ab", "abc", "b", "é", "ëx", "zz\xff"])}
    trie = pieces.DoubleArray.build(words)

    def find(word):
        node = 0
        for byte in word:
            after = int(trie.base[node]) + byte + 1
            if after >= len(trie.check) or trie.check[after] != node:
                return -1
            node = after
        return int(trie.value[node])

    assert all(find(w) == k for w, k in words.items())
    assert find(b"") == find(b"ac") == find(b"zz") == find(b"c") == -1


@needs_model
def test_pieces_of_odd_rows(spark):
    model = load_pieces(TOKENIZER)
    docs = documents(spark, (1, None, "a"), (None, "", "a"), (2, LONG, None), (2, LONG, None))
    out = decode_pieces(encode_pieces(docs, model, ids="lang"), model, ids="lang").collect()
    assert sorted((r.doc_id or 0, len(r.lang), len(r.decoded)) for r in out)[:2] == [(0, 0, 0), (1, 0, 0)]
    assert all(r.decoded == (r.text or "") and r.taken == 7 for r in out)
    assert encode_pieces(docs.limit(0), model).count() == 0


# --- rows that share an id, caps


def test_vectors_that_share_an_id_stay_apart(spark):
    """Labels never meet, also not over an id that both have; chains over several labels."""
    schema = "vec_id long, embedding array<float>, label string"
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.1], "b")]
    found = near_vectors(spark.createDataFrame(rows, schema), threshold=0.93)
    assert rows_of(found) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.1], "a"), (3, [0.1, 1.0], "a"), (0, [0.0, -1.0], "a")]
    found = near_vectors(spark.createDataFrame(rows, schema), threshold=0.93)
    assert [r[1] for r in rows_of(found)] == [0, 1, 1, 1, 1]


@pytest.mark.parametrize("seed", range(2))
def test_links_equal_brute_force_over_labels_and_repeated_ids(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for label in ("a", "b", None):
        chain = np.cumsum(np.full(40, 0.2))
        angles = np.concatenate([chain, rng.uniform(20, 26, 30)])
        rows += [(int(rng.integers(0, 60)), [float(np.cos(t)), float(np.sin(t)), 0.01], label) for t in angles]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), threshold=0.97)
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    n = len(rows)
    links = [
        [j for j in range(n) if j != i and rows[i][2] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.97]
        for i in range(n)
    ]
    smallest = [r[0] for r in rows]
    while True:
        after = [min([smallest[i]] + [smallest[j] for j in links[i]]) for i in range(n)]
        if after == smallest:
            break
        smallest = after
    want = sorted((rows[i][0], len(links[i]), smallest[i], rows[i][0] == smallest[i]) for i in range(n))
    assert sum(w[1] for w in want) > 100 and sorted(tuple(r) for r in found.collect()) == want


def test_a_holder_with_a_long_name(spark):
    text = next(t for t in KNOWN["BSD-3-Clause"] if "contributors may" in " ".join(t.lower().split()))
    import re

    holder = "the very long name of " + "a company " * 110
    named = re.sub(r"(?is)neither the name of .*? nor", f"Neither the name of {holder} nor", text, count=1)
    assert named != text and len(named) > len(text) + 900
    docs = spark.createDataFrame([(1, named), (2, named + " and more words")], "doc_id long, text string")
    found = {r["doc_id"]: r["license"] for r in licence_scan(docs).collect()}
    assert found == {1: "BSD-3-Clause", 2: None}


def test_the_training_sample_has_one_row_per_id(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(200):
        good = i % 2
        for copy in range(3):
            words = rng.choice(["word", "text", "line"] if good else ["x", "!!", "##"], 40)
            rows.append((i, " ".join(words)))
        labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    first, second = (train_quality(d, known, sample=50) for d in (docs.repartition(1), docs.repartition(9)))
    assert np.array_equal(first.value, second.value) and np.array_equal(first.threshold, second.threshold)


def test_as_many_readers_as_the_archives_have_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 2000)
    rng = np.random.default_rng(7)
    rows = [(i, f"http://a/{i}", rng.bytes(900).hex()) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = warc.archive_folder(spark)
    index = write_archives(pages, folder)
    size = sum(r["length"] for r in index.collect())
    records = read_records(index, folder)
    assert records.rdd.getNumPartitions() == -(-size // 2000) > 10
    assert records.count() == 60
