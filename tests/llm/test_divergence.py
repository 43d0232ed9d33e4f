"""The divergence audit against plain Python (its SQL is compared in test_llm_queries.py)."""

from __future__ import annotations

import collections
import random
import re

import pytest

from labmesh.llm.divergence import source_divergence
from tests.conftest import rows_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, value string, Term int"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, g, s, "x", 1) for k, (t, g, s) in enumerate(rows)], DOC)


def plain(rows, least=3, top=200):
    docs = collections.defaultdict(lambda: collections.defaultdict(list))
    for text, lang, source in rows:
        docs[lang or ""][source or ""].append(TERM.findall((text or "").translate(LOWER)))
    out = []

    def f(p, q):
        return (p - q) * (p - q) // q

    for lang, sources in docs.items():
        frequency = collections.Counter(t for s in sources.values() for d in s for t in set(d))
        kept = {t for t, n in frequency.items() if n >= least}
        counts = {s: collections.Counter(t for d in ds for t in d if t in kept) for s, ds in sources.items()}
        whole = sum(counts.values(), collections.Counter())

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in sources:
            pairs = [(b, sum(f(p[s][t], p[b][t]) for t in kept)) for b in sources if b != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found[:most], start=1)]
    return sorted(out, key=repr)


def corpus(seed, n=120, sources=7, words=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abÉçz漢🙂") + str(rng.choice("xyzß")) * rng.randint(1, 4) for _ in range(words)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice([None, "", *map(str, range(sources))])
        picked = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["", "A b. ", "1-2 "]) + " ".join(picked), lang, source))
    return rows


@pytest.mark.parametrize(
    "options",
    [{}, {"block": 3, "tile": 2}, {"shard": 10, "top_terms": 5}],
    ids=["as one", "blocks and tiles", "shards"],
)
def test_against_plain_python(spark, options):
    rows = corpus(1)
    found = rows_of(source_divergence(documents(spark, rows), **options))
    assert found == plain(rows, top=options.get("top_terms", 200))


def test_odd_rows(spark):
    """NULL and empty texts, groups without terms, a lang that keeps nothing, ties, a very long text."""
    rows = [
        (None, "a", "x"),
        ("", "a", "y"),
        ("same Same sAme " * 30_000, "a", "z"),
        ("same other", "a", "w"),
        ("same other", "a", "w"),
        ("other", "a", None),
        ("lonely words", "b", "x"),
        ("0 1 2", "b", "y"),
        ("12", "c", "x"),
    ]
    found = rows_of(source_divergence(documents(spark, rows)))
    assert found == plain(rows)
    assert [r for r in found if r[0] == "b"] == [("b", "x", "pair", "y", 0, 1), ("b", "y", "pair", "x", 0, 1)]


def test_no_documents(spark):
    out = source_divergence(documents(spark, []))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.collect() == []


def test_a_source_with_a_third_of_all_rows(spark):
    rows = corpus(2, n=60) + [("hot words are here", "en", "hot")] * 60 + [("hot", "en", "9")] * 3
    assert rows_of(source_divergence(documents(spark, rows))) == plain(rows)


def test_terms_of_texts():
    import pyarrow as pa

    from labmesh.llm.divergence import hashes, terms_of

    texts = ["", None, "Ab c", "É\x00ß漢", "x", "y9z", "\x7f{", "🙂A", "@[`a", None, "q"]
    for given in (texts, texts[3:], [], [None], ["", ""]):
        array = pa.array(["dropped", *given], pa.string()).slice(1)
        terms, upto = terms_of(array)
        want = [TERM.findall((t or "").translate(LOWER)) for t in given]
        assert terms.to_pylist() == [t for w in want for t in w]
        assert upto.tolist() == [sum(map(len, want[: k + 1])) for k in range(len(want))]
        assert len(hashes(terms)) == len(terms)
    terms, _ = terms_of(pa.array(["ab ba ab c abc", "ab"]))
    a, b, again, *_, last = hashes(terms).tolist()
    assert a == again == last != b


def test_terms_are_dealt_by_blocks_of_documents(spark):
    """What the fits and the sums read grows with the different terms, not with the documents."""
    from labmesh.llm.divergence import _dealt

    rows = [(" ".join(f"w{'xyz'[k % 3]}{chr(97 + j)}" for j in range(20)), "en", "s") for k in range(300)]
    docs = documents(spark, rows).select("lang", "source", "text").coalesce(1)
    dealt = _dealt(docs, {"en": (0, 1)}, 3)
    entries = {part: sum(len(t) for t, p in dealt.select("terms", "part").collect() if p == part) for part in ("fit", "sum")}
    assert entries == {"fit": 3 * (60 + 1), "sum": 60}
    assert rows_of(source_divergence(documents(spark, rows))) == plain(rows)


def test_a_block_holds_what_its_documents_hold():
    import pyarrow as pa

    from labmesh.llm.divergence import LARGEST, _Block

    rows = [(t or "", lang or "", source or "") for t, lang, source in corpus(3)]
    block = _Block()
    for at in range(0, len(rows), 7):
        columns = [pa.array(c, pa.string()) for c in zip(*rows[at : at + 7])]
        block.add(pa.RecordBatch.from_arrays(columns, names=["text", "lang", "source"]))
        if at % 3 == 0:
            block.merge()
    block.merge()
    documents, counts = collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        found = TERM.findall(text.translate(LOWER))
        documents.update((lang, t) for t in set(found))
        counts.update(((lang, source), t) for t in found)
    terms = block.terms.to_pylist()
    for names, held, want in ((block.langs, block.documents, documents), (block.groups, block.counts, counts)):
        name = list(names)
        keys, numbers = (x.tolist() for x in held)
        assert {(name[k >> 32], terms[k & LARGEST]): n for k, n in zip(keys, numbers)} == want
