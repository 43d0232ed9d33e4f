"""Source divergence audit: how unlike the sources of a language use its words.

Per language a CountVectorizer, with a least number of documents and the largest
vocabSize there is, turns documents into exact sparse count vectors, which are
summed per source in tasks, as a Summarizer would with dense ones. A fit holds its
vocabulary on the driver, so the terms of a language are dealt by hash into as many
shards as keep a fit near a stated size; small languages have one. Sums, smoothed shares and divergences are whole numbers.

Sources are compared from their sparse counts, a block of terms at a time: terms that
one of a pair has are evaluated, all the others add one product. Sources are dealt
into tiles, so a task holds the terms of a block in two tiles and returns one row per
pair of sources, never one per term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from labmesh.llm.common import by_bytes, in_groups, stored
from labmesh.sources.scratch import fresh_folder

UNIT = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200
# Different terms that one fit may see, as estimated; its vocabulary passes the driver.
SHARD = 500_000
# Shards up to this number are written without a shuffle, each task into all of them.
FEW = 64
# Terms of a block and sources of a tile that are compared at once.
BLOCK = 2048
TILE = 256
# Counts that a task holds before it passes them on.
HELD = 2 << 20
# Bytes of text whose terms are dealt at once.
STEP = 4 << 20
# One in so many hash values is counted to estimate the number of different terms.
ESTIMATE = 64
# In every document, so that no fit is without a vocabulary; a digit is no term.
ALWAYS = "0"
# Rows for the fits and rows for the sums.
FIT, SUM = "fit", "sum"
LARGEST = 2**31 - 1

# A term is a run of letters and of bytes beyond ASCII; A-Z count as a-z, all else is 0.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[0x41:0x5B] += 32
_LETTERS[0x00:0x41] = _LETTERS[0x5B:0x61] = _LETTERS[0x7B:0x80] = 0
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def terms_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of texts one after another, and how many there are up to the end of each text."""
    texts = pa.concat_arrays([texts.fill_null("")])
    count = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32, count + 1, texts.offset * 4).astype(np.int64)
    if not count or ends[-1] == ends[0]:
        return pa.array([], pa.string()), np.zeros(count, np.int64)
    letters = _LETTERS[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends -= ends[0]
    inside = letters != 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    # A term doesn't go on in the next text.
    first = ends[:-1][(ends[:-1] < ends[1:]) & (ends[:-1] > 0)]
    begins[first] = inside[first]
    stops[first - 1] = inside[first - 1]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops)
    offsets = np.append(0, np.cumsum(stops - begins + 1)).astype(np.int32)
    flat = letters[inside]
    terms = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(flat))
    upto = np.searchsorted(begins, ends[1:])
    return terms, upto


def hashes(terms: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each term: a polynomial in its bytes, mixed."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1, terms.offset * 4)
    flat = np.frombuffer(terms.buffers()[2], np.uint8)[: offsets[-1]].astype(np.uint64) if len(terms) else np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(flat), _PLACE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat + np.uint64(1)) * powers)])
    back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(flat), _BACK))])
    found = (sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))


def _coded(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Per term of the texts its code and its text's position, and between them the terms by code."""
    terms, upto = terms_of(texts)
    row = np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))
    coded = terms.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, row


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)); in decimals where 64 bits don't hold the product."""
    below = total + terms
    small = F.call_function("div", (count + F.lit(1)) * F.lit(UNIT).cast("long"), below)
    above = (count + F.lit(1)).cast("decimal(27,0)") * F.lit(UNIT).cast("decimal(10,0)")
    large = F.call_function("div", above, below.cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.when(count < 9 * 10**9, small).otherwise(large)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q); shares are at most UNIT + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def _different(docs: DataFrame) -> dict[str, int]:
    """About how many different terms each language has; it only decides how they are dealt."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, set[int]] = {}
            for part in by_bytes([batch], "text", STEP):
                code, terms, row = _coded(part.column("text"))
                values = hashes(terms)
                few = np.flatnonzero((values % np.uint64(ESTIMATE) == 0)[code])
                for lang in part.column("lang").unique().to_pylist():
                    found.setdefault(lang, set())
                langs = part.column("lang").take(pa.array(row[few])).to_pylist()
                for lang, value in zip(langs, values[code[few]].tolist()):
                    found[lang].add(value >> 1)
            # One more row, which counts nothing, for a language without any.
            rows = [(lang, value) for lang, held in found.items() for value in [None, *held]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                names=["lang", "hash"],
            )

    seen = docs.select("lang", "text").mapInArrow(sampled, "lang string, hash long")
    counted = seen.groupBy("lang").agg(F.count_distinct("hash").alias("n"))
    return {row["lang"]: row["n"] * ESTIMATE for row in counted.collect()}


def _merged(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, total = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(key, kind="stable")
    key, total = key[order], total[order]
    if not len(key):
        return key, total
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.add.reduceat(total, starts)


def _tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, in order, and how often each occurs."""
    key = np.sort(key)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[starts], np.diff(starts, append=len(key))


class _Block:
    """The terms of documents that a task has read: how many documents of a language
    have each, and how often each source has it. A key is a number and a term's code."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.terms = pa.array([], pa.string())
        self.documents = self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple] = []
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        code, terms, row = _coded(part.column("text"))
        groups = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist()))
        lang = np.array([self.langs.setdefault(name, len(self.langs)) for name, _ in groups])
        group = np.array([self.groups.setdefault(name, len(self.groups)) for name in groups])
        one, _ = _tally(row << 32 | code)
        documents = _tally(lang[one >> 32] << 32 | one & LARGEST)
        counts = _tally(group[row] << 32 | code)
        self.new.append((terms, documents, counts))
        self.size += len(documents[0]) + len(counts[0])

    def merge(self) -> None:
        parts = [(self.terms, self.documents, self.counts), *self.new]
        coded = pa.concat_arrays([terms for terms, _, _ in parts]).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        codes = np.split(codes, np.cumsum([len(terms) for terms, _, _ in parts])[:-1])
        self.terms, self.new = coded.dictionary, []
        self.documents, self.counts = (
            _merged(
                [p[k][0] >> 32 << 32 | code[p[k][0] & LARGEST] for p, code in zip(parts, codes)],
                [p[k][1] for p in parts],
            )
            for k in (1, 2)
        )
        self.size = len(self.documents[0]) + len(self.counts[0])

    def rows(self, places: dict[str, tuple[int, int]], min_documents: int) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        values = hashes(self.terms)
        start, shards = np.array([places[name] for name in self.langs]).T
        own = np.array([self.langs[name] for name, _ in self.groups])
        sources = pa.array([name for _, name in self.groups], pa.string())
        words = pa.concat_arrays([self.terms, pa.array([ALWAYS])])

        def gathered(lang: np.ndarray, kind: np.ndarray, weight: np.ndarray, code: np.ndarray, always: bool) -> tuple:
            """Terms of one place, kind and weight as a row."""
            place = start[lang] + (values[code] % shards[lang].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((weight, kind, place))
            place, kind, weight, code = place[order], kind[order], weight[order], code[order]
            new = (place[1:] != place[:-1]) | (kind[1:] != kind[:-1]) | (weight[1:] != weight[:-1])
            starts = np.flatnonzero(np.append(True, new))
            ends = np.append(starts, len(code))
            if always:
                code, ends = np.insert(code, starts, len(words) - 1), ends + np.arange(len(ends))
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), words.take(pa.array(code)))
            return place[starts], kind[starts], weight[starts], lists

        key, documents = self.documents
        copies = np.minimum(documents, min_documents)
        level = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        key = np.repeat(key, copies)
        place, _, weight, terms = gathered(key >> 32, level, np.ones_like(key), key & LARGEST, always=True)
        yield _row_batch(FIT, place, pa.nulls(len(place), pa.string()), weight, terms)
        key, weight = self.counts
        place, group, weight, terms = gathered(own[key >> 32], key >> 32, weight, key & LARGEST, always=False)
        yield _row_batch(SUM, place, sources.take(pa.array(group)), weight, terms)


def _row_batch(part: str, place: np.ndarray, source: pa.Array, weight: np.ndarray, terms: pa.ListArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(place, pa.int64()), pa.array([part] * len(place), pa.string()), source, pa.array(weight, pa.int64()), terms],
        names=["place", "part", "source", "weight", "terms"],
    )


def _dealt(docs: DataFrame, places: dict[str, tuple[int, int]], min_documents: int) -> DataFrame:
    """place, part, source, weight, terms: the terms of each shard, by blocks of documents.

    `places` has the first place of a language and how many shards it has. A block is what
    a task holds at once. Part `fit` has a row for the terms in one and more documents of
    the block, one for those in two and more, and so on to `min_documents`: over all
    blocks a term is in that many rows exactly if it is in that many documents. Part `sum`
    has the terms of a source in the block, with a row for those it has once, one for
    those it has twice, and so on: the vector of its documents is their sum by weight.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for part in by_bytes(batches, "text", STEP):
            block.add(part)
            if block.size > HELD:
                block.merge()
                if block.size > HELD * 3 // 4:
                    yield from block.rows(places, min_documents)
                    block = _Block()
        block.merge()
        yield from block.rows(places, min_documents)

    schema = "place long, part string, source string, weight long, terms array<string>"
    dealt = docs.select("lang", "source", "text").mapInArrow(deal, schema)
    path = fresh_folder(docs.sparkSession, "divergence-terms")
    if sum(shards for _, shards in places.values()) > FEW:
        dealt = dealt.hint("rebalance", "place", "part")
    dealt.write.partitionBy("place", "part").parquet(path)
    schema = "source string, weight long, terms array<string>, place long, part string"
    return docs.sparkSession.read.schema(schema).parquet(path)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weighted sparse vectors of one place by source: source, id, count."""
    names: dict[str, int] = {}
    place = 0
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    waiting = 0

    def rows(key: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        sources = pa.array(list(names), pa.string())
        for start in range(0, len(key), 65_536):
            part = slice(start, start + 65_536)
            yield pa.RecordBatch.from_arrays(
                [
                    sources.take(pa.array(key[part] >> 32)),
                    pa.array((key[part] & LARGEST) + (place << 31)),
                    pa.array(total[part]),
                ],
                names=["source", "id", "count"],
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column("place")[0].as_py()
        indices, values = batch.column("indices"), batch.column("values")
        code = np.array([names.setdefault(s, len(names)) for s in batch.column("source").to_pylist()], np.int64)
        lengths = pc.list_value_length(indices).to_numpy(zero_copy_only=False)
        weight = np.repeat(batch.column("weight").to_numpy(), lengths)
        keys.append((np.repeat(code, lengths) << 32) | indices.flatten().to_numpy().astype(np.int64))
        sums.append(values.flatten().to_numpy().astype(np.int64) * weight)
        waiting += len(weight)
        if waiting > HELD:
            key, total = _merged(keys, sums)
            if len(key) > HELD // 2:
                yield from rows(key, total)
                names, key, total = {}, key[:0], total[:0]
            keys, sums, waiting = [key], [total], len(key)
    yield from rows(*_merged(keys, sums))


def _counts(rows: DataFrame, lang: str, place: int, min_documents: int) -> tuple[str, str, int] | None:
    """Kept terms by number, their counts per source and task, and how many terms are kept.

    The first two are paths of tables. Numbers hold for all places, and the place is read
    from the rows and not from the plan, so that all shards share their generated code.
    """
    spark = rows.sparkSession
    fit = rows.filter(F.col("part") == FIT).select("terms")
    # A term is in a row once: with fewer rows none is kept.
    if len(fit.select(F.lit(1)).limit(min_documents).collect()) < min_documents:
        return None
    model = CountVectorizer(
        inputCol="terms", outputCol="vector", minDF=float(min_documents), vocabSize=LARGEST
    ).fit(fit)
    vocabulary = pa.array(model.vocabulary, pa.string())
    ids = pa.array(np.arange(len(vocabulary)) + (place << 31))
    kept = pa.table({"id": ids, "lang": pa.array([lang] * len(ids), pa.string()), "term": vocabulary})
    kept = kept.filter(pc.not_equal(vocabulary, ALWAYS))
    if not len(kept):
        return None
    names = fresh_folder(spark, "divergence-names")
    spark.createDataFrame(kept).write.parquet(names)
    vector = F.unwrap_udt("vector")
    vectors = model.transform(rows.filter(F.col("part") == SUM)).select(
        "place", "source", "weight", vector["indices"].alias("indices"), vector["values"].alias("values")
    )
    sums = vectors.mapInArrow(_summed, "source string, id long, count long")
    path = fresh_folder(spark, "divergence-sums")
    sums.write.parquet(path)
    return names, path, len(kept)


def compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Per pair (a, b) of groups of two tiles: the sum over terms of the block that one of
    them has, and how many these are.

    Rows with id -1 state a group's share of a term that it doesn't have.
    """
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    tile, p, group = (rows[c].to_numpy(np.int64) for c in ("tile", "p", "group"))
    plain = rows["id"].to_numpy() < 0
    first = np.sort(group[plain & (tile == i)])
    second = np.sort(group[plain & (tile == j)])
    base = dict(zip(group[plain].tolist(), p[plain].tolist()))
    base_b = np.array([base[b] for b in second.tolist()], np.int64)
    group, tile, p = group[~plain], tile[~plain], p[~plain]
    _, term = np.unique(rows["id"].to_numpy()[~plain], return_inverse=True)
    on_b = np.flatnonzero(tile == j)
    on_b = on_b[np.argsort(group[on_b], kind="stable")]
    b_place, b_term, b_p = np.searchsorted(second, group[on_b]), term[on_b], p[on_b]
    starts = np.searchsorted(b_place, np.arange(len(second) + 1))
    on_a = np.flatnonzero(tile == i)
    on_a = on_a[np.argsort(group[on_a], kind="stable")]
    bounds = np.searchsorted(group[on_a], np.append(first, np.iinfo(np.int64).max))
    width = term.max(initial=-1) + 1
    values, seen = [], []
    for k, a in enumerate(first.tolist()):
        own = on_a[bounds[k] : bounds[k + 1]]
        row = np.full(width, -1)
        row[term[own]] = np.arange(len(own))
        q = np.tile(base_b, (len(own), 1))
        at = row[b_term]
        both = at >= 0
        q[at[both], b_place[both]] = b_p[both]
        apart = p[own][:, None] - q
        value = (apart * apart // q).sum(axis=0)
        # Terms that b alone has.
        apart = base[a] - b_p
        alone = np.where(both, 0, apart * apart // b_p)
        sums = np.concatenate([[0], np.cumsum(alone)])
        number = np.concatenate([[0], np.cumsum(~both)])
        values.append(value + sums[starts[1:]] - sums[starts[:-1]])
        seen.append(len(own) + number[starts[1:]] - number[starts[:-1]])
    out = pd.DataFrame(
        {
            "a": np.repeat(first, len(second)),
            "b": np.tile(second, len(first)),
            "value": np.concatenate([np.zeros(0, np.int64), *values]),
            "seen": np.concatenate([np.zeros(0, np.int64), *seen]),
        }
    )
    return out[out["a"] != out["b"]]


def _pairs(entries: DataFrame, groups: DataFrame, block: int, tile: int) -> DataFrame:
    """lang, source, item, value for all pairs of sources of a language."""
    tiles = F.ceil(F.col("sources") / tile).cast("int")
    blocks = F.ceil(F.col("terms") / block).cast("int")
    own = F.pmod(F.xxhash64("group"), tiles).cast("int")
    places = F.sequence(F.lit(0), tiles - 1)
    keys = F.concat(
        F.transform(places, lambda x: F.struct(own.alias("i"), x.alias("j"))),
        F.transform(F.filter(places, lambda x: x != own), lambda x: F.struct(x.alias("i"), own.alias("j"))),
    )
    columns = ["number", "group", own.alias("tile"), "id", "p", "block", F.explode(keys).alias("key")]
    having = entries.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).select(*columns)
    lacking = (
        groups.filter("terms > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("id", F.lit(-1).cast("long"))
        .withColumn("p", F.col("p0"))
        .select(*columns)
    )
    rows = having.unionByName(lacking).select("number", "key.i", "key.j", "block", "group", "tile", "id", "p")
    parts = in_groups(
        rows, ["block", "number", "i", "j"], compare_block, "a long, b long, value long, seen long"
    )
    sums = parts.groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = groups.select("lang", F.col("group").alias("a"), "source", "terms", "p0")
    other = groups.select("lang", F.col("group").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = one.join(other, "lang").filter(F.col("a") != F.col("b"))
    unseen = F.col("terms") - F.coalesce("seen", F.lit(0))
    rest = F.when(F.col("terms") > 0, unseen * divergence(F.col("p0"), F.col("q0"))).otherwise(0)
    return pairs.join(sums, ["a", "b"], "left").select(
        "lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).alias("value")
    )


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    shard: int = SHARD,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """lang, source, part, item, value, rank: sources compared, and terms that set one apart.

    Part `pair` has every other source of the language with the divergence summed
    over all kept terms; part `term` the terms that a source uses more than its
    language does, down to rank `top_terms`. Ranks go by falling value, then item.

    NULL text, lang and source are ''. Repeated rows are documents of their own. A
    language that keeps no term has pairs with value 0 and no terms; sources without
    terms are compared like all others. A source alone in its language has no pairs.
    An empty table gives no rows. Texts count whole; other columns are not looked at.
    Runs the counts when called, one fit per language and shard.
    """
    spark = docs.sparkSession

    def plain(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    places, at = {}, 0
    for name, different in sorted(_different(rows).items()):
        places[name] = (at, max(1, math.ceil(different / shard)))
        at += places[name][1]
    dealt = _dealt(rows, places, min_documents)
    names, tables, kept = [], [], []
    for name, (start, shards) in places.items():
        found = 0
        for place in range(start, start + shards):
            counted = _counts(dealt.filter(F.col("place") == place), name, place, min_documents)
            if counted is None:
                continue
            names.append(counted[0])
            tables.append(counted[1])
            found += counted[2]
        kept.append((name, found))
    schema = "lang string, source string, id long, term string, count long, lang_count long"
    if tables:
        parts = spark.read.schema("source string, id long, count long").parquet(*tables)
        # Dealt by term once: that serves the sums, the totals of terms and their names.
        counts = parts.repartition("id").groupBy("id", "source").agg(F.sum("count").alias("count"))
        counts = counts.withColumn("lang_count", F.sum("count").over(Window.partitionBy("id")))
        counts = counts.join(spark.read.schema("id long, lang string, term string").parquet(*names), "id")
        counts = stored(counts, "divergence")
    else:
        counts = spark.createDataFrame([], schema)
    vocabulary = spark.createDataFrame([(*k, n) for n, k in enumerate(kept)], "lang string, terms long, number int")

    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    every = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    every = every.fillna(0, ["total", "terms"])
    per_lang = every.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("total").alias("lang_total"))
    groups = every.join(per_lang, "lang").withColumn(
        "p0",
        F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))),
    )
    # Numbers of groups hold once they are written.
    groups = stored(groups.withColumn("group", F.monotonically_increasing_id()), "divergence-groups")

    entries = (
        counts.join(groups.drop("p0"), ["lang", "source"])
        .withColumn("p", share(F.col("count"), F.col("total"), F.col("terms")))
        .withColumn("q", share(F.col("lang_count"), F.col("lang_total"), F.col("terms")))
        .select("lang", "source", "group", "number", "id", "term", "p", "q", "terms", "sources")
    )
    def by_value(*group: str) -> WindowSpec:
        return Window.partitionBy(*group).orderBy(F.desc("value"), "item")

    more = entries.filter("p > q").select(
        "group", "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")
    )
    apart = more.withColumn("rank", F.row_number().over(by_value("group"))).filter(F.col("rank") <= top_terms)
    pairs = (
        _pairs(entries, groups, block, tile)
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(by_value("lang", "source")))
    )
    return pairs.unionByName(apart.drop("group"))
