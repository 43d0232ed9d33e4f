"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing: a symbol is compared
with the one before it, the lowest differing bit gives a label, and after a few
rounds the labels are below 8 while neighbours still differ. Phrases begin where a label is a
local minimum, so where they begin depends on a few symbols around and not on the
offset. A phrase is named by a hash of its symbols, the names form the next, about
three times shorter sequence, and so on until one name is left. Equal substrings
therefore get equal names but for a few phrases at their ends.

The fingerprint keeps the first KEPT names in an order that all texts share: those
of the third level and above by hash, then those of the second, then of the first.
A text with fewer names keeps all of them. Likeness is the share of common names,
exact for two texts that keep all and else estimated from the first KEPT of both,
with a standard error of at most 1/16. All texts of a batch are parsed at once in
numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labmesh.llm.common import stored
from labmesh.llm.shingles import mixed

KEPT = 64
LEVEL = 3
BATCH = 1 << 19
BLOCK = 2048
BLOCKS = 4096

_random = np.random.default_rng(31)
_PLACE = _random.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_LEVEL = _random.integers(1, 2**63, 128, np.uint64)
# Bits of a name that hold its tier: 0 from LEVEL on, 1 and 2 for the levels below.
_TIER = np.uint64(2)


def _next_labels(width: int) -> np.ndarray:
    """Label of a pair (before, own) of labels below `width`, as a table."""
    before, own = np.meshgrid(np.arange(width), np.arange(width), indexing="ij")
    differ = before ^ own
    lowest = differ & -differ
    place = np.where(lowest > 0, np.log2(np.maximum(lowest, 1)).astype(int), 0)
    return (2 * place + ((own >> place) & 1)).astype(np.uint8).ravel()


_SECOND = _next_labels(128)
_THIRD = _next_labels(16)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 in which neighbours of one text differ if their symbols do."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    # A text begins after a symbol that differs from its own in every bit.
    before[first] = ~symbols[first]
    differ = symbols ^ before
    lowest = differ & (~differ + np.uint64(1))
    place = np.frexp(lowest.astype(np.float64))[1].astype(np.uint8) - np.uint8(1)
    bit = ((symbols >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    labels = place * np.uint8(2) + bit
    for table, width in ((_SECOND, 128), (_THIRD, 16), (_THIRD, 16)):
        before_label = np.empty_like(labels)
        before_label[1:] = labels[:-1]
        before_label[first] = labels[first] ^ 1
        labels = table[before_label.astype(np.uint16) * width + labels]
    return labels


def _named(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for every phrase from its symbols in order."""
    lengths = np.diff(starts, append=len(symbols))
    place = np.arange(len(symbols)) - np.repeat(starts, lengths)
    # Phrases are short; should one be longer, its places wrap around with another factor.
    turn = (place >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weighed = mixed(symbols + _PLACE[place & 63] + turn) * _PLACE[place & 63]
    return mixed(np.add.reduceat(weighed, starts) + lengths.astype(np.uint64))


def _firsts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def parse(texts: Sequence[str]) -> list[np.ndarray]:
    """Per text the distinct names of its phrases from LEVEL on, and below it up to KEPT names.

    The two highest bits of a name say how far below LEVEL its phrase is.
    """
    found: list[list[np.ndarray]] = [[] for _ in texts]
    levels: list[list[np.ndarray]] = [[] for _ in texts]
    # Half surrogates cannot occur in a stored text.
    codes = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    ids = np.array([k for k, c in enumerate(codes) if len(c)], int)
    if len(ids):
        counts = np.array([len(codes[k]) for k in ids])
        symbols = np.concatenate([codes[k] for k in ids]).astype(np.uint64)
        level = 0
        while len(ids):
            first = _firsts(counts)
            # Runs of one symbol become one symbol with the length of the run.
            new = np.empty(len(symbols), bool)
            new[0] = True
            np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
            new[first] = True
            if not new.all():
                starts = np.flatnonzero(new)
                lengths = np.diff(starts, append=len(symbols))
                symbols = symbols[starts]
                runs = lengths > 1
                symbols[runs] = mixed(symbols[runs] + lengths[runs].astype(np.uint64) * _PLACE[63])
                counts = np.add.reduceat(new.astype(np.int64), first)
                first = _firsts(counts)
            labels = _labels(symbols, first)
            start = np.zeros(len(symbols), bool)
            start[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
            # A text's last symbol never begins a phrase, its first always does.
            start[first + counts - 1] = False
            start[first] = True
            # Neither does the second symbol, so that phrases have two symbols or more.
            second = first[counts > 1] + 1
            start[second] = False
            starts = np.flatnonzero(start)
            symbols = _named(symbols, starts) + _LEVEL[level % len(_LEVEL)]
            counts = np.add.reduceat(start.astype(np.int64), first)
            level += 1
            at = 0
            for k, n in zip(ids.tolist(), counts.tolist()):
                names = symbols[at : at + n]
                at += n
                (found if level >= LEVEL else levels)[k].append(names)
            more = counts > 1
            if not more.all():
                symbols = symbols[np.repeat(more, counts)]
                ids, counts = ids[more], counts[more]
    out = []
    for upper, lower in zip(found, levels):
        names = np.unique(np.concatenate(upper)) >> _TIER if upper else np.zeros(0, np.uint64)
        # The next lower level counts only where the higher ones leave room in a sketch.
        for level in range(len(lower) - 1, -1, -1):
            if len(names) >= KEPT:
                break
            tier = np.uint64(LEVEL - 1 - level) << np.uint64(62)
            names = np.concatenate([names, np.unique(lower[level] >> _TIER) | tier])
        out.append(np.unique(names))
    return out


def sketch(names: np.ndarray) -> np.ndarray:
    """The first KEPT names, mixed within their tier, sorted: a sample that equal names share."""
    return np.sort((mixed(names) >> _TIER) | (names >> np.uint64(62) << np.uint64(62)))[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names: of all if both sketches hold all, else of the first KEPT of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if max(len(a), len(b)) >= KEPT:
        union = union[:KEPT]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def sketches(texts: Sequence[str]) -> Iterator[np.ndarray]:
    start = size = 0
    for k, text in enumerate([*texts, None]):
        if k > start and (text is None or size + len(text) > BATCH):
            yield from (sketch(names) for names in parse(texts[start:k]))
            start, size = k, 0
        size += 0 if text is None else len(text)


def written(kept: np.ndarray) -> str:
    """A fingerprint as text: 16 hex digits a name; empty for a text without characters."""
    return kept.astype(">u8").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of the whole text; empty for NULL and empty texts.

    A column that is called like the new one is replaced.
    """

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([written(s) for s in sketches(batch.fillna("").tolist())], dtype=object)

    return docs.withColumn(name, made(F.col(f"`{text}`")))


def with_next(docs: DataFrame, id: str, text: str) -> DataFrame:
    """block, carried, id, text: each block of rows followed by the first row after it.

    Rows are in order of descending id, NULL ids last, equal ids by text; after the
    last comes the first. A block is a range of ids, so a block follows its rows
    without a sort of the table. Sort by block, carried, id descending, text.
    """
    rows = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    # NULL ids come below all others, in a block of their own.
    number = F.floor(F.col("id") / BLOCK).cast("long")
    rows = rows.withColumn("block", F.coalesce(number, F.lit(-(2**62))))
    heads = stored(rows.groupBy("block").agg(F.max("id").alias("head")), "blocks")
    # The next lower block: within ranges of blocks, then from range to range.
    above = F.floor(F.col("block") / BLOCKS)
    ranged = heads.withColumn("range", above)
    tops = ranged.groupBy("range").agg(F.max("block").alias("top"))
    everything = Window.orderBy(F.col("range").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    tops = tops.withColumn(
        "after",
        F.coalesce(
            F.lead("top").over(Window.orderBy(F.col("range").desc())),
            F.first("top").over(everything),
        ),
    )
    inside = Window.partitionBy("range").orderBy(F.col("block").desc())
    order = ranged.withColumn("lower", F.lead("block").over(inside)).join(
        tops.select("range", "after"), "range"
    )
    # The head of the lower block goes to this block as well.
    follows = stored(
        order.select(F.col("block").alias("to"), F.coalesce("lower", "after").alias("block")).join(
            heads, "block"
        ),
        "block-heads",
    )
    carried = (
        rows.join(
            follows.select("to", F.col("block").alias("from"), "head"),
            (F.col("block") == F.col("from")) & F.col("id").eqNullSafe(F.col("head")),
        )
        .select(F.col("to").alias("block"), F.lit(True).alias("carried"), "id", "text")
    )
    own = rows.select("block", F.lit(False).alias("carried"), "id", "text")
    return own.unionByName(carried)


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text replaces the last floor(n / 2) of n characters by as many of
    the first of the next document (or all it has), by descending id, after the
    last one the first; NULL ids come last. Rows that share an id follow by text. Returns id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next. NULL texts count as
    empty; two empty texts are alike (1.0), an empty and another are not (0.0). A
    single row follows itself. Other columns are not read. An empty table gives an
    empty result.
    """
    from hashlib import sha256

    kind = docs.select(F.col(f"`{id}`")).dtypes[0][1]
    order = ["block", "carried", F.col("id").desc_nulls_last(), "text"]
    rows = with_next(docs, id, text).repartition("block").sortWithinPartitions(*order)

    def judged(ids: list, texts: list[str]) -> pd.DataFrame:
        """Rows for all texts but the last, which only follows the one before it."""
        halves = [len(t) // 2 for t in texts[:-1]]
        edited = [
            t[: len(t) - half] + after[:half]
            for t, after, half in zip(texts, texts[1:], halves)
        ]
        own, changed = list(sketches(texts)), list(sketches(edited))
        return pd.DataFrame(
            {
                "id": pd.Series(ids[:-1], dtype=object),
                "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited],
                "fingerprint": [written(s) for s in own[:-1]],
                "edited_fingerprint": [written(s) for s in changed],
                "near_edited": [likeness(a, b) for a, b in zip(own, changed)],
                "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
            }
        )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The rows that wait for their next one: all of one block, at most a batch.
        ids: list = []
        texts: list[str] = []
        block, closed, size = None, True, 0
        for batch in batches:
            out = []
            for b, carried, i, t in zip(
                batch["block"], batch["carried"], batch["id"], batch["text"], strict=True
            ):
                if b != block:
                    ids, texts, block, closed, size = [], [], b, False, 0
                if closed:
                    continue
                ids.append(None if i is None or i != i else i)
                texts.append(t)
                size += len(t)
                if carried or (size > BATCH and len(texts) > 1):
                    out.append(judged(ids, texts))
                    closed = bool(carried)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
            out = [frame for frame in out if len(frame)]
            if out:
                yield pd.concat(out, ignore_index=True)

    schema = (
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return rows.mapInPandas(work, schema).withColumnRenamed("id", id)
