"""Near-duplicate documents by MinHash, banding, verification and components.

1. One pass over the texts gives each document the minima of many universal
   hashes over its shingle set, the keys of their bands, and a key of the whole
   set. Documents with equal sets are one class from here on.
2. Classes that share a band key meet in a bucket. Buckets with the same members
   are looked at once. A large bucket is cut into tiles; a task sees two tiles, so
   no task holds a bucket, and it returns the members that have a likely partner,
   not the pairs. A pair belongs to the first band that it shares.
3. The full sets of those members are fetched and compared in the same tiles.
   Pairs already joined within the task are not compared again; a task returns a
   spanning forest of the true links.
4. Components come from alternating large-star and small-star.

With 32 bands of 4 minima a pair at the threshold shares no band with probability
(1 - 0.85**4)**32 = 6e-11 (0.80: 5e-8); a pair whose minima agree in fewer places
than five standard deviations below the threshold is not compared (3e-7). Those
are the only ways to lose a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.llm.common import in_groups, lower_ascii, stored
from labmesh.llm.components import components
from labmesh.llm.shingles import mixed, set_key, shingle_sets

MINIMA = 128
BAND = 4
TILE_MEMBERS = 512
TILE_SHINGLES = 1 << 20

_random = np.random.default_rng(7)
_FACTOR = _random.integers(1, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 2**63, MINIMA, np.uint64)
_PLACE = _random.integers(1, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MINIMA 32-bit minima per set; sets must not be empty."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    start = size = 0
    for k, shingles in enumerate([*sets, None]):
        if k > start and (shingles is None or size + len(shingles) > 1 << 16):
            flat = np.concatenate(sets[start:k])
            first = np.cumsum([0, *(len(s) for s in sets[start : k - 1])])
            for j in range(MINIMA):
                hashed = flat * _FACTOR[j] + _SHIFT[j]
                out[start:k, j] = np.minimum.reduceat(hashed, first) >> np.uint64(32)
            start, size = k, 0
        size += 0 if shingles is None else len(shingles)
    return out


def band_keys(rows: np.ndarray, band: int) -> np.ndarray:
    """A 64-bit key for every band of every row; keys of different bands differ."""
    bands = MINIMA // band
    weighed = rows.astype(np.uint64) * _PLACE
    sums = weighed.reshape(len(rows), bands, band).sum(axis=2, dtype=np.uint64)
    return mixed(sums + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(2**57 + 1)).view(np.int64)


def _sets_of(texts: pd.Series, words: int) -> list[np.ndarray]:
    return list(shingle_sets([t.encode("utf-8", "replace") for t in texts], words))


def measured(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """id, n_shingles, set_key, minima of every document; empty sets have no key or minima."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = _sets_of(batch["text"], words)
            full = [k for k, s in enumerate(sets) if len(s)]
            rows = minima([sets[k] for k in full])
            out = pd.DataFrame(
                {
                    "id": batch["id"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [set_key(s) if len(s) else None for s in sets],
                }
            )
            found = np.full(len(sets), None, object)
            for k, row in zip(full, rows):
                found[k] = row.tobytes()
            out["minima"] = found
            yield out

    kind = docs.select(F.col(f"`{id}`")).dtypes[0][1]
    return docs.select(
        F.col(f"`{id}`").alias("id"),
        F.coalesce(lower_ascii(F.col(f"`{text}`")), F.lit("")).alias("text"),
    ).mapInPandas(work, f"id {kind}, n_shingles long, set_key binary, minima binary")


def tiled_members(classes: DataFrame, band: int) -> DataFrame:
    """bucket, i, j, rep: the classes of every bucket, once for each pair of tiles they are in."""

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rows = np.frombuffer(b"".join(batch["minima"]), np.uint32).reshape(-1, MINIMA)
            keys = band_keys(rows, band)
            for k in range(keys.shape[1]):
                out = batch[["rep", "n_shingles"]].copy()
                out["band"], out["bucket"] = k, keys[:, k]
                yield out

    kind = dict(classes.dtypes)["rep"]
    rows = classes.select("rep", "n_shingles", "minima").mapInPandas(
        banded, f"rep {kind}, n_shingles long, band int, bucket long"
    )
    buckets = (
        rows.groupBy("bucket")
        .agg(
            F.min("band").alias("band"),
            F.count(F.lit(1)).alias("members"),
            F.sum("n_shingles").alias("shingles"),
            F.bit_xor(F.xxhash64("rep")).alias("all"),
            F.min("rep").alias("low"),
            F.max("rep").alias("high"),
        )
        .filter(F.col("members") > 1)
        # Classes that meet in many bands have the same bucket many times; the first band
        # keeps it, since a pair belongs to the first band that it shares.
        .groupBy("members", "shingles", "all", "low", "high")
        .agg(F.min_by("bucket", "band").alias("bucket"))
        .select(
            "bucket",
            F.greatest(
                F.ceil(F.col("members") / TILE_MEMBERS), F.ceil(F.col("shingles") / TILE_SHINGLES)
            ).cast("int").alias("tiles"),
        )
    )
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    return (
        rows.select("rep", "bucket")
        .join(stored(buckets, "buckets"), "bucket")
        .withColumn("t", tile)
        .withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("bucket", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "rep")
    )


def _likely(group: pd.DataFrame, percent: int, band: int) -> tuple[np.ndarray, ...]:
    """Positions of pairs worth comparing, the most alike first.

    They agree in enough minima, their sizes allow the threshold, and this bucket
    is the one of the first band that they share.
    """
    rows = np.frombuffer(b"".join(group["minima"]), np.uint32).reshape(-1, MINIMA)
    keys = band_keys(rows, band)
    bucket = group["bucket"].iloc[0]
    of_bucket = int((keys == bucket).any(axis=0).argmax())
    sizes = group["n_shingles"].to_numpy()
    tile = group["t"].to_numpy()
    one_tile = group["i"].iloc[0] == group["j"].iloc[0]
    share = percent / 100
    needed = MINIMA * share - 5 * np.sqrt(MINIMA * share * (1 - share))
    firsts, seconds, alike = [], [], []
    for a in range(len(rows) - 1):
        other = np.arange(a + 1, len(rows))
        if not one_tile:
            other = other[tile[other] != tile[a]]
        low, high = np.minimum(sizes[a], sizes[other]), np.maximum(sizes[a], sizes[other])
        other = other[100 * low >= percent * high]
        if not len(other):
            continue
        if of_bucket:
            other = other[~(keys[other, :of_bucket] == keys[a, :of_bucket]).any(axis=1)]
        same = (rows[other] == rows[a]).sum(axis=1)
        good = same >= needed
        if good.any():
            seconds.append(other[good])
            alike.append(same[good])
            firsts.append(np.full(int(good.sum()), a))
    if not firsts:
        return np.zeros(0, int), np.zeros(0, int)
    order = np.argsort(-np.concatenate(alike), kind="stable")
    return np.concatenate(firsts)[order], np.concatenate(seconds)[order]


def _with_partner(percent: int, band: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _likely(group, percent, band)
        return group.iloc[np.unique(np.concatenate([a, b]))]

    return work


def _forest(percent: int, band: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        firsts, seconds = _likely(group, percent, band)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        reps = group["rep"].to_numpy()
        above = list(range(len(sets)))

        def root(k: int) -> int:
            while above[k] != k:
                above[k] = above[above[k]]
                k = above[k]
            return k

        links = []
        for a, b in zip(firsts.tolist(), seconds.tolist()):
            x, y = root(a), root(b)
            if x == y:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                above[max(x, y)] = min(x, y)
                links.append((reps[a], reps[b]))
        return pd.DataFrame(links, columns=["a", "b"])

    return work


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    band: int = BAND,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    distinct shingles of `words` words (A-Z in lower case, words between ASCII
    white space); with fewer words the whole sequence is the one shingle. The
    component is named by the smallest id reachable over links, and `kept` marks
    the document of that id.

    NULL and empty texts, and texts without words, have no shingles and link with
    nothing. A row without an id links with nothing either: its component is NULL,
    it is kept. Repeated rows get equal results; rows that share an id but not a
    text count by their own text. Other columns are not read. An empty table gives
    an empty result.
    """
    all_rows = stored(measured(docs, id, text, words), "minima")
    named = all_rows.filter(F.col("id").isNotNull() & F.col("set_key").isNotNull())
    classes = stored(
        named.groupBy("set_key").agg(
            F.min("id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("minima").alias("minima"),
        ),
        "classes",
    )
    tiles = tiled_members(classes, band)
    details = classes.select("rep", "n_shingles", "minima", "set_key")
    kind = dict(classes.dtypes)["rep"]
    members = f"rep {kind}, bucket long, i int, j int, t int, n_shingles long, minima binary, set_key binary"
    likely = stored(
        in_groups(
            tiles.join(details, "rep"),
            ["bucket", "i", "j"],
            _with_partner(percent, band),
            members,
        ),
        "likely",
    )

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _sets_of(batch["text"], words)
            yield pd.DataFrame(
                {
                    "rep": batch["rep"],
                    "set_key": [set_key(s) for s in found],
                    "shingles": [s.tobytes() for s in found],
                }
            )

    wanted = likely.select("rep").distinct()
    texts = docs.select(
        F.col(f"`{id}`").alias("rep"),
        F.coalesce(lower_ascii(F.col(f"`{text}`")), F.lit("")).alias("text"),
    )
    # An id may occur with several texts: the set must be that of the class.
    # The same plan at every size: a list of ids that fits a broadcast today outgrows it.
    fetched = (
        texts.join(wanted.hint("merge"), "rep", "left_semi")
        .mapInPandas(sets, f"rep {kind}, set_key binary, shingles binary")
        .dropDuplicates(["rep", "set_key"])
    )
    links = in_groups(
        likely.join(fetched, ["rep", "set_key"]),
        ["bucket", "i", "j"],
        _forest(percent, band),
        f"a {kind}, b {kind}",
    )
    found = components(links)
    by_set = classes.select("set_key", "rep").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select("set_key", F.coalesce("component", "rep").alias("component"))
    result = all_rows.select("id", "n_shingles", "set_key").join(
        stored(by_set, "by-set"), "set_key", "left"
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(
        F.col("id").alias(id),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
