"""Mix sources to target weights by weighted sampling without replacement.

Every document draws the key -ln(u) / weight (Efraimidis and Spirakis), u from a
hash of its id. Within a source the documents with the smallest keys fill the
budget that is left after complete epochs. Finding where a budget ends needs no
sort of a source: words are summed per source and key range, 256 ranges and then
256 ranges of the range in which the budget ends. Only the rows of that last
range, one in about 65,536 of their source, are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labmesh.llm.common import n_words, stored

RANGES = 256
EPOCHS = 3


def uniform(id: Column, seed: int) -> Column:
    """A number in (0, 1) from the id, the same in every run."""
    digest = F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """source, source_size, target: one row per source from rows of source and size.

    Sources by code point, NULL last, take the weights in turn. Targets share all
    words by weight but stop at `epochs` times the source; the excess goes to the
    others by weight until none is above. In the order of size per weight the
    stopped sources come first, and the level at which the others stop is the
    largest over all such splits.
    """
    sums = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    # One row per source from here on, so windows over all of them are small.
    by_name = Window.orderBy(F.encode("source", "utf-8").asc_nulls_last())
    turns = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sums.withColumn(
        "weight",
        F.element_at(turns, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")),
    )
    ceiling = F.col("source_size") * float(epochs)
    order = [(ceiling / F.col("weight")).asc(), F.encode("source", "utf-8").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    level = (
        F.sum("source_size").over(everything).cast("double")
        - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    leveled = weighed.withColumn("level", level)
    return leveled.select(
        "source",
        "source_size",
        "n_docs",
        F.least(ceiling, F.max("level").over(everything) * F.col("weight")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    quality: DataFrame | None = None,
    weights: tuple[int, ...] = (1, 2, 3),
    epochs: int = EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    `taken` counts the words that the mix takes from a document, repeats counted:
    `size` for each complete epoch, and once more for the documents that the last,
    partial epoch selects. Documents are whole; the one on which the budget ends
    is taken if the sum then comes nearer to the target. `quality` has rows of id
    and weight; a document without one, or with NULL, weighs 1, and one whose
    weight is not above 0 comes last. Of several weights for an id the largest
    counts. Weights are taken relative to the mean of the source.

    NULL and empty texts have size 0 and take nothing. A NULL source is a source.
    Rows with a NULL id, and repeated rows, are documents of their own; equal keys
    are ordered by id and size, and rows equal in those are interchangeable. Other
    columns are not read. An empty table gives an empty result.
    """
    plain = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.col(f"`{source}`").alias("source"),
        n_words(F.col(f"`{text}`")).alias("size"),
    )
    if quality is None:
        weighed = plain.withColumn("weight", F.lit(1.0))
    else:
        given = quality.toDF("id", "weight").groupBy("id").agg(F.max("weight").alias("weight"))
        weighed = plain.join(given, "id", "left").withColumn(
            "weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
        )
    # The texts are read once; everything else works on these narrow rows.
    sizes = stored(weighed.withColumn("u", uniform(F.col("id"), seed)), "mix-sizes")
    per_source = stored(
        source_targets(sizes, weights, epochs).join(
            sizes.groupBy(F.col("source").alias("named"))
            .agg(F.avg(F.greatest("weight", F.lit(0.0))).alias("mean")),
            F.col("source").eqNullSafe(F.col("named")),
        ).drop("named"),
        "mix-sources",
    )

    # The place of a document among its source, in (0, 1): u to the power 1 / weight.
    relative = F.col("weight") / F.col("mean")
    place = F.when(
        F.col("weight") > 0, F.lit(1.0) - F.exp(F.ln("u") / relative)
    ).otherwise(F.lit(1.0))
    key = F.when(F.col("weight") > 0, -F.ln("u") / F.col("weight")).otherwise(
        F.lit(float("inf"))
    )
    first = F.least(F.floor(place * RANGES), F.lit(RANGES - 1)).cast("int")
    second = F.least(F.floor(place * RANGES * RANGES), F.lit(RANGES * RANGES - 1)).cast("int")
    full = F.when(
        F.col("source_size") > 0,
        F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs)),
    ).otherwise(F.lit(0))
    placed = (
        sizes.join(
            per_source.withColumnRenamed("source", "named"),
            F.col("source").eqNullSafe(F.col("named")),
        )
        .drop("named")
        .withColumn("full", full.cast("long"))
        .withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumns({"key": key, "first": first, "second": second})
    )

    def cut(rows: DataFrame, by: str) -> DataFrame:
        """Where the budget ends: per source the range and the words before it."""
        sums = rows.groupBy("source", by).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget")
        )
        run = Window.partitionBy("source").orderBy(by)
        before = sums.withColumn("until", F.sum("words").over(run))
        return (
            before.filter((F.col("until") >= F.col("budget")) & (F.col("words") > 0))
            .groupBy(F.col("source").alias("named"))
            .agg(
                F.min(by).alias(f"cut_{by}"),
                F.min_by(F.col("until") - F.col("words"), by).alias(f"before_{by}"),
            )
        )

    def with_cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
        matches = F.col("source").eqNullSafe(F.col("named"))
        return rows.join(cuts, matches, "left").drop("named")

    coarse = with_cut(placed, stored(cut(placed, "first"), "mix-cut"))
    inside = coarse.filter(F.col("first") == F.col("cut_first")).withColumn(
        "budget", F.col("budget") - F.col("before_first")
    )
    fine = with_cut(coarse, stored(cut(inside, "second"), "mix-cut"))
    left = F.col("budget") - F.col("before_first") - F.col("before_second")
    on_edge = (F.col("first") == F.col("cut_first")) & (F.col("second") == F.col("cut_second"))
    edge = fine.filter(on_edge).withColumn("left", left)
    until = F.sum("size").over(
        Window.partitionBy("source")
        .orderBy("key", F.col("id").asc_nulls_first(), "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    edge = edge.withColumn("until", until).withColumn(
        "selected",
        (F.col("until") <= F.col("left"))
        | (
            (F.col("until") - F.col("size") < F.col("left"))
            & (F.col("until") - F.col("left") < F.col("left") - F.col("until") + F.col("size"))
        ),
    )
    # A source without a cut has a budget beyond all its words, or no words at all.
    away = fine.filter(~F.coalesce(on_edge, F.lit(False))).withColumn(
        "selected",
        F.col("cut_first").isNull()
        | (F.col("first") < F.col("cut_first"))
        | (
            (F.col("first") == F.col("cut_first"))
            & (F.col("cut_second").isNull() | (F.col("second") < F.col("cut_second")))
        ),
    )
    last = F.when(F.col("selected") & (F.col("full") < epochs) & (F.col("budget") > 0), 1)
    columns = [
        F.col("id").alias(id),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("full") + F.coalesce(last, F.lit(0)))).alias("taken"),
    ]
    return away.select(*columns).unionByName(edge.select(*columns))
