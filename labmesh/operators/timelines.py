"""Posts over time: concurrency, gaps and overlaps.

Dates bound the work: where a researcher has more posts than a task should take, a
window sees at most one summary row per calendar day, however many posts there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labmesh.operators import lookup
from labmesh.operators.lookup import hot_keys, lookup_join, too_small_to_skew
from labmesh.sources.scratch import fresh_folder

OPEN_END = "9999-12-31"
# Posts that a task should take at most; their starts and ends are sorted in it twice.
POSTS_PER_TASK = 250_000


SPAN = ["ResearcherID", "InstitutionID", "from_day", "to_day"]


def _spans(employment: DataFrame) -> DataFrame:
    """Posts with an institution as half-open day spans."""
    return (
        employment.where(F.col("InstitutionID").isNotNull())
        .select(
            "ExperienceRecordID",
            "ResearcherID",
            "InstitutionID",
            F.col("StartDate").alias("from_day"),
            F.coalesce(F.col("EndDate"), F.lit(OPEN_END).cast("date")).alias("to_day"),
        )
        .where(F.col("from_day") < F.col("to_day"))
    )


def _overlaps(employment: DataFrame, row: list[str]) -> DataFrame:
    """One row per post, named by the columns ``row``, with its ``copies`` and the posts elsewhere it overlaps.

    The posts of a researcher meet in one task, unless they are more than a task should
    take: those of such researchers are summed by days first. Posts are written once,
    since counting them and both ways read them.
    """
    spans = _spans(employment)
    if too_small_to_skew(employment):
        return _overlaps_in_order(spans, row)
    path = fresh_folder(employment.sparkSession, "posts")
    spans.write.parquet(path)
    spans = employment.sparkSession.read.schema(spans.schema).parquet(path)
    tasks = -(-spans.count() // POSTS_PER_TASK)
    hot = hot_keys(spans, ["ResearcherID"], min(POSTS_PER_TASK, lookup.ROWS_PER_TASK))
    hot = hot.select(F.col("ResearcherID").alias("__who"))
    if hot.isEmpty():
        return _overlaps_in_order(spans, row, tasks)
    is_hot = F.col("ResearcherID").eqNullSafe(F.col("__who"))
    busy = spans.join(hot, is_hot, "left_semi").groupBy(*row).agg(F.count("*").alias("copies"))
    found = _overlaps_by_day(busy, [*row, "copies"], F.col("copies"))
    return _overlaps_in_order(spans.join(hot, is_hot, "left_anti"), row, tasks).unionByName(found)


def _overlaps_in_order(spans: DataFrame, row: list[str], tasks: int | None = None) -> DataFrame:
    """The same as ``_overlaps_by_day``, by a running count over the starts and ends of a researcher.

    At one day ends go before starts, so that the posts counted up to an end are those that
    start before it, and up to a start those that end by it. All steps follow one shuffle.
    """
    if tasks is not None:
        tasks = max(tasks, int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = spans.repartition("ResearcherID") if tasks is None else spans.repartition(tasks, "ResearcherID")
    posts = together.groupBy(*row).agg(F.count("*").alias("copies"))
    ends = F.array(*[F.struct(F.col(d).alias("day"), F.lit(s).alias("starts")) for d, s in (("to_day", 0), ("from_day", 1))])
    marks = posts.select("*", F.explode(ends).alias("x")).select(*row, "copies", "x.*")
    counted = F.when(F.col("starts") == 0, F.lit(0)).otherwise(F.col("copies")), F.when(F.col("starts") == 0, F.col("copies")).otherwise(0)

    def running(*scope: str) -> Column:
        upto = Window.partitionBy(*scope).orderBy("day", "starts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        started, ended = (F.sum(c).over(upto) for c in counted)
        return F.when(F.col("starts") == 0, started).otherwise(-ended)

    # Those of the own institution are taken away again.
    here = marks.withColumn("all", running("ResearcherID")).withColumn("own", running("ResearcherID", "InstitutionID"))
    return here.groupBy(*row, "copies").agg(F.sum(F.col("all") - F.col("own")).alias("ConcurrentElsewhere"))


def _overlaps_by_day(spans: DataFrame, row: list[str], copies: Column) -> DataFrame:
    """One row per span, named by the columns ``row``: the posts elsewhere it overlaps.

    A post overlaps those that start before its end, less those that end by its
    start. Both numbers are running counts over days, taken once for all posts
    of the researcher and once for those at the same institution; the difference
    is the answer. Every span puts a mark at its start and at its end in both
    scopes. Marks count together per scope and day before the window that adds up
    the days, and look the sums up again by scope and day, spread where a day of a
    researcher has too many of them. No pair of posts is ever formed.
    """
    nowhere = F.lit(0).cast(spans.schema["InstitutionID"].dataType)
    none = F.lit(0).cast("bigint")

    def mark(here: bool, end: bool) -> Column:
        site = F.col("InstitutionID") if here else nowhere
        return F.struct(
            F.col("ResearcherID").alias("who"),
            F.lit(here).alias("here"),
            site.alias("site"),
            F.col("to_day" if end else "from_day").alias("day"),
            F.lit(end).alias("at_end"),
            # Posts that start before the end count, those that end by the start do not;
            # the posts of the own institution are taken away again.
            F.lit(1 if here != end else -1).alias("sign"),
            (none if end else copies).alias("starts"),
            (copies if end else none).alias("ends"),
        )

    marks = F.array(*[mark(here, end) for here in (True, False) for end in (True, False)])
    rows = spans.select(*row, F.explode(marks).alias("x")).select(*row, "x.*")
    scope = ["who", "here", "site"]
    daily = rows.groupBy(*scope, "day").agg(F.sum("starts").alias("started"), F.sum("ends").alias("ended"))
    until = Window.partitionBy(*scope).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = daily.select(
        *scope,
        "day",
        (F.sum("started").over(until) - F.col("started")).alias("started_before"),
        F.sum("ended").over(until).alias("ended_by"),
    )
    counted = lookup_join(rows, sums, [*scope, "day"], spread_by=row, null_safe=True)
    count = F.when(F.col("at_end"), F.col("started_before")).otherwise(F.col("ended_by"))
    return (
        counted.select(*row, (F.col("sign") * count).alias("__part"))
        .groupBy(*row)
        .agg(F.sum("__part").alias("ConcurrentElsewhere"))
    )


def concurrent_posts(employment: DataFrame) -> DataFrame:
    """One row per post: how many posts elsewhere overlap it in time.

    Posts that only touch do not overlap.
    """
    counted = _overlaps(employment, ["ExperienceRecordID", *SPAN])
    # Rows that are the same post twice come back twice.
    return counted.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        "ExperienceRecordID", "ResearcherID", "InstitutionID", "ConcurrentElsewhere"
    )


def concurrent_researchers(employment: DataFrame) -> DataFrame:
    """One row per researcher with overlapping posts at several institutions.

    ``OverlappingPairs`` counts unordered pairs of such posts.
    """
    elsewhere, copies = F.col("ConcurrentElsewhere"), F.col("copies")
    # Copies of a span collapse at once.
    return (
        _overlaps(employment, SPAN)
        .where(elsewhere > 0)
        .groupBy("ResearcherID")
        .agg(
            F.sum(copies).alias("ConcurrentPosts"),
            F.expr("sum(copies * ConcurrentElsewhere) div 2").alias("OverlappingPairs"),
            F.max(elsewhere).alias("MostConcurrent"),
        )
    )


def employment_timeline(employment: DataFrame) -> DataFrame:
    """One row per researcher and start day, compared with the time before.

    ``PreviousEnd`` is the latest end among earlier starts. ``GapDays`` is
    positive after an idle time, negative for an overlap, and NULL at first.
    """
    daily = employment.groupBy("ResearcherID", "StartDate").agg(
        F.count("*").alias("PostsStarted"),
        F.max(F.coalesce(F.col("EndDate"), F.lit(OPEN_END).cast("date"))).alias("__end"),
    )
    earlier = Window.partitionBy("ResearcherID").orderBy("StartDate").rowsBetween(Window.unboundedPreceding, -1)
    compared = daily.withColumn("PreviousEnd", F.max("__end").over(earlier))
    gap = F.datediff("StartDate", "PreviousEnd")
    return compared.select(
        "ResearcherID",
        "StartDate",
        "PostsStarted",
        "PreviousEnd",
        gap.alias("GapDays"),
        F.when(gap > 1, "GAP").when(gap < 0, "OVERLAP").when(gap.isNotNull(), "CONTINUOUS").alias("Transition"),
    )
