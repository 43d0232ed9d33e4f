"""De-identification: mappings, publication, anonymity and noise reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labmesh.functions import keyed
from labmesh.operators.lookup import lookup_join
from labmesh.operators.ordering import assign_keys
from labmesh.sources.tables import replace_table

# Hash iterations of a task, and rows that it hashes side by side.
ITERATIONS_PER_TASK = 150_000_000
LANES = 2_000


def add_hash(ids: DataFrame, id_col: str, salt: str) -> DataFrame:
    """Fast keyed hash of the id, inside the JVM."""
    key = keyed.secret(ids.sparkSession, salt)
    return ids.withColumn("hashed_id", keyed.keyed_hash(key, F.col(id_col)))


def add_stretched_hash(
    ids: DataFrame, id_col: str, salt: str, iterations: int = 100_000, tasks: int | None = None
) -> DataFrame:
    """Slow keyed hash of the id, one PBKDF2 derivation per row.

    The work is pure CPU. Rows spread by id over tasks of 1,500 rows at 100,000
    iterations, so that a lost executor costs little, and each task hashes them
    ``LANES`` at a time, in the order of their ids: a frequent id is hashed once
    in each batch. Counting the ids to choose the number of tasks is cheap beside
    the hashing.
    """
    spark = ids.sparkSession
    if tasks is None:
        derivations = ids.count() * iterations
        tasks = max(4 * spark.sparkContext.defaultParallelism, -(-derivations // ITERATIONS_PER_TASK))
    text = F.col(id_col).cast("string").cast("binary")
    rows = ids.select(F.struct("*").alias("row"), text.alias("text"))
    dealt = rows.withColumn("task", F.pmod(F.hash("text"), F.lit(tasks))).repartitionById(tasks, F.col("task"))
    place = F.row_number().over(Window.partitionBy("task").orderBy("text"))
    batches = (
        dealt.withColumn("batch", F.floor((place - 1) / LANES))
        .groupBy("task", "batch")
        .agg(F.collect_list(F.struct("row", "text")).alias("rows"))
    )
    hashes = keyed.stretched_hashes(salt, F.col("rows.text"), iterations, spark)
    hashed = batches.select(F.col("rows.row").alias("row"), hashes.alias("hashed_id"))
    return hashed.select(F.inline(F.arrays_zip("row", "hashed_id"))).select("row.*", "hashed_id")


def _is_whole(ids: DataFrame, id_col: str) -> bool:
    return isinstance(ids.schema[id_col].dataType, T.IntegralType)


def _numbered(ids: DataFrame, id_col: str, salt: str, known: DataFrame | None) -> DataFrame:
    """Add ``__n``, the whole number that a released form is made from.

    Whole-number ids are their own numbers. Ids of another kind are numbered in
    the order of their keyed hash, after those of the mapping ``known``, from
    which no row is ever removed; so a number is never given twice, and the
    mapping keeps what it has.
    """
    if isinstance(ids.schema[id_col].dataType, T.IntegralType):
        return ids.withColumn("__n", F.col(id_col))
    key = keyed.secret(ids.sparkSession, salt)
    distinct = ids.select(F.col(id_col).alias("__id")).where(F.col(id_col).isNotNull()).distinct()
    hashed = distinct.withColumn("__h", keyed.keyed_long(key, F.lit(":number:"), F.col("__id")))
    before = F.lit(0) if known is None else known.agg(F.count("*").alias("n")).select("n").scalar()
    numbers = assign_keys(hashed, "__h", "__n", start=0).withColumn("__n", F.col("__n") + before)
    return ids.join(numbers.drop("__h"), F.col(id_col) == F.col("__id"), "left").drop("__id")


def add_pseudonym(
    ids: DataFrame, id_col: str, salt: str, groups: int = keyed.GROUPS, known: DataFrame | None = None
) -> DataFrame:
    """A unique readable pseudonym per id, always of the one stated form.

    Numbers are permuted under the key; one that the form has no room for is an
    error, and the caller states more ``groups``. Ids of another kind are numbered
    first, after those of the stored mapping ``known``.
    """
    key = keyed.secret(ids.sparkSession, salt)
    numbered = _numbered(ids, id_col, salt, known)
    out = keyed.permuted(numbered, key, "__n", keyed.readable_factors(groups), "pseudonym")
    named = keyed.readable(F.col("left"), F.col("right"), groups)
    return out.withColumn("pseudonym", named).drop("left", "right", "__n")


def add_random_id(
    ids: DataFrame, id_col: str, salt: str, digits: int = keyed.DIGITS, known: DataFrame | None = None
) -> DataFrame:
    """A unique number of ``digits`` digits per id, see ``add_pseudonym``."""
    key = keyed.secret(ids.sparkSession, salt)
    numbered = _numbered(ids, id_col, salt, known)
    out = keyed.permuted(numbered, key, "__n", keyed.numeric_factors(digits), "random")
    number = keyed.numeric(F.col("left"), F.col("right"), digits)
    return out.withColumn("random_id", number).drop("left", "right", "__n")


def _mapping_schema(id_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("original_id", id_type)
        .add("pseudonym", "string")
        .add("hashed_id", "string")
        .add("random_id", "long")
    )


def generate_mapping(
    participant_ids: DataFrame,
    salt: str,
    id_col: str = "ParticipantID",
    iterations: int | None = 100_000,
    groups: int = keyed.GROUPS,
    digits: int = keyed.DIGITS,
    known: DataFrame | None = None,
) -> DataFrame:
    """The restricted table that links real ids to released ones.

    ``iterations=None`` uses the fast hash instead of the stretched one. ``groups``
    and ``digits`` state the width of the released forms. ``known`` is a stored
    mapping that these rows will be appended to.
    """
    ids = participant_ids.select(F.col(id_col).alias("original_id")).distinct()
    named = add_pseudonym(ids, "original_id", salt, groups, known)
    named = add_random_id(named, "original_id", salt, digits, known)
    if iterations is None:
        hashed = add_hash(named, "original_id", salt)
    else:
        hashed = add_stretched_hash(named, "original_id", salt, iterations)
    return hashed.select("original_id", "pseudonym", "hashed_id", "random_id")


def extend_mapping(
    mapping: DataFrame,
    participant_ids: DataFrame,
    salt: str,
    id_col: str = "ParticipantID",
    iterations: int | None = 100_000,
    groups: int = keyed.GROUPS,
    digits: int = keyed.DIGITS,
) -> DataFrame:
    """Mapping rows for ids the stored mapping lacks, ready to append."""
    fresh = (
        participant_ids.select(id_col).distinct()
        .join(mapping.select(F.col("original_id").alias(id_col)), id_col, "left_anti")
    )
    return generate_mapping(fresh, salt, id_col, iterations, groups, digits, mapping)


def anonymize_participants(
    participant: DataFrame,
    mapping: DataFrame,
    salt: str,
    id_col: str = "ParticipantID",
    direct_identifiers: tuple[str, ...] = ("Name",),
    noisy: tuple[str, ...] = ("Age",),
    spread: int = 2,
) -> DataFrame:
    """The table to release: pseudonyms in, real key and direct identifiers out.

    Numeric columns in ``noisy`` that exist get a small whole-number noise.
    """
    key = keyed.secret(participant.sparkSession, salt)
    joined = participant.join(mapping, F.col(id_col) == F.col("original_id"))
    for name in noisy:
        if name in participant.columns:
            noise = keyed.jitter(key, F.col(id_col), F.col(name), spread)
            joined = joined.withColumn(name, noise.cast(participant.schema[name].dataType))
    return joined.drop(id_col, "original_id", *direct_identifiers)


def release(
    participant: DataFrame,
    mapping_path: str,
    release_path: str,
    salt: str,
    id_col: str = "ParticipantID",
    iterations: int | None = 100_000,
    groups: int = keyed.GROUPS,
    digits: int = keyed.DIGITS,
) -> DataFrame:
    """Extend the stored mapping, write the released table and return it.

    The mapping folder holds the real keys and needs its own access rights. Ids
    that it knows keep their pseudonyms. An empty table is released empty.
    """
    spark = participant.sparkSession
    schema = _mapping_schema(participant.schema[id_col].dataType)
    spark.createDataFrame([], schema).write.mode("append").parquet(mapping_path)
    stored = spark.read.schema(schema).parquet(mapping_path)
    extend_mapping(stored, participant, salt, id_col, iterations, groups, digits).write.mode("append").parquet(mapping_path)
    complete = spark.read.schema(schema).parquet(mapping_path)
    out = anonymize_participants(participant, complete, salt, id_col)
    replace_table(out, release_path)
    return spark.read.schema(out.schema).parquet(release_path)


def small_groups(rows: DataFrame, quasi_identifiers: list[str], k: int) -> DataFrame:
    """Combinations of quasi-identifiers shared by fewer than ``k`` rows."""
    return rows.groupBy(*quasi_identifiers).agg(F.count("*").alias("GroupSize")).where(F.col("GroupSize") < k)


def suppress_small_groups(
    rows: DataFrame, quasi_identifiers: list[str], k: int, spread_by: list[str]
) -> DataFrame:
    """Rows whose combination is shared by at least ``k`` rows."""
    rare = small_groups(rows, quasi_identifiers, k).select(*quasi_identifiers)
    return lookup_join(rows, rare, quasi_identifiers, spread_by, how="left_anti", null_safe=True)


def laplace(key: Column, scale: float, *group: Column) -> Column:
    """Laplace noise that is the same for each release of a group.

    Fixed noise per group keeps repeated releases from averaging it away.
    """
    parts = [F.concat(F.lit("|"), F.coalesce(g.cast("string"), F.lit("\u0000"))) for g in group]
    u = (keyed.keyed_int(key, *parts).cast("double") + 0.5) / 4294967296.0 - 0.5
    return -scale * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def private_totals(
    rows: DataFrame, groups: list[str], value: str, bound: float, epsilon: float, salt: str
) -> DataFrame:
    """Noisy count and sum per group under an epsilon split over both.

    Values are clamped to 0..bound so that one row moves the sum by at most
    ``bound``.
    """
    key = keyed.secret(rows.sparkSession, salt)
    clamped = F.least(F.greatest(F.col(value), F.lit(0)), F.lit(bound)).cast("decimal(15,2)")
    half = epsilon / 2
    columns = [F.col(g) for g in groups]
    return (
        rows.groupBy(*groups)
        .agg(F.count("*").alias("__n"), F.sum(clamped).cast("double").alias("__s"))
        .select(
            *groups,
            F.round(F.col("__n") + laplace(key, 1 / half, F.lit("count"), *columns), 4).alias("NoisyCount"),
            F.round(F.col("__s") + laplace(key, bound / half, F.lit("sum"), *columns), 4).alias("NoisySum"),
        )
    )
