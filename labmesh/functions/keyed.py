"""Keyed, reproducible pseudonym functions as column expressions.

All results depend only on the key and the value, so a repeated run, another
partitioning or a recomputed task gives the same answer.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The readable form is P-LL-DD-DDD and the numeric one has six digits.
# Both can be stated wider: more groups of three digits, or more digits.
GROUPS = 1
DIGITS = 6
ROUNDS = 8
LARGEST = 2**63 - 1

# Built from the sources beside them, see the README.
STRETCHED_JAR = Path(__file__).resolve().parent / "java" / "stretched_hash.jar"
KERNELS_JAR = STRETCHED_JAR.with_name("stretched_kernels.jar")


def readable_factors(groups: int) -> tuple[int, int]:
    """Two factors of the number of readable forms: letters with leading digits, and the rest."""
    if not 1 <= groups <= 5:
        raise ValueError("the readable form has one to five groups of three digits")
    leading = (3 * groups - 1) // 2
    return 676 * 10**leading, 10 ** (2 + 3 * groups - leading)


def numeric_factors(digits: int) -> tuple[int, int]:
    """Two near-equal factors of the count of numbers with so many digits."""
    if not 4 <= digits <= 18:
        raise ValueError("the numeric form has 4 to 18 digits")
    leading = (digits - 1) // 2
    return 9 * 10**leading, 10 ** (digits - 1 - leading)


def secret(spark: SparkSession, salt: str) -> Column:
    """The salt as a scalar subquery, so that plans do not print it."""
    if not salt:
        raise ValueError("a salt is required")
    return spark.createDataFrame([(salt,)], "salt string").select("salt").scalar()


def keyed_hash(key: Column, value: Column) -> Column:
    """SHA-256 of key and value as lower-case hex."""
    return F.sha2(F.concat(key, value.cast("string")), 256)


def keyed_int(key: Column, *parts: Column) -> Column:
    """A number in 0 .. 2**32 - 1 drawn from the keyed hash of the parts."""
    digest = F.sha2(F.concat(key, *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def keyed_long(key: Column, *parts: Column) -> Column:
    """A number in 0 .. 2**60 - 1 drawn from the keyed hash of the parts."""
    digest = F.sha2(F.concat(key, *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def jitter(key: Column, ident: Column, value: Column, spread: int = 2) -> Column:
    """``value`` plus a whole number in -spread..spread; NULL stays NULL."""
    noise = F.pmod(keyed_int(key, F.lit("j"), ident), F.lit(2 * spread + 1)) - spread
    return value + noise


def permuted(df: DataFrame, key: Column, ident: str, factors: tuple[int, int], purpose: str) -> DataFrame:
    """Add ``left`` and ``right``, a keyed one-to-one image of a whole-number id.

    The ids 0 to ``a * b - 1`` split into a digit of base ``a`` and one of base
    ``b``. Each round adds a keyed hash of one digit to the other, which can
    always be undone, so different ids get different images without any
    comparison of rows, and no part of an id shows in its image. An id outside
    that domain is an error that names it; NULL stays NULL.
    """
    a, b = factors
    ids = F.col(ident)
    outside = F.raise_error(
        F.concat(F.lit("id outside the domain of the released form: "), ids.cast("string"))
    ).cast("bigint")
    inside = (ids >= 0) & (ids <= F.lit(min(a * b - 1, LARGEST)))
    number = F.when(inside, ids.cast("bigint")).when(ids.isNotNull(), outside)
    out = df.withColumns({"__k": key, "__x": number}).withColumns(
        {"left": F.expr(f"__x div {b}"), "right": F.expr(f"__x % {b}")}
    )
    # Four rounds share a projection, in which common parts are computed once.
    for first in range(0, ROUNDS, 4):
        left, right = F.col("left"), F.col("right")
        for i in range(first, first + 4):
            tag = F.lit(f":{purpose}:{i}:")
            if i % 2 == 0:
                left = (left + keyed_long(F.col("__k"), tag, right)) % a
            else:
                right = (right + keyed_long(F.col("__k"), tag, left)) % b
        out = out.withColumns({"left": left, "right": right})
    return out.drop("__k", "__x")


def readable(left: Column, right: Column, groups: int = GROUPS) -> Column:
    """An image in the form P-LL-DD-DDD, with as many groups of three digits as stated."""
    a, b = readable_factors(groups)
    leading = a // 676
    digits = F.lpad(right.cast("string"), len(str(b)) - 1, "0")
    if leading > 1:
        digits = F.concat(F.lpad((left % leading).cast("string"), len(str(leading)) - 1, "0"), digits)
    letters = F.floor(left / leading) if leading > 1 else left
    parts = [F.substring(digits, 1, 2), *(F.substring(digits, 3 + 3 * g, 3) for g in range(groups))]
    both = F.concat(F.chr(F.floor(letters / 26) + 65), F.chr(letters % 26 + 65))
    form = F.concat(F.lit("P-"), both, *(F.concat(F.lit("-"), part) for part in parts))
    return F.when(left.isNotNull(), form)


def numeric(left: Column, right: Column, digits: int = DIGITS) -> Column:
    """An image as a number of so many digits."""
    return left * numeric_factors(digits)[1] + right + 10 ** (digits - 1)


def stretched_hashes(salt: str, values: Column, iterations: int, spark: SparkSession) -> Column:
    """PBKDF2-HMAC-SHA256 of each binary value of an array, each as 64 hex digits.

    Spark has no such function, so a Java function comes with the package and Spark
    sends it to the executors, together with machine code for the processors that
    it knows. It derives the values of an array side by side; a thousand or more
    keep it busiest. NULL stays NULL.
    """
    key = secret(spark, salt)
    for jar in (STRETCHED_JAR, KERNELS_JAR):
        spark.sql(f"ADD JAR '{jar.as_uri()}'")
    spark.udf.registerJavaFunction("labmesh_stretched_hashes", "labmesh.StretchedHash", "array<string>")
    return F.call_function("labmesh_stretched_hashes", values, key, F.lit(iterations))
