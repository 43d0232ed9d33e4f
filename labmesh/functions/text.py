"""Text predicates and phrase helpers.

The source database compares text without regard to case and trailing blanks.
``folded`` brings a text into the form in which Spark's exact comparison agrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labmesh.sources.schemas import ORCID_PATTERN

# Endings of company names that carry no identity.
LEGAL_FORMS = ["ag", "co", "company", "corp", "corporation", "gmbh", "holding", "inc", "llc", "ltd", "plc", "sa"]


def folded(column: Column) -> Column:
    return F.lower(F.rtrim(column))


def one_of(column: Column, values: list[str] | tuple[str, ...]) -> Column:
    """The text is one of the values; NULL for NULL."""
    return folded(column).isin(*[v.rstrip().lower() for v in values])


def holds(column: Column, part: str) -> Column:
    """The text contains ``part``."""
    return F.lower(column).contains(part.lower())


def valid_orcid(column: Column) -> Column:
    """Four digit groups, the last ending in a digit or X; blanks are padding."""
    return F.rtrim(column).rlike(ORCID_PATTERN)


def words(column: Column) -> Column:
    """Lower-case runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(column), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def name_phrase(column: Column, ignored: list[str] = LEGAL_FORMS) -> Column:
    """The words of a name without legal forms at its end, joined by single blanks.

    A name made of nothing else keeps all its words.
    """
    parts = words(column)
    last = F.array_max(F.transform(parts, lambda w, i: F.when(~w.isin(*ignored), i + 1)))
    return F.array_join(F.slice(parts, 1, F.coalesce(last, F.size(parts))), " ")


def phrases(column: Column, lengths: Column) -> Column:
    """Distinct word sequences of ``column`` whose number of words is one of ``lengths``."""
    parts = words(column)
    starts = F.sequence(F.lit(1), F.size(parts))
    runs = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.filter(lengths, lambda n: n <= F.size(parts) - i + 1),
                lambda n: F.array_join(F.slice(parts, i, n), " "),
            ),
        )
    )
    return F.when(F.size(parts) > 0, F.array_distinct(runs))
