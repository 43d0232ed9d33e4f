"""URL filter: rules by host and path, then a weighted vocabulary.

A strict term rejects a url alone, a soft term only together with other soft
terms. Terms are found by an Aho-Corasick automaton in one pass over the url and
count only between boundaries, so "ads" is not found in "heads". The pass is one
narrow step over the table without a shuffle; the automaton is built once per
Python worker from the vocabulary, whose size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labmesh.llm.common import lower_ascii

# The vocabulary. Terms are lower case letters and digits.
STRICT = (
    "adult", "casino", "escort", "escorts", "hentai", "malware", "nude", "phishing", "pills",
    "porn", "porno", "slots", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "ad", "ads", "banner", "bet", "bets", "betting", "bonus", "cheap", "click", "coupon", "crack",
    "deal", "deals", "farm", "free", "gambling", "jackpot", "keygen", "loan", "loans", "lottery",
    "poker", "popup", "promo", "prize", "sex", "torrent", "track", "tracker", "tracking", "win",
    "winner",
)
SOFT_HITS = 2

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z in lower case; else empty."""
    return F.when(
        url.contains("://"), lower_ascii(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1))
    ).otherwise("")


def path(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.when(
        url.contains("://"), F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    ).otherwise("")


def _boundary(character: str) -> bool:
    return not (character.isascii() and character.isalnum())


@dataclass(frozen=True)
class Vocabulary:
    """Terms and the number of distinct soft terms that reject a url."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_hits: int = SOFT_HITS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term in self.soft:
            found.add_word(term, (term, False))
        for term in self.strict:
            found.add_word(term, (term, True))
        found.make_automaton()
        return found

    def hits(self, automaton: ahocorasick.Automaton, url: str) -> tuple[int, int]:
        """Distinct strict and soft terms that stand between boundaries."""
        strict, soft = set(), set()
        for end, (term, is_strict) in automaton.iter(url):
            start = end - len(term)
            if (start < 0 or _boundary(url[start])) and (
                end + 1 == len(url) or _boundary(url[end + 1])
            ):
                (strict if is_strict else soft).add(term)
        return len(strict), len(soft)


def _matched(rules: dict[str, list[tuple[str, str, str]]], name: str, where: str):
    """The longest rule whose host is `name` or a parent domain and whose path starts `where`."""
    best, at = None, 0
    while at >= 0:
        for prefix, rule, verdict in rules.get(name[at:], ()):
            if where.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        at = name.find(".", at) + 1 or -1
    return best or (None, None)


def url_verdicts(
    pages: DataFrame,
    url: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    vocabulary: Vocabulary = Vocabulary(),
) -> DataFrame:
    """The rows with host, path, rule, strict_hits, soft_hits and verdict.

    A rule is a host and a path prefix, "net/es/"; it fits its host and all
    subdomains. The longest fitting rule decides, of equally long ones the one
    with the longer host. Without a fitting rule the vocabulary decides, over the
    whole url. A NULL or empty url has no host, no path and no hits: allow.
    Columns of the given rows with one of the new names are replaced. Repeated
    rows are judged one by one; an empty table gives an empty result.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        by_host.setdefault(name, []).append(("/" + rest, rule, verdict))

    @F.pandas_udf("rule string, strict_hits int, soft_hits int, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = vocabulary.automaton()
        for hosts, paths, lowered in batches:
            out = []
            for name, where, text in zip(hosts, paths, lowered, strict=True):
                rule, verdict = _matched(by_host, name, where)
                strict, soft = vocabulary.hits(automaton, text) if text else (0, 0)
                bad = strict > 0 or soft >= vocabulary.soft_hits
                out.append((rule, strict, soft, verdict or ("block" if bad else "allow")))
            yield pd.DataFrame(out, columns=["rule", "strict_hits", "soft_hits", "verdict"])

    address = F.col(f"`{url}`")
    new = ("host", "path", "__judged", "rule", "strict_hits", "soft_hits", "verdict")
    rows = pages.select(
        *(F.col(f"`{c}`") for c in pages.columns if c not in new or c == url),
        host(address).alias("__host"),
        path(address).alias("__path"),
        F.coalesce(lower_ascii(address), F.lit("")).alias("__lowered"),
    )
    judged = rows.withColumn("__judged", judge("__host", "__path", "__lowered"))
    return judged.select(
        *(F.col(f"`{c}`") for c in pages.columns if c not in new),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        *(F.col(f"__judged.{c}").alias(c) for c in ("rule", "strict_hits", "soft_hits", "verdict")),
    )
