"""From raw documents to token ids: quality, near copies, mixture, encoding.

Each stage reads what the one before it wrote. The first three return the columns
they got, further ones included; a column of the documents that an operator would add
too is never overwritten. The last puts token ids in the place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labmesh.llm.common import WORD, table
from labmesh.llm.minhash import near_duplicates
from labmesh.llm.mixing import mix_sources
from labmesh.llm.pieces import encode_round_trip, load_pieces
from labmesh.llm.quality import THRESHOLD, score_quality, train_quality
from labmesh.llm.queries import TOKENIZER, label_weights
from labmesh.sources.scratch import fresh_folder


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above.

    The trees are fitted on labelled documents among the given ones. An empty
    table, or one without labels, has a constant score and loses nothing.
    """
    trees = train_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, trees, score="__score")
    return scored.filter(F.col("__score") >= THRESHOLD).select(*_columns(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows that share that id count as one, the first by text. Rows without an id
    belong to no group and stay.
    """
    found = near_duplicates(docs, words=5, percent=80)
    ids = found.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(ids, "doc_id", "left_semi").select(F.struct(*_columns(docs)).alias("row"))
    # One row per id is kept before anything is shuffled, however often an id repeats.
    first = named.groupBy("row.doc_id").agg(F.min_by("row", F.struct("row.text")).alias("row")).select("row.*")
    return first.unionByName(docs.filter(F.col("doc_id").isNull()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, one row for each time it takes them.

    Documents without words are never taken, also not if their id has others. Rows
    without an id are counted in the mixture but can't be named by it: they stay, once
    each. Rows that share an id are taken as often as the one that is taken most.
    """
    taken = mix_sources(docs, quality=label_weights(spark, sf_dir)).filter("taken > 0")
    times = taken.groupBy("doc_id").agg(
        F.max(F.floor(F.col("taken") / F.col("size"))).cast("int").alias("__times")
    )
    some = F.col("text").rlike(WORD)
    rows = docs.filter(some).join(times, "doc_id").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))
    )
    return rows.select(*_columns(docs)).unionByName(docs.filter(F.col("doc_id").isNull()))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with token_ids, n_tokens and round_trip in place of the text.

    round_trip says whether the ids decode to the text. NULL and empty texts have no
    ids and come back; repeated rows get equal ids. Further columns stay, but for
    those that are called like the new ones. An empty table gives an empty result.
    """
    coded = encode_round_trip(docs.drop("n_tokens"), load_pieces(TOKENIZER))
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", one_of_each),
    ("mixing", mixed),
    ("encoding", encoded),
]

# A fitted classifier and Viterbi have no SQL form: tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
