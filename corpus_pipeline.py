"""The training-corpus pipeline: quality filter, near-dedup, passage dedup, mixing, tokens.

Each stage takes what the one before it wrote and works on all of it; its decisions take effect on the rows
or texts that it returns. ``run`` writes every stage's rows as Parquet to the shared folder of the session
and reads them again, so a lost executor costs the tasks of one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import bpe, mixing, probminhash, quality, suffix_dedup
from locusframe.llm.common import shared_dir, table
from locusframe.llm.queries import vocabulary


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with all columns but those that stages work on renamed, and what gives the names back.

    Columns of any name, those that an operator adds included, thus keep their values.
    """
    used = ("doc_id", "text", "source", "n_chars")
    names = {c: c if c in used else f"__own{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; its trees are learnt from the table of labels.

    Every row is judged by its text: repeated rows alike, null and empty texts by all-zero statistics.
    """
    own, named = _apart(docs)
    trees = quality.train(own, table(spark, sf_dir, "labels"))
    return named(quality.score(own, trees, keep=own.columns).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest identifier, null the last.

    Null and empty texts are one class; equal rows count once.
    """
    own, named = _apart(docs)
    return named(probminhash.deduplicate(own))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller identifiers have; rows with nothing left, or nothing to begin with, go."""
    own, named = _apart(docs)
    left = suffix_dedup.remove_repeats(own).where("text <> ''")
    return named(left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: a row for each copy taken, range-sorted by training position.

    A copy that is taken in part has the text's first words only. Texts without words are taken like others, and
    take nothing of a source's target; a null source is one of its own.
    """
    own, named = _apart(docs)
    copies = mixing.stream(mixing.assign(own))
    text = F.when(F.col("words") < F.col("size"), mixing.first_words("text", F.col("words"))).otherwise(F.col("text"))
    chars = F.when(F.col("words") < F.col("size"), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    changed = {"text": text.alias("text"), "n_chars": chars.alias("n_chars")}
    return named(copies.select(*[changed.get(c, F.col(c)) for c in own.columns]))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and the length of the readable text that the decoder makes of them; null texts have none."""
    tokens = bpe.token_column(docs.select("doc_id", "source", "text"), vocabulary("word_bpe_49k.json"), decode=True)
    return tokens.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), F.length("decoded_text").cast("long").alias("readable_chars"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("passage_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: SQL can't express the classifier, the sketches or the tokenizer; ``tests/llm/test_pipeline_stages.py`` holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
