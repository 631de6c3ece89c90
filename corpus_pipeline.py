"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. In every stage null ids and columns of any name are kept as
they are, repeated rows are judged alike (and stay together), texts are taken whole, and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import jaccard, language, packing, quality, substrings
from helixframe.llm.queries import vocabulary
from helixframe.runtime import discard, prepare, settle


def know_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and blank texts too), or whose language stays open, go. The
    model learns from the rows of ``docs`` that have a label; without any, all go. Equal
    probabilities go to the language that is first by name."""
    prepare(spark)
    return language.keep_known(docs, language.fit(docs, language.load_pieces(vocabulary("piece_bpe_32k.model"))))


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts have too few words."""
    prepare(spark)
    return quality.keep_good(docs)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of smallest id. Null and blank texts
    are in no group; rows with a null id are never dropped."""
    prepare(spark)
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; earlier is by id, then by place, null ids
    last. Null and blank texts stay as they are; n_chars follows."""
    prepare(spark)
    return substrings.remove_repeats(docs)


def fill_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens; null and empty texts are their end id alone."""
    prepare(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", know_language),
    ("quality_rules", pass_rules),
    ("ngram_jaccard_join", join_near),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", fill_sequences),
]

#: The stages go beyond SQL (a trained model, a tokenizer); a test holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's result is written and read again."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        df = settle(stage(spark, df, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = df
    df = STAGES[-1][1](spark, df, sf_dir)  # has read all that it needs
    discard(before)
    return df
