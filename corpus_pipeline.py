"""From raw documents to token ids: toxicity, near duplicates, repeated passages, benchmark items, BPE.

``run`` writes the result of every stage to the shared folder and gives it to the next. Stages keep rows and
columns they have no reason to touch: a null text is never toxic, linked, cut or contaminated.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from promolens.llm import op2_ngram_jaccard_join as near  # noqa: E402
from promolens.llm import op4_bpe as bpe  # noqa: E402
from promolens.llm import op6_substring_dedup as passages  # noqa: E402
from promolens.llm import op7_decontamination as leaks  # noqa: E402
from promolens.llm import op10_toxicity as toxicity  # noqa: E402
from promolens.llm.ship import ship  # noqa: E402
from promolens.llm.staging import stage, table  # noqa: E402

#: Repeats of this many words and more are cut.
PASSAGE_WORDS = 50
#: SQL can't express the model, the merge rounds and the linked groups on whole tables; tested by brute force.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as ``row``, out of reach of the operators' own column names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("__")).alias("row"))


def unpacked(df: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` again."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`") for c in docs.columns}
    return df.select(*[column.alias(c) for c, column in (own | changed).items()])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model of ``sf_dir``'s labels rejects go."""
    ship(spark)
    return unpacked(toxicity.rated(packed(docs), table(spark, sf_dir, "labels")).where("predicted = 0"), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: five-word shingles, Jaccard 0.8."""
    ship(spark)
    return near.one_of_each(docs, n=5, percent=80)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word sequences that occur again are cut from the texts; n_chars follows where there is one."""
    ship(spark)
    cut, changed = passages.remove_repeats(packed(docs), length=PASSAGE_WORDS), {}
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
        changed["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return unpacked(cut, docs, **changed)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of an item's five-word shingles go."""
    ship(spark)
    return unpacked(leaks.marked(packed(docs), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0), docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and whether they decode to them."""
    ship(spark)
    path = bpe.vocabulary()
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_duplicates),
    ("substring_dedup", without_passages),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
