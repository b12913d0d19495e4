"""From raw documents to token ids: the stages, each over all that the one before has kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchrank.llm import toxicity
from pitchrank.llm.decontam import find_items
from pitchrank.llm.minhash import near_duplicates
from pitchrank.llm.queries import piece_ids
from pitchrank.llm.substring import mark_repeats
from pitchrank.session import materialize


READ = ("doc_id", "text", "n_chars")  # what the stages themselves read or change


def stage(fn):
    """A stage that leaves the user's other columns alone, whatever names it uses itself.

    They go through under other names. One named like a column that the stage adds to its
    result is replaced by that.
    """
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = {c: f"_own_{c}" for c in docs.columns if c not in READ}
        done = fn(spark, docs.withColumnsRenamed(away), sf_dir)
        replaced = [c for c in away if c in done.columns]
        return done.drop(*[away[c] for c in replaced]).withColumnsRenamed({v: k for k, v in away.items()})

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.5 or more; learns from all labelled ones.

    If the labels tell nothing (there are none, none of a document, or no term leans to
    toxic ones), every score is the same and says nothing of a document; all are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    index = toxicity.fit(docs, labels)
    if not index.terms:
        return docs
    return toxicity.score(docs, index).where("score < 0.5").select(*docs.columns)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, once.

    Documents without a text or an id are in no group and stay. Different texts under one id
    are different documents; of rows equal in id and text one stays.
    """
    done = near_duplicates(docs)
    lone = F.col("doc_id").isNull() | F.col("text").isNull()
    stands = done.where(~lone & (F.col("class_id") == F.col("doc_id")) & (F.col("class_key") == F.md5("text")))
    return stands.dropDuplicates(["doc_id", "class_key"]).select(*docs.columns).unionByName(
        done.where(lone).select(*docs.columns))


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 13 words or more that an earlier document has.

    A document all of whose words go is dropped; ``n_chars`` follows the text.
    """
    done = mark_repeats(docs, keep_layout=True)
    gone = F.aggregate("removed", F.lit(0), lambda n, run: n + run["last"] - run["first"] + F.lit(1))
    done = done.where((gone < F.col("n_words")) | (F.col("n_words") == 0)).withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        chars = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_items(docs, items).where(F.size("hits") == 0).select(*docs.columns)


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of each text and checks that they decode to it."""
    return piece_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

# Learned scores, hashed signatures and subword ids are beyond SQL; tests/llm compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
