"""Training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has written, and returns a
DataFrame.  All but the last return the columns of documents; further columns of docs are dropped, whatever their names.
An empty table gives an empty one.

Null and empty texts: language ID rejects them (no letter); every other stage keeps them, for they are near to nothing, hold no
item and have no tokens.  Texts are read whole at any length.  Rows without a doc_id can't be judged and leave at the first
stage; the others treat a null id as its operator says.  Rows that share an id are one document, of which near_dedup keeps the row that is least by
its columns; before that and in the other stages they stay or go together, and sharding places each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplenet.llm import common as c
from ripplenet.llm.hilbert import hilbert_shards
from ripplenet.llm.langid import identify
from ripplenet.llm.soft_mixing import mix_to_targets, quality_domains
from ripplenet.llm.superminhash import near_duplicates
from ripplenet.llm.templates import contaminated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share that one language must hold of a document.
MIN_LANGUAGE_SHARE = 0.5
#: Factors on the present expected tokens of each quality domain.
TARGETS = {"good": 1.0, "low": 0.5, "toxic": 0.0}
#: Where not all targets can be met, good documents are kept first.
WEIGHTS = {"good": 50.0}
# Joins by id carry the "merge" hint where the ids grow with the corpus: one plan at every size.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language holds its share; those without a letter go."""
    docs = docs.where("doc_id is not null").select(*COLUMNS)
    found = identify(docs, docs, carry=True).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return found.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Ties go to the smallest id.  Of rows that share an id one stays.
    """
    kept = near_duplicates(docs, shingle_words=5, percent=80).where("kept")
    rows = c.one_row_an_id(docs.select(*COLUMNS), "doc_id")
    return rows.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also none with other parameters."""
    leaks = contaminated(docs, c.table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return c.without(docs.select(*COLUMNS), leaks, "doc_id")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted rates draw, once at most."""
    labels = quality_domains(c.table(spark, sf_dir, "labels"))
    drawn = mix_to_targets(docs, labels, TARGETS, relative=True, max_rate=1.0, weights=WEIGHTS).where("copies > 0")
    return docs.join(drawn.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, with its text and metadata.

    Rows are told apart by a key that is written with them, so rows that share an id are placed each by itself.
    """
    scratch = c.Scratch(spark, "sharding")
    keyed = scratch.table(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()), "keyed", keep=True)
    placed = hilbert_shards(keyed, id_col="row_key").select(F.col("doc_id").alias("row_key"), "size", "text_crc32", "curve", "shard", "slot")
    return keyed.join(placed.hint("merge"), "row_key").drop("row_key")


STAGES: list = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: SuperMinHash groups, EM and gradient steps have no SQL form; tests compare stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = c.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        since = len(c.KEPT)
        written = scratch.table(stage(spark, docs, sf_dir), name)
        c.free(spark, since)  # the operators' results have been read
        scratch.drop(*[n for n, _ in STAGES if n != name])
        docs = written
    return docs
