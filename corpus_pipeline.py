"""The corpus pipeline: stages over documents, each written and read again before the next.

Every stage works on all that its predecessor kept. All but the last return the columns of documents,
with n_chars brought up to date where a text was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.decontaminate import decontaminate
from feedloom.llm.line_dedup import dedup_lines
from feedloom.llm.ngram_model import held_out
from feedloom.llm.pieces import encode_pieces
from feedloom.llm.simhash import near_duplicates
from feedloom.llm.toxicity import score_toxicity, train_tagger
from feedloom.llm.words import set_aside, with_row_key
from feedloom.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below a half; the tagger learns from the labels that are not held out.

    Without labelled documents of both kinds the score of all texts is the share of toxic labels.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"), 5))
    tagger = train_tagger(docs, labels)
    return score_toxicity(docs, tagger).filter("toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated line runs of 50 words or more."""
    cut = dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id; of rows that share it, one.

    Documents without an id are kept only where their whole group has none, and then one of them.
    """
    renamed, back, _ = set_aside(docs)
    numbered = with_row_key(renamed, "_row")
    classes = near_duplicates(numbered.select("_row", "doc_id", "text"), extra=("_row",))
    # the first row of a group by id, nulls last, then by place
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    kept = classes.groupBy("_part").agg(first["_row"].alias("_row"))
    return numbered.join(kept, "_row", "left_semi").drop("_row").withColumnsRenamed(back).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    renamed, back, _ = set_aside(docs)
    numbered = with_row_key(renamed, "_row_of_document")
    found = decontaminate(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("_row_of_document",))
    clean = found.filter(~F.col("contaminated")).select("_row_of_document")
    kept = numbered.join(clean, "_row_of_document", "left_semi").drop("_row_of_document")
    return kept.withColumnsRenamed(back).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and two sampled segmentations of every document, and whether the ids decode to its text."""
    encoded = encode_pieces(docs.select("doc_id", "lang", "source", "text"), k=2, decoded="decoded")
    round_trip = F.col("decoded") == F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", round_trip.alias("round_trip"), "samples")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The trained, sampled and iterated stages cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
