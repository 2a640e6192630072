"""Corpus pipeline: language ID, near-duplicate removal, repeated-string removal,
benchmark decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  All stages but the last return the columns of their input,
whatever those are; ``doc_id``, ``text`` and (first stage) ``lang`` are used.

Null ids are addressed by a number made from the row's text, above every real id
(``_known``), so such rows take part like all others; their ids stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from penprint.llm import decontaminate, jaccard, language, packing, suffixes
from penprint.llm.frames import bounded_batches, saved

_NONE = 1 << 62


def _known():
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"),
                      F.xxhash64(text).bitwiseAND(F.lit(_NONE - 1)).bitwiseOR(F.lit(_NONE)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter and those
    whose nearest codeword is ambiguous go.  Learned from the labelled rows;
    without any, only documents without a letter go."""
    bounded_batches(spark)
    model = language.train(docs)
    return language.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest
    id, once if its row is repeated.  Linked are sets of five-word shingles with
    a similarity of 0.8 or more; op6's query has a contract of its own."""
    bounded_batches(spark)
    rows = docs.withColumn("__id", _known())
    links = jaccard.link_documents(rows.select("__id", "text"), "__id", size=5, num=80, den=100)
    kept = (links.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id"))
            .agg(F.count("*").alias("__rows")))
    own = rows.join(kept, "__id")
    once = own.where("__rows = 1")
    many = (own.where("__rows > 1").withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
            .dropDuplicates(["__id", "__text"]))
    return once.select(*docs.columns).unionByName(many.select(*docs.columns))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document already has, cut
    at whole characters; a document that loses all its text goes.  ``n_chars``,
    where present, is counted anew."""
    return suffixes.rewrite(docs.withColumn("__id", _known()), "__id", docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = docs.withColumn("__id", _known())
    leaks = decontaminate.find_leaks(rows.select("__id", "text"),
                                     spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__id")
    gone = leaks.select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).distinct()
    return (rows.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
            .join(gone, ["__id", "__hash"], "left_anti").select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into training sequences."""
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

# No SQL expresses the classifier or the tokenizer; tests/llm compares run() with
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
