"""Corpus build (M14, S14) and materialised training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions import text as T
from penprint.operators import dedup as D
from penprint.operators import sampling as S


def prepare_corpus(docs: DataFrame, min_size: int = 100, val: float = 0.1, test: float = 0.1, seed="p",
                   id_col: str = "doc_id", author: str = "source", text: str = "text"):
    """Size filter (F2) -> exact-duplicate removal (S5/J2) -> author-disjoint
    split (W1/J8) -> character encoding (X1), with the one-pass audit (S14).
    Returns (corpus (split, file_id, author, n_ids, ids), audit)."""
    files = docs.select(F.col(id_col).alias("file_id"), F.col(author).alias("author"), F.col(text).alias("text"))
    dups = D.duplicates_from_clusters(D.content_clusters(files, "file_id"), "file_id")
    audit = D.ingest_audit(files, min_size, dups, "file_id")
    kept = D.drop_duplicates_by_cluster(files.where(F.octet_length("text") > min_size), dups, "file_id")
    splits = S.author_split(kept, val, test, seed)
    enc = S.split_membership(kept, splits).select("split", "file_id", "author", T.char_encode("text").alias("ids"))
    return enc.withColumn("n_ids", F.size("ids").cast("bigint")), audit


def materialise_simclr_samples(spark, docs: DataFrame, batch: int = 64, length: int = 500, seed="p",
                               epoch: int = 0, id_col: str = "doc_id", author: str = "source",
                               text: str = "text") -> DataFrame:
    """M17 (simclr layout): W9 batches -> character ids -> X11 crop with end
    markers -> X12 zero padding.  Output (epoch, sample_id, batch, input_1,
    input_2, label); ids stay arrays (no dense one-hot on disk)."""
    files = docs.select(F.col(id_col).alias("file_id"), F.col(author).alias("author"), F.col(text).alias("text"))
    n = files.count() // 2
    b = S.simclr_batches(spark, files.select("author", "file_id"), batch, n, seed)
    enc = files.select("file_id", T.pad_to(T.crop_prefix_with_end(T.char_encode("text"), length), length)
                       .alias("x"))
    out = (b.join(enc.select(F.col("file_id").alias("file_1"), F.col("x").alias("input_1")), "file_1")
           .join(enc.select(F.col("file_id").alias("file_2"), F.col("x").alias("input_2")), "file_2"))
    return out.select(F.lit(epoch).alias("epoch"), "sample_id", "batch", "input_1", "input_2",
                      F.lit(1).alias("label"))


def materialise_pairs(pairs: DataFrame, docs: DataFrame, kind: str, length: int = 200, max_lines: int = 10,
                      seed="p", epoch: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """M17, the pair layouts over (sample_id, label, file_1, file_2):

    * ``by_line``: S7 -> X14 (``max_lines`` lines of ``length`` characters) -> X1,
      every line padded with 0 to ``length`` + 2 ids;
    * ``combined``: S7 -> X15 (texts cut to ``length`` characters, one separator
      id -1) -> X1, in ``input_1`` (``input_2`` is null);
    * ``split``: X13 (a random window of ``length``) -> X1.
    """
    own = docs.select(F.col(id_col).alias("file"), F.col(text).alias("t"))
    p = (pairs.join(own.select(F.col("file").alias("file_1"), F.col("t").alias("t1")), "file_1")
         .join(own.select(F.col("file").alias("file_2"), F.col("t").alias("t2")), "file_2"))
    if kind == "by_line":
        one, two = (F.transform(T.truncate_lines(c, max_lines, length),
                                lambda ln: T.pad_to(T.char_encode(ln), length + 2)) for c in ("t1", "t2"))
    elif kind == "combined":
        a, b = (T.char_encode(T.truncate_text(c, length)) for c in ("t1", "t2"))
        one, two = T.concat_pair(a, b, F.lit(-1)), F.lit(None).cast("array<int>")
    elif kind == "split":
        one = T.char_encode(T.random_crop("t1", length, seed, "sample_id", "file_1"))
        two = T.char_encode(T.random_crop("t2", length, seed, "sample_id", "file_2"))
    else:
        raise ValueError(kind)
    return p.select(F.lit(epoch).alias("epoch"), "sample_id", one.alias("input_1"), two.alias("input_2"), "label")
