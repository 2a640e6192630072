"""Registered queries of the file-side operators on the given tables: the parsing
expressions of S5, S9, X3, X14, X15, X20, and A11, A20, A22, F12, J10, K5, S15,
U3, X2, X23, on columns that hold what the files would."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.functions import text as T
from penprint.operators import dedup as D
from penprint.plans import experiments as X
from penprint.plans.embed import embedding_to_source
from penprint.plans.q_text import CHAR_IDS_SQL
from penprint.plans.registry import register
from penprint.sources.catalog import batch_language_builds, parse_id_list
from penprint.sources.files import decode_bytes
from penprint.tables import spread, table


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


@register("s5_cluster_members", r"""WITH l AS (SELECT conv_id AS cluster, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
'/data/' || role || '/' || conv_id || '_' || turn || '.txt:1' AS path FROM conversations)
SELECT cluster, pos, path, regexp_extract(path, '.*/user/(.*)\..*:.*', 1) AS submission_id FROM l""")
def s5_cluster_members(spark, sf):
    """Conversations as duplicate clusters, one line for each turn."""
    c = table(spark, sf, "conversations")
    line = F.concat(F.lit("/data/"), "role", F.lit("/"), F.col("conv_id").cast("string"), F.lit("_"),
                    F.col("turn").cast("string"), F.lit(".txt:1"))
    blocks = c.groupBy(F.col("conv_id").alias("cluster")).agg(  # the turns of one conversation
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("p")))), lambda x: x["p"]),
                     "\n").alias("block"))
    return D.cluster_members(blocks, "user")


@register("s9_parse_id_list", "SELECT doc_id, [CAST(doc_id AS INTEGER), quality, toxic] AS ids FROM labels")
def s9_parse_id_list(spark, sf):
    """The bracketed id list of an encoded file, with its trailing comma."""
    lab = table(spark, sf, "labels")
    text = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in ("doc_id", "quality", "toxic")]),
                    F.lit(", ]"))
    return lab.select("doc_id", parse_id_list(text).alias("ids"))


@register("x3_decode_bytes", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def x3_decode_bytes(spark, sf):
    """Texts as Latin-1 bytes where all characters have one (else UTF-8),
    every third with a byte order mark of UTF-8, decoded again."""
    d = _docs(spark, sf).select("doc_id", "text")
    one_byte = ~F.col("text").rlike(r"[^\x{00}-\x{7f}\x{a0}-\x{ff}]")
    mark = F.when(F.col("doc_id") % 3 == 0, F.lit("\ufeff")).otherwise("")
    raw = F.when(one_byte & (F.col("doc_id") % 3 != 0), F.encode("text", "ISO-8859-1")).otherwise(
        F.encode(F.concat(mark, "text"), "UTF-8"))
    return d.select("doc_id", F.md5(decode_bytes(raw)).alias("text_md5"))


@register("x2_one_hot", f"""SELECT doc_id, len(ids) AS n_rows, len(list_filter(ids, lambda i: i < 98)) AS n_ones,
len(list_filter(ids, lambda i: i >= 98)) AS zero_rows FROM (SELECT doc_id, {CHAR_IDS_SQL} AS ids FROM documents)""")
def x2_one_hot(spark, sf):
    """One-hot rows of the character ids; the unknown id gives a zero row."""
    # the ids are bound once, so the encoder runs once for each document; a row of
    # zeros and ones adds up to the number of its cells that are not zero
    per_row = F.transform(F.array(T.char_encode("text")), lambda ids: F.transform(
        T.one_hot(ids, 98), lambda row: F.size(F.array_remove(row, F.lit(0)))))[0]
    counts = F.transform(F.array(per_row), lambda r: F.struct(
        F.size(r).cast("long").alias("n_rows"),
        F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ones"),
        F.size(F.filter(r, lambda x: x == 0)).cast("long").alias("zero_rows")))[0]
    return _docs(spark, sf).select("doc_id", counts.alias("c")).select("doc_id", "c.*")


@register("x14_cut_line_bytes", """SELECT doc_id, list_transform(string_split(text, chr(10))[1:20],
lambda l: left(hex(encode(l)), 80)) AS lines FROM documents""")
def x14_cut_line_bytes(spark, sf):
    """X14 in bytes: the first 20 lines, 40 bytes of each (as hexadecimal)."""
    return _docs(spark, sf).select("doc_id", F.transform(T.cut_line_bytes("text", 20, 40), lambda b: F.hex(b))
                                   .alias("lines"))


@register("x15_cut_bytes", "SELECT doc_id, left(hex(encode(text)), 201 * 2) AS head FROM documents")
def x15_cut_bytes(spark, sf):
    """X15 in bytes: the first 201 bytes (as hexadecimal)."""
    return _docs(spark, sf).select("doc_id", F.hex(T.cut_bytes("text", 201)).alias("head"))


_A11 = """SELECT md5(text) AS cluster, count(*) AS copies, count(DISTINCT source) AS authors, max(length(text)) AS length
FROM documents GROUP BY md5(text) HAVING count(DISTINCT source) > 1"""


@register("a11_cluster_rows", f"""SELECT md5(text) AS cluster, doc_id, source FROM documents
WHERE md5(text) IN (SELECT cluster FROM ({_A11}))""")
def a11_cluster_rows(spark, sf):
    """The members of the clusters that several authors share."""
    d = _docs(spark, sf)
    return D.cluster_rows(d, D.cross_author_duplicates(d, "doc_id", "source"), "doc_id", "source")


@register("k5_order_clusters", f"""SELECT cluster, CAST(length AS BIGINT) AS length,
row_number() OVER (ORDER BY length, cluster) - 1 AS rank FROM ({_A11})""")
def k5_order_clusters(spark, sf):
    """K5: those clusters in order of text length."""
    g = D.order_clusters_by_length(D.cross_author_duplicates(_docs(spark, sf), "doc_id", "source"))
    return g.select("cluster", F.col("length").cast("long").alias("length"), F.col("rank").cast("long").alias("rank"))


@register("u3_union_duplicates", """WITH d AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY lang, md5(text)) AS f FROM documents)
SELECT DISTINCT doc_id FROM d WHERE lang IN ('en', 'fr') AND doc_id <> f""")
def u3_union_duplicates(spark, sf):
    """Duplicate ids of two languages in one table."""
    d = _docs(spark, sf)
    parts = [D.duplicates_from_clusters(D.content_clusters(d.where(F.col("lang") == x), "doc_id"), "doc_id")
             for x in ("en", "fr")]
    return D.union_duplicates(*parts)


@register("a20_best_epoch", """SELECT combination, epoch, train_loss, val_loss FROM (SELECT conv_id AS combination, turn AS epoch,
CAST(turn * 2 AS BIGINT) AS train_loss, length(text) AS val_loss,
row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS rk FROM conversations) WHERE rk = 1""")
def a20_best_epoch(spark, sf):
    """Conversations as training histories (turn = epoch)."""
    c = table(spark, sf, "conversations")
    hist = c.select(F.col("conv_id").alias("combination"), F.col("turn").alias("epoch"), (F.col("turn") * 2).alias("loss"),
                    F.length("text").cast("long").alias("val_loss"))
    return X.best_epoch(hist).select("combination", "epoch", "train_loss", "val_loss")


@register("a22_upsert_results", """WITH r AS (SELECT nullif(role, 'assistant') AS model, conv_id % 10 AS k, turn % 5 AS run_ts,
CASE WHEN turn % 2 = 1 THEN conv_id END AS note, length(text) AS score, turn % 2 AS is_new FROM conversations)
SELECT model, k, run_ts, score, note FROM (SELECT *, row_number() OVER (PARTITION BY model, k
  ORDER BY run_ts DESC, is_new DESC, score DESC, note DESC NULLS LAST) AS rk FROM r) WHERE rk = 1""")
def a22_upsert_results(spark, sf):
    """Even turns as stored results, odd ones as new (with a column more);
    one key is null, and many rows tie on time."""
    c = table(spark, sf, "conversations").select(
        F.nullif("role", F.lit("assistant")).alias("model"), (F.col("conv_id") % 10).alias("k"),
        (F.col("turn") % 5).alias("run_ts"), F.length("text").cast("long").alias("score"), "turn", "conv_id")
    old = c.where("turn % 2 = 0").drop("turn", "conv_id")
    new = c.where("turn % 2 = 1").withColumnRenamed("conv_id", "note").drop("turn")
    return X.upsert_results(old, new, ["model", "k"]).select("model", "k", "run_ts", "score", "note")


@register("f12_select_combinations", """SELECT doc_id AS combination, quality FROM labels
WHERE doc_id IN (0, 3, 4, 5, 6, 7, 8, 9, 12)""")
def f12_select_combinations(spark, sf):
    """rows of the combinations named by a range expression."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("combination"), "quality")
    return lab.join(X.select_combinations(spark, "0 3:10 12"), "combination")


@register("x20_parse_params", """SELECT doc_id, CAST(doc_id AS VARCHAR) AS c, 'rbf' AS kernel,
CASE WHEN toxic = 1 THEN 'True' ELSE 'False' END AS probability FROM labels""")
def x20_parse_params(spark, sf):
    """A dictionary literal of model parameters."""
    lab = table(spark, sf, "labels")
    text = F.format_string("{'C': %s, 'kernel': 'rbf', 'probability': %s}", F.col("doc_id").cast("string"),
                           F.when(F.col("toxic") == 1, "True").otherwise("False"))
    m = lab.select("doc_id", text.alias("model_params")).select("doc_id", X.parse_params().alias("m"))
    return m.select("doc_id", F.col("m")["C"].alias("c"), F.col("m")["kernel"].alias("kernel"),
                    F.col("m")["probability"].alias("probability"))


@register("x23_flip_label", "SELECT doc_id, 1 - toxic AS label FROM labels")
def x23_flip_label(spark, sf):
    return table(spark, sf, "labels").select("doc_id", T.flip_label("toxic").alias("label"))


@register("j10_embedding_to_source", """SELECT vec_id, md5(text) AS text_md5, len(embedding) AS dim FROM embeddings
JOIN documents ON doc_id = vec_id""")
def j10_embedding_to_source(spark, sf):
    """Embeddings with the text of their source file."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    files = _docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "text")
    return embedding_to_source(emb, files, "vec_id").select(
        "vec_id", F.md5("text").alias("text_md5"), F.size("embedding").cast("long").alias("dim"))


@register("s15_batch_language_builds", r"""WITH p AS (SELECT page_id, regexp_extract(split_part(url, '/', 3), '\.([^./]*)$', 1) AS ext FROM pages),
g(language_group, ext) AS (VALUES ('a', 'com'), ('b', 'com'), ('b', 'org'), ('c', 'net'))
SELECT page_id, p.ext, language_group FROM p JOIN g ON p.ext = g.ext""")
def s15_batch_language_builds(spark, sf):
    """Pages by groups of host endings; an ending may belong to several."""
    p = table(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "/"), 3).alias("filepath"))
    groups = [("a", "com"), ("b", "com"), ("b", "org"), ("c", "net")]
    return batch_language_builds(p, groups=groups).select("page_id", "ext", "language_group")
