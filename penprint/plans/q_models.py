"""Registered queries for contrastive sampling/losses, subwords, classifiers,
projections, text embeddings and the composed corpus/sample jobs (W10, A16,
A17, X7, X8, M2, M3, M11, M12, M14, M17)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from penprint.functions import text as T
from penprint.functions.rng import sql_h
from penprint.operators import bpe
from penprint.operators import sampling as S
from penprint.operators.losses import simclr_loss, simclr_loss_matrix
from penprint.plans.classifiers import cross_validate, first_fold_holdout, stratified_split
from penprint.plans.closed_set import closed_set, closed_set_neighbours, fold_accuracy
from penprint.plans.corpus import materialise_simclr_samples, prepare_corpus
from penprint.plans.embed import char_ngram_counts, char_ngram_embeddings, embed_sequences, project_pca
from penprint.operators.votes import mode_vote
from penprint.plans.registry import register
from penprint.plans.sqlparts import cosine_sql, distinct_sql
from penprint.tables import files_from_embeddings, spread, table

SEED = "p"
MAX_AUTHORS = 1600  # F7
K = 9


def H(tag, *e):
    return sql_h(SEED, tag, *e)


# ------------------------------------------------------------------ W10

W10_SQL = f"""WITH e0 AS (SELECT vec_id AS file_id, label AS author, embedding FROM embeddings),
keep AS (SELECT author FROM (SELECT author FROM e0 GROUP BY author HAVING count(*) >= 2) ORDER BY author LIMIT 1500),
e AS (SELECT * FROM e0 WHERE author IN (SELECT author FROM keep)),
gi AS (SELECT *, row_number() OVER (ORDER BY author, {H('w10g', 'file_id')}, file_id) - 1 AS gidx FROM e),
nall AS (SELECT count(*) AS n FROM gi),
blocks AS (SELECT author, min(gidx) AS start, count(*) AS n_files FROM gi GROUP BY author),
grp AS (SELECT author, (SELECT n FROM nall) - n_files AS sp, least(50, (SELECT n FROM nall) - n_files) AS q FROM blocks),
{distinct_sql('grp', 'author', 'w10')},
dr AS (SELECT dv.author, CASE WHEN dv.value < b.start THEN dv.value ELSE dv.value + b.n_files END AS gidx
       FROM dv JOIN blocks b USING (author))
SELECT dr.author, own.file_id AS own_id, oth.file_id AS other_id,
       round({cosine_sql('own.embedding', 'oth.embedding')}, 9) AS similarity
FROM dr JOIN gi oth ON oth.gidx = dr.gidx JOIN gi own ON own.author = dr.author"""


@register("w10_diff_author_sample", W10_SQL)
def w10_diff_author_sample(spark, sf):
    """50 other-author embeddings per author x all own embeddings (cosine)."""
    out = S.diff_author_sample(files_from_embeddings(spark, sf), 50, 1500, SEED)
    return out.select("author", "own_id", "other_id", F.round("similarity", 9).alias("similarity"))


# ------------------------------------------------------------------ A16 / A17

def _views(spark, sf, batch=8):
    e = files_from_embeddings(spark, sf)
    b = S.simclr_batches(spark, e.select("author", "file_id"), batch, e.count() // 4, SEED)
    v = e.select(F.col("file_id"), F.col("embedding"))
    return (b.join(v.select(F.col("file_id").alias("file_1"), F.col("embedding").alias("v1")), "file_1")
            .join(v.select(F.col("file_id").alias("file_2"), F.col("embedding").alias("v2")), "file_2"))


def _a16_sql(batch=8, temperature=1.0):
    from penprint.plans.q_sampling import simclr_sql
    sel = simclr_sql(batch, files="f AS (SELECT label AS author, vec_id AS file_id FROM embeddings)")
    return f"""WITH sel AS ({sel}),
v AS (SELECT s.batch, s.slot, e1.embedding AS v1, e2.embedding AS v2 FROM sel s
      JOIN embeddings e1 ON e1.vec_id = s.file_1 JOIN embeddings e2 ON e2.vec_id = s.file_2),
r AS (SELECT batch, slot AS i, 0 AS view, v1 AS z FROM v UNION ALL SELECT batch, slot, 1, v2 FROM v),
p AS (SELECT a.batch, a.i, a.view, b.i AS j, b.view AS vj, {cosine_sql('a.z', 'b.z')} / {temperature!r} AS logit
      FROM r a JOIN r b ON a.batch = b.batch WHERE NOT (a.view = b.view AND a.i = b.i)),
pm AS (SELECT *, max(logit) OVER (PARTITION BY batch, i, view) AS m FROM p),
lse AS (SELECT batch, i, view, any_value(m) + ln(sum(exp(logit - m))) AS lse FROM pm GROUP BY batch, i, view),
pos AS (SELECT batch, i, view, logit AS pos FROM p WHERE view <> vj AND i = j)
SELECT batch, round(avg(lse - pos), 6) AS loss FROM lse JOIN pos USING (batch, i, view) GROUP BY batch"""


@register("a16_simclr_loss", _a16_sql())
def a16_simclr_loss(spark, sf):
    """Contrastive (NT-Xent) loss of W9 batches of 8 authors over the embeddings."""
    return simclr_loss(_views(spark, sf)).select(F.col("batch").cast("int").alias("batch"),
                                                 F.round("loss", 6).alias("loss"))


@register("a17_simclr_loss_matrix", _a16_sql())
def a17_simclr_loss_matrix(spark, sf):
    """The same loss from the stacked 2b x 2b similarity (must equal A16)."""
    return simclr_loss_matrix(_views(spark, sf)).select(F.col("batch").cast("int").alias("batch"),
                                                        F.round("loss", 6).alias("loss"))


# ------------------------------------------------------------------ X7 / X8

X7_SQL = r"""WITH w AS (SELECT unnest(regexp_split_to_array(replace(replace(replace(text, chr(0), ''), chr(9), '[TAB]'),
          chr(10), '[EOL]' || chr(10)), '[ \t\n\r\f\v]+')) AS word FROM documents),
wc AS (SELECT word, count(*) AS freq FROM w WHERE length(word) > 0 GROUP BY word),
s AS (SELECT freq, regexp_extract_all(word, '\[EOL\]|\[TAB\]|(?s:.)') AS ch FROM wc),
p AS (SELECT freq, ch[i] AS l, ch[i + 1] AS r FROM s, LATERAL (SELECT unnest(generate_series(1, len(ch) - 1)) AS i))
SELECT l AS "left", r AS "right", CAST(sum(freq) AS BIGINT) AS count FROM p GROUP BY l, r
ORDER BY count DESC, l, r LIMIT 100"""


@register("x7_bpe_pair_counts", X7_SQL)
def x7_bpe_pair_counts(spark, sf):
    """X7 round 1: the 100 most frequent adjacent character pairs over the
    word-frequency table of the whole corpus (top-k report)."""
    wc = bpe.word_counts(spread(table(spark, sf, "documents")))
    pc = bpe.pair_counts(wc)
    return pc.orderBy(F.col("count").desc(), "left", "right").limit(100)


N_MERGES = 20


def _merges_sql() -> str:
    """The merge rounds one after the other.  Every symbol stands between two
    chr(1), so replacing a pair never touches a neighbour's mark."""
    rounds = []
    for r in range(N_MERGES):
        rounds.append(f"""p{r} AS MATERIALIZED (SELECT l, r, CAST(sum(freq) AS BIGINT) AS n FROM (
  SELECT freq, ch[i] AS l, ch[i + 1] AS r FROM (SELECT freq, string_split(s[2:length(s) - 1], chr(1) || chr(1)) AS ch FROM w{r}),
  LATERAL (SELECT unnest(generate_series(1, len(ch) - 1)) AS i)) GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1)""")
        rounds.append(f"""w{r + 1} AS MATERIALIZED (SELECT freq, replace(s, chr(1) || l || chr(1) || chr(1) || r || chr(1),
  chr(1) || l || r || chr(1)) AS s FROM w{r}, p{r})""")
    head = X7_SQL[:X7_SQL.index("\ns AS")]
    out = " UNION ALL ".join(f'SELECT {r} AS rank, l AS "left", r AS "right", n AS count FROM p{r}' for r in range(N_MERGES))
    return f"""{head}
w0 AS MATERIALIZED (SELECT freq, list_aggregate(list_transform(regexp_extract_all(word, '\\[EOL\\]|\\[TAB\\]|(?s:.)'),
  lambda x: chr(1) || x || chr(1)), 'string_agg', '') AS s FROM wc),
{", ".join(rounds)}
{out}"""


@register("x7_learn_merges", _merges_sql())
def x7_learn_merges(spark, sf):
    """The first 20 byte-pair merges learned from the corpus."""
    merges = bpe.learn_merges(spread(table(spark, sf, "documents")), N_MERGES)
    return spark.createDataFrame([(i, l_, r_, c) for i, (l_, r_, c) in enumerate(merges)],
                                 "rank int, left string, right string, count long")


@register("x8_subword_encode", """SELECT doc_id, md5(replace(replace(replace(text, chr(0), ''), chr(9), '[TAB]'),
chr(10), '[EOL]' || chr(10))) AS rebuilt_md5, true AS framed, true AS numbered FROM documents""")
def x8_subword_encode(spark, sf):
    """Every document encoded with the 20 learned merges.  The pieces joined
    are the cleaned text; the ids stand between BOS and EOS, one for each piece."""
    docs = spread(table(spark, sf, "documents"))
    merges = bpe.learn_merges(docs, N_MERGES)
    enc = bpe.subword_encode(docs, merges, vocab=bpe.vocabulary(bpe.word_counts(docs), merges))
    return enc.select("doc_id", F.md5(F.array_join("pieces", "")).alias("rebuilt_md5"),
                      ((F.col("ids")[0] == bpe.BOS) & (F.element_at("ids", -1) == bpe.EOS)).alias("framed"),
                      (F.size("ids") == F.size("pieces") + 2).alias("numbered"))


# ------------------------------------------------------------------ M2 / M3 / M11 / M12


def _cs(spark, sf):
    return closed_set(files_from_embeddings(spark, sf), K, MAX_AUTHORS, SEED).persist()


@register("m2_random_forest_cv", None)
def m2_random_forest_cv(spark, sf):
    """M2: 9-fold random-forest accuracy on the closed set."""
    return cross_validate(_cs(spark, sf), "random_forest", {"n_estimators": 50})


@register("m3_svm_cv", None)
def m3_svm_cv(spark, sf):
    """M3: 9-fold accuracy of one-vs-rest machines with an RBF kernel (C = 100)
    on the closed set."""
    return cross_validate(_cs(spark, sf), "svm", {"C": 100.0})


@register("m11_project_pca", None)
def m11_project_pca(spark, sf):
    """M11 + A19: 2-D PCA of the closed set with explained-variance ratios."""
    proj, ratio = project_pca(_cs(spark, sf), 2)
    return proj.select("file_id", "label", "fold", "pcs",
                       F.array(*[F.lit(float(r)) for r in ratio]).alias("explained_variance"))


@register("m12_char_trigram_counts", """WITH c AS (SELECT doc_id, string_split(text, '') AS ch FROM documents),
g AS (SELECT doc_id, ch[i] || ch[i + 1] || ch[i + 2] AS gram FROM c,
      LATERAL (SELECT unnest(generate_series(1, len(ch) - 2)) AS i))
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram
ORDER BY n DESC, gram LIMIT 100""")
def m12_char_trigram_counts(spark, sf):
    """M12(b) terms: the 100 most frequent character trigrams over all
    documents, with document frequency (the raw counts behind HashingTF/IDF)."""
    docs = spread(table(spark, sf, "documents"))
    c = char_ngram_counts(docs, "text", "doc_id", 3)
    return c.orderBy(F.col("n").desc(), "gram").limit(100)


@register("m12_text_closed_set_knn", None)
def m12_text_closed_set_knn(spark, sf):
    """M12(b) + M1: character-trigram TF-IDF embeddings of the documents,
    then the 9-fold closed-set 1-NN accuracy by source."""
    docs = spread(table(spark, sf, "documents"))
    # the set is drawn from ids; only its texts need vectors, weighted by all texts
    files = docs.select("doc_id").join(docs.select("doc_id", "source"), "doc_id").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("author"))
    chosen = closed_set(files, K, None, SEED).persist()
    emb = char_ngram_embeddings(docs, "text", "doc_id", wanted=chosen.select(F.col("file_id").alias("doc_id")))
    emb = emb.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "file_id")
    cs = chosen.join(emb, "file_id").persist()
    return fold_accuracy(mode_vote(closed_set_neighbours(cs, 1)))


def _linear_model():
    """A fixed model without training: character c adds weight ((c + 1)(k + 3)) mod 11 - 5
    to dimension k."""
    weights = (np.arange(1, 100)[:, None] * (np.arange(4) + 3)) % 11 - 5.0

    def predict(ids, lengths):
        inside = np.arange(ids.shape[1]) < lengths[:, None]
        return np.stack([(w[ids] * inside).sum(axis=1) for w in weights.T], axis=1)
    return predict


def _m12_model_sql() -> str:
    from penprint.plans.q_text import CHAR_IDS_SQL
    dims = ", ".join(f"CAST(list_sum(list_transform(ids, lambda c: ((c + 1) * {k + 3}) % 11 - 5)) AS DOUBLE) AS x{k}"
                     for k in range(4))
    norm = "sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3)"
    out = ", ".join(f"round(CASE WHEN {norm} = 0 THEN 0 ELSE x{k} / {norm} END, 6) AS e{k}" for k in range(4))
    return f"""WITH e AS (SELECT doc_id, {CHAR_IDS_SQL} AS ids FROM documents),
v AS (SELECT doc_id, {dims} FROM e)
SELECT doc_id, {out} FROM v"""


@register("m12_model_embeddings", _m12_model_sql())
def m12_model_embeddings(spark, sf):
    """M12(a) + D2: character ids of whole documents through a fixed linear model,
    in length-sorted padded batches; unit vectors."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", T.char_encode("text").alias("ids"))
    emb = embed_sequences(docs, _linear_model, "fixed linear, 4 dimensions", "doc_id", double=True)
    return emb.select("doc_id", *[F.round(F.col("embedding")[k], 6).alias(f"e{k}") for k in range(4)])


# ------------------------------------------------------------------ M14 / M17


def _m14_sql() -> str:
    from penprint.plans.q_text import CHAR_IDS_SQL
    return f"""WITH f AS (SELECT doc_id AS file_id, source AS author, text FROM documents),
c AS (SELECT file_id, min(file_id) OVER (PARTITION BY md5(text)) AS first FROM f),
kept AS (SELECT f.* FROM f JOIN c USING (file_id) WHERE c.file_id = c.first AND strlen(f.text) > 100),
au AS (SELECT DISTINCT author FROM kept),
na AS (SELECT count(*) AS a FROM au),
r AS (SELECT author, row_number() OVER (ORDER BY {H('split', 'author')}, author) - 1 AS rk FROM au),
sp AS (SELECT author, CASE WHEN rk < floor(0.1 * (SELECT a FROM na)) THEN 'val'
                      WHEN rk < 2 * floor(0.1 * (SELECT a FROM na)) THEN 'test' ELSE 'train' END AS split FROM r),
enc AS (SELECT sp.split, kept.file_id, kept.author, {CHAR_IDS_SQL} AS ids FROM kept JOIN sp USING (author))
SELECT split, file_id, author, ids, len(ids) AS n_ids FROM enc"""


@register("m14_prepare_corpus", _m14_sql())
def m14_prepare_corpus(spark, sf):
    """Documents as a corpus: size filter, duplicate removal, author split,
    character encoding."""
    corpus, _audit = prepare_corpus(spread(table(spark, sf, "documents")), seed=SEED)
    return corpus


def _m17_sql() -> str:
    from penprint.plans.q_sampling import simclr_sql
    from penprint.plans.q_text import CHAR_IDS_SQL
    batches = simclr_sql(16, "f AS (SELECT doc_id AS file_id, source AS author FROM documents)", 2)
    return f"""WITH b AS ({batches}),
e AS (SELECT doc_id, list_concat([2], ids[1:least(len(ids), 256) - 2], [2]) AS x
      FROM (SELECT doc_id, {CHAR_IDS_SQL} AS ids FROM documents)),
p AS (SELECT doc_id, list_concat(x, list_transform(generate_series(1, 256 - len(x)), lambda i: 0)) AS x FROM e)
SELECT 0 AS epoch, sample_id, batch, p1.x AS input_1, p2.x AS input_2, 1 AS label
FROM b JOIN p p1 ON p1.doc_id = file_1 JOIN p p2 ON p2.doc_id = file_2"""


@register("m17_simclr_samples", _m17_sql())
def m17_simclr_samples(spark, sf):
    """M17 (simclr layout): W9 batches of documents -> X11 crop -> X12 pad."""
    return materialise_simclr_samples(spark, spread(table(spark, sf, "documents")), batch=16, length=256,
                                      seed=SEED)


def _pairs_sql() -> str:
    from penprint.plans.q_sampling import FILES, W8_SQL
    return W8_SQL.replace(FILES, "f AS (SELECT doc_id AS file_id, source AS author FROM documents)")


def _layout(spark, sf, kind, **kw):
    from penprint.operators.sampling import random_pair_epoch
    from penprint.plans.corpus import materialise_pairs
    docs = spread(table(spark, sf, "documents"))
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("author"))
    return materialise_pairs(random_pair_epoch(spark, files, files.count(), 0.5, SEED), docs, kind, seed=SEED, **kw)


def _ids_sql(expr: str) -> str:
    from penprint.plans.q_text import CHAR_IDS_SQL
    return CHAR_IDS_SQL.replace("text", f"({expr})")


def _layout_sql(one: str, two: str, label: str = "label") -> str:
    return f"""WITH p AS ({_pairs_sql()})
SELECT 0 AS epoch, p.sample_id, {one} AS input_1, {two} AS input_2, p.{label} FROM p
JOIN documents a ON a.doc_id = p.file_1 JOIN documents b ON b.doc_id = p.file_2"""


def _lines_sql(col: str) -> str:
    ids = _ids_sql("left(ln, 40)")
    return (f"list_transform(string_split({col}, chr(10))[1:10], lambda ln: list_concat({ids}, "
            f"list_transform(generate_series(1, 40 - least(length(ln), 40)), lambda z: 0)))")


def _crop_sql(col: str, file: str) -> str:
    start = f"({H('crop', 'p.sample_id', file)} % greatest(length({col}) - 60 + 1, 1))"
    cut = f"CASE WHEN length({col}) > 60 THEN substr({col}, {start} + 1, 60) ELSE {col} END"
    ids = _ids_sql(cut)
    return (f"list_concat(({ids})[1:least(length({col}), 60) + 1], "
            f"list_transform(generate_series(1, 60 - least(length({col}), 60)), lambda z: 98), [0])")


@register("m17_by_line_samples", _layout_sql(_lines_sql("a.text"), _lines_sql("b.text")))
def m17_by_line_samples(spark, sf):
    """M17 (by-line layout): W8 pairs of documents, 10 lines of 40 characters."""
    return _layout(spark, sf, "by_line", length=40, max_lines=10)


@register("m17_combined_samples", _layout_sql(
    f"list_concat({_ids_sql('left(a.text, 100)')}, [-1], {_ids_sql('left(b.text, 100)')})", "NULL::INTEGER[]"))
def m17_combined_samples(spark, sf):
    """M17 (combined layout): W8 pairs of documents, 100 characters of each."""
    return _layout(spark, sf, "combined", length=100)


@register("m17_split_samples", _layout_sql(_crop_sql("a.text", "p.file_1"), _crop_sql("b.text", "p.file_2")))
def m17_split_samples(spark, sf):
    """M17 (split layout): W8 pairs of documents, a window of 60 characters of each."""
    return _layout(spark, sf, "split", length=60)


# ------------------------------------------------------------------ W16 / M4 / S7


@register("w16_stratified_split", f"""WITH l AS (SELECT doc_id, quality FROM labels),
c AS (SELECT quality, count(*) AS n FROM l GROUP BY quality),
f AS (SELECT greatest(1.0 / min(n), 0.1)::DOUBLE AS f FROM c),
r AS (SELECT l.doc_id, l.quality, c.n, row_number() OVER (PARTITION BY l.quality
      ORDER BY {H('strat', 'l.doc_id')}, l.doc_id) AS rk FROM l JOIN c USING (quality))
SELECT doc_id, quality, CASE WHEN rk <= least(ceil(n * f), greatest(n - 1, 1)) THEN 'test' ELSE 'train' END AS split
FROM r, f""")
def w16_stratified_split(spark, sf):
    """Stratified train/test split of the labelled documents by quality."""
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return stratified_split(lab, "quality", "doc_id", seed=SEED).select("doc_id", "quality", "split")


@register("m4_mlp_holdout", None)
def m4_mlp_holdout(spark, sf):
    """M4 + W17: MLP head (d -> 512 -> 512 -> A) on frozen embeddings, trained on
    folds 1..8 and validated on fold 0."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from penprint.plans.classifiers import features
    cs = _cs(spark, sf)
    train, val = first_fold_holdout(cs)
    tr, va = features(train).persist(), features(val)
    n_labels = int(cs.agg(F.max("label")).first()[0]) + 1
    dim = len(tr.select("features").first()[0])
    model = MultilayerPerceptronClassifier(layers=[dim, 512, 512, n_labels], seed=1, maxIter=50).fit(tr)
    pred = model.transform(va)
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def _s7_sql() -> str:
    from penprint.plans.q_sampling import diff_pairs_sql
    files = "f AS (SELECT source AS author, doc_id AS file_id FROM documents)"
    return f"""WITH {files}, {diff_pairs_sql()}
SELECT p.sample_id, p.file_1, p.file_2, length(d1.text) AS len_1, length(d2.text) AS len_2
FROM dpairs p JOIN documents d1 ON d1.doc_id = p.file_1 JOIN documents d2 ON d2.doc_id = p.file_2"""


@register("s7_pair_texts", _s7_sql())
def s7_pair_texts(spark, sf):
    """Both texts of every different-author document pair (J5), by path join."""
    from penprint.sources.files import read_text_by_path
    docs = table(spark, sf, "documents")
    files = docs.select(F.col("source").alias("author"), F.col("doc_id").alias("file_id"))
    pairs = S.different_author_pairs(spark, files, files.count(), SEED)
    contents = docs.select(F.col("doc_id").alias("filepath"), F.col("text").alias("file_content"))
    t = read_text_by_path(pairs, contents)
    return t.select("sample_id", "file_1", "file_2", F.length("text_1").cast("bigint").alias("len_1"),
                    F.length("text_2").cast("bigint").alias("len_2"))
