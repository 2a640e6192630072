"""Registered sampling queries (A1–A7, A10, F6/F7, W1–W3, W7–W9, W18, J5, J8,
U2, M15, M16) over ``orders`` viewed as files (author = o_custkey, file =
o_orderkey) and ``events`` (author = user_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.functions.rng import sql_h
from penprint.operators import sampling as S
from penprint.operators.lookup import pair_lookup, write_file_index
from penprint.plans.closed_set import limit_authors
from penprint.plans.pair_dataset import build_contrastive_combinations, build_pair_dataset
from penprint.plans.registry import register
from penprint.plans.sqlparts import draws_sql
from penprint.tables import files_from_orders, table

SEED = "p"


def H(tag, *e):
    return sql_h(SEED, tag, *e)


FILES = "f AS (SELECT o_custkey AS author, o_orderkey AS file_id FROM orders)"
CNT = "cnt AS (SELECT author, count(*) AS n_files FROM f GROUP BY author)"
ORDS = (f"ords AS (SELECT author, file_id, row_number() OVER (PARTITION BY author "
        f"ORDER BY {H('ord', 'file_id')}, file_id) - 1 AS ordinal FROM f)")


# ------------------------------------------------------------------ A1 / A2 / A4


@register("a1_author_file_counts", f"WITH {FILES} SELECT author, count(*) AS n_files FROM f GROUP BY author")
def a1_author_file_counts(spark, sf):
    return S.author_file_counts(files_from_orders(spark, sf))


@register("a2_file_ordinals", f"""WITH {FILES}, {CNT}, {ORDS}
SELECT author, file_id, ordinal, n_files FROM ords JOIN cnt USING (author)""")
def a2_file_ordinals(spark, sf):
    """A2/A3: author -> files as (author, ordinal, file) rows; inverse map by file."""
    return S.file_ordinals(files_from_orders(spark, sf), SEED).select("author", "file_id", "ordinal", "n_files")


@register("a4_author_probabilities", f"""WITH {FILES}
SELECT author, count(*) AS n_files, count(*) / (SELECT count(*) FROM f)::DOUBLE AS probability
FROM f GROUP BY author""")
def a4_author_probabilities(spark, sf):
    return S.author_probabilities(files_from_orders(spark, sf))


@register("a4_probability_total", f"""WITH {FILES}, p AS (
SELECT count(*) / (SELECT count(*) FROM f)::DOUBLE AS probability FROM f GROUP BY author)
SELECT round(sum(probability), 9) AS total_probability, count(*) AS authors FROM p""")
def a4_probability_total(spark, sf):
    """The reference's invariant: probabilities sum to 1."""
    p = S.author_probabilities(files_from_orders(spark, sf))
    return p.agg(F.round(F.sum("probability"), 9).alias("total_probability"),
                 F.count(F.lit(1)).alias("authors"))


# ------------------------------------------------------------------ A5 / A7 / A6

A5_SQL = f"""WITH {FILES}, {CNT}
SELECT author, n_files, least(200, least(200, n_files) * (least(200, n_files) - 1) // 2)::BIGINT AS quota
FROM cnt WHERE n_files >= 2"""


@register("a5_max_matches_per_author", A5_SQL)
def a5_max_matches_per_author(spark, sf):
    return S.max_matches_per_author(S.author_file_counts(files_from_orders(spark, sf)), 200)


@register("a7_matches_summary", f"""SELECT median(quota)::DOUBLE AS median_matches, avg(quota)::DOUBLE AS mean_matches
FROM ({A5_SQL})""")
def a7_matches_summary(spark, sf):
    return S.matches_summary(a5_max_matches_per_author(spark, sf))


def rr_sql(files_cte: str = FILES, fraction: float = 0.5, group: str | None = None, src: str = "f") -> str:
    """Round-robin quota oracle: explode the rounds and take the first total."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""{files_cte},
rr_cnt AS (SELECT {g}author, count(*) AS n_files FROM {src} GROUP BY {g}author),
rr_cap AS (SELECT {g}CAST(floor(sum(n_files - 1) * {fraction!r}) AS BIGINT) AS total
           FROM rr_cnt WHERE n_files >= 2 {'GROUP BY ' + group if group else ''}),
rr_rounds AS (SELECT {g}author, n_files, unnest(generate_series(1, n_files - 1)) AS rnd
              FROM rr_cnt WHERE n_files >= 2),
rr_ranked AS (SELECT r.*, row_number() OVER ({part}ORDER BY rnd, {H('rr', 'author')}, author) AS rk
              FROM rr_rounds r),
rr AS (SELECT {g}author, any_value(n_files) AS n_files, count(*) AS quota
       FROM rr_ranked r {'JOIN rr_cap c USING (' + group + ')' if group else ', rr_cap c'}
       WHERE rk <= c.total GROUP BY {g}author)"""


@register("a6_match_quota_round_robin", f"WITH {rr_sql()} SELECT author, n_files, quota FROM rr")
def a6_match_quota_round_robin(spark, sf):
    """A6 with total = half of the capacity sum(n - 1)."""
    counts = S.author_file_counts(files_from_orders(spark, sf))
    return S.match_quota_round_robin(counts, fraction=0.5, seed=SEED).select("author", "n_files", "quota")


# ------------------------------------------------------------------ splits

def split_sql(val=0.1, test=0.1) -> str:
    return f"""{FILES},
au AS (SELECT DISTINCT author FROM f),
na AS (SELECT count(*) AS a FROM au),
r AS (SELECT author, row_number() OVER (ORDER BY {H('split', 'author')}, author) - 1 AS rk FROM au),
sp AS (SELECT author, CASE WHEN rk < floor({val!r} * (SELECT a FROM na)) THEN 'val'
                      WHEN rk < floor({val!r} * (SELECT a FROM na)) + floor({test!r} * (SELECT a FROM na)) THEN 'test'
                      ELSE 'train' END AS split FROM r)"""


def split3_sql(f=0.1) -> str:
    tr = 1 - 2 * f
    return f"""{FILES},
au AS (SELECT DISTINCT author FROM f),
na AS (SELECT count(*) AS a FROM au),
r AS (SELECT author, row_number() OVER (ORDER BY {H('split', 'author')}, author) - 1 AS rk FROM au),
b AS (SELECT floor({tr!r} * a) AS ntr, floor({f!r} * a) AS nvt FROM na),
sp AS (SELECT author, CASE WHEN rk < ntr THEN 'train' WHEN rk < ntr + nvt THEN 'val'
                      WHEN rk < ntr + 2 * nvt THEN 'test' END AS split FROM r, b
       WHERE rk < ntr + 2 * nvt)"""


@register("w1_author_split", f"WITH {split_sql()} SELECT author, split FROM sp")
def w1_author_split(spark, sf):
    return S.author_split(files_from_orders(spark, sf), 0.1, 0.1, SEED)


@register("w2_author_split_three_way", f"WITH {split3_sql()} SELECT author, split FROM sp")
def w2_author_split_three_way(spark, sf):
    return S.author_split_three_way(files_from_orders(spark, sf), 0.1, SEED)


@register("j8_split_membership", f"""WITH {split_sql()}
SELECT split, count(*) AS n_files, count(DISTINCT author) AS n_authors FROM f JOIN sp USING (author) GROUP BY split""")
def j8_split_membership(spark, sf):
    """J8 + U1: files joined to their author's split; per-split file/author counts."""
    files = files_from_orders(spark, sf)
    m = S.split_membership(files, S.author_split(files, 0.1, 0.1, SEED))
    return m.groupBy("split").agg(F.count(F.lit(1)).alias("n_files"),
                                  F.countDistinct("author").alias("n_authors"))


# ------------------------------------------------------------------ F6 / F7 / A10


@register("f7_limit_authors", f"""WITH {FILES},
keep AS (SELECT author FROM f GROUP BY author HAVING count(*) >= 10 ORDER BY author LIMIT 100)
SELECT author, file_id FROM f WHERE author IN (SELECT author FROM keep)""")
def f7_limit_authors(spark, sf):
    """F6 (>= 10 files) then F7 (first 100 authors by name)."""
    files = files_from_orders(spark, sf)
    kept = S.min_files_per_author(files, 10)
    auth = limit_authors(kept.select("author").distinct(), 100)
    return kept.join(F.broadcast(auth), "author", "left_semi").select("author", "file_id")


@register("a10_distinct_authors", """SELECT count(DISTINCT user_id) AS n_authors, count(*) AS n_files,
count(DISTINCT event_type) AS n_labels FROM events""")
def a10_distinct_authors(spark, sf):
    ev = table(spark, sf, "events")
    return ev.agg(F.countDistinct("user_id").alias("n_authors"), F.count(F.lit(1)).alias("n_files"),
                  F.countDistinct("event_type").alias("n_labels"))


# ------------------------------------------------------------------ W7 / M16 / J5 / M15


def pair_ranks_sql(quota_cte: str, group: str | None = None, tag: str = "comb") -> str:
    """Oracle for the W7 engine: the first distinct draws of every author."""
    g = f"{group}, " if group else ""
    return f"""q AS ({quota_cte}),
qc AS (SELECT {g}author, n_files, quota, (n_files * (n_files - 1) // 2) AS c FROM q WHERE quota > 0),
sd AS (SELECT {g}author, quota, c, unnest(generate_series(0, {draws_sql('quota', 'c')})) AS t FROM qc),
sd1 AS (SELECT {g}author, quota, {H(tag, 'author', 't')} % c AS pair_rank, t FROM sd),
sd2 AS (SELECT {g}author, quota, pair_rank, min(t) AS t FROM sd1 GROUP BY {g}author, quota, pair_rank),
sd3 AS (SELECT * FROM (SELECT {g}author, pair_rank, row_number() OVER (PARTITION BY {g}author ORDER BY t) AS o, quota
          FROM sd2) WHERE o <= quota),
ranks AS (SELECT {g}author, pair_rank FROM sd3),
jj AS (SELECT {g}author, pair_rank,
              CAST(floor((1 + sqrt(1 + 8 * pair_rank::DOUBLE)) / 2) AS BIGINT) AS j0 FROM ranks),
jj2 AS (SELECT {g}author, pair_rank, CASE WHEN j0 * (j0 - 1) // 2 > pair_rank THEN j0 - 1
               WHEN (j0 + 1) * j0 // 2 <= pair_rank THEN j0 + 1 ELSE j0 END AS j FROM jj),
ij AS (SELECT {g}author, pair_rank, pair_rank - j * (j - 1) // 2 AS i, j FROM jj2)"""


M16_SQL = f"""WITH {split3_sql()},
fs AS (SELECT f.*, sp.split FROM f JOIN sp USING (author)),
cnt AS (SELECT split, author, count(*) AS n_files FROM fs GROUP BY split, author),
ords AS (SELECT author, file_id, row_number() OVER (PARTITION BY author
          ORDER BY {H('ord', 'file_id')}, file_id) - 1 AS ordinal FROM fs),
{pair_ranks_sql("SELECT split, author, n_files, least(200, least(200, n_files) * (least(200, n_files) - 1) // 2) AS quota FROM cnt WHERE n_files >= 2", 'split')}
SELECT ij.split, ij.author, o1.file_id AS file_1, o2.file_id AS file_2
FROM ij JOIN ords o1 ON o1.author = ij.author AND o1.ordinal = ij.i
        JOIN ords o2 ON o2.author = ij.author AND o2.ordinal = ij.j"""


@register("m16_contrastive_combinations", M16_SQL)
def m16_contrastive_combinations(spark, sf):
    """W2 split -> A5 quota (m = 200) -> W7 distinct same-author pairs."""
    return build_contrastive_combinations(files_from_orders(spark, sf), m=200, val_test=0.1, seed=SEED)


W7_SQL = f"""WITH {rr_sql()}, {ORDS},
{pair_ranks_sql("SELECT author, n_files, quota FROM rr")}
SELECT ij.author, o1.file_id AS file_1, o2.file_id AS file_2
FROM ij JOIN ords o1 ON o1.author = ij.author AND o1.ordinal = ij.i
        JOIN ords o2 ON o2.author = ij.author AND o2.ordinal = ij.j"""


@register("w7_sample_k_combinations", W7_SQL)
def w7_sample_k_combinations(spark, sf):
    """A6 round-robin quotas (half the capacity) -> W7 distinct pairs per author."""
    files = files_from_orders(spark, sf)
    quotas = S.match_quota_round_robin(S.author_file_counts(files), fraction=0.5, seed=SEED)
    return S.sample_k_combinations(files, quotas, SEED).select("author", "file_1", "file_2")


@register("j9_pair_lookup", W7_SQL.replace(
    "SELECT ij.author, o1.file_id AS file_1", "SELECT ij.author, o1.n_files, o1.file_id AS file_1").replace(
    "JOIN ords o1", "JOIN (SELECT ords.*, count(*) OVER (PARTITION BY author) AS n_files FROM ords) o1"))
def j9_pair_lookup(spark, sf):
    """The pairs drawn for W7's quotas, their files looked up in a bucketed index."""
    files = files_from_orders(spark, sf)
    index = write_file_index(S.file_ordinals(files, SEED).select("author", "ordinal", "n_files", "file_id"))
    quotas = S.match_quota_round_robin(S.author_file_counts(files), fraction=0.5, seed=SEED)
    ranks = S.sample_pair_ranks(quotas, SEED, "comb").select("author", "i", "j")
    got = pair_lookup(ranks.hint("merge"), index, columns={"file_id": ("file_1", "file_2"), "n_files": ("n_files", "_n2")})
    return got.select("author", "n_files", "file_1", "file_2")


def diff_pairs_sql(files_cte_name: str = "f", n_expr: str = "(SELECT count(*) FROM f)", tag: str = "diff",
                   pre: str = "") -> str:
    fc = files_cte_name
    return f"""{pre}
dcnt AS (SELECT author, count(*) AS n_files FROM {fc} GROUP BY author),
dords AS (SELECT author, file_id, row_number() OVER (PARTITION BY author
          ORDER BY {H('ord', 'file_id')}, file_id) - 1 AS ordinal FROM {fc}),
aidx AS (SELECT author, row_number() OVER (ORDER BY {H('aidx', 'author')}, author) - 1 AS author_idx FROM dcnt),
dna AS (SELECT count(*) AS a FROM aidx),
s0 AS (SELECT generate_series AS sample_id FROM generate_series(0, {n_expr} - 1)),
s1 AS (SELECT sample_id, {H(tag + 'a1', 'sample_id')} % a AS a1, {H(tag + 'a2', 'sample_id')} % (a - 1) AS a2r
       FROM s0, dna),
s2 AS (SELECT sample_id, a1, CASE WHEN a2r >= a1 THEN a2r + 1 ELSE a2r END AS a2 FROM s1),
s3 AS (SELECT s2.sample_id, x1.author AS author_1, x2.author AS author_2 FROM s2
       JOIN aidx x1 ON x1.author_idx = s2.a1 JOIN aidx x2 ON x2.author_idx = s2.a2),
s4 AS (SELECT s3.*, {H(tag + 'f1', 'sample_id')} % c1.n_files AS o1, {H(tag + 'f2', 'sample_id')} % c2.n_files AS o2
       FROM s3 JOIN dcnt c1 ON c1.author = s3.author_1 JOIN dcnt c2 ON c2.author = s3.author_2),
dpairs AS (SELECT s4.sample_id, s4.author_1, s4.author_2, d1.file_id AS file_1, d2.file_id AS file_2 FROM s4
       JOIN dords d1 ON d1.author = s4.author_1 AND d1.ordinal = s4.o1
       JOIN dords d2 ON d2.author = s4.author_2 AND d2.ordinal = s4.o2)"""


@register("j5_different_author_pairs", f"""WITH {FILES}, {diff_pairs_sql()}
SELECT sample_id, author_1, author_2, file_1, file_2 FROM dpairs""")
def j5_different_author_pairs(spark, sf):
    """As many different-author pairs as there are files."""
    files = files_from_orders(spark, sf)
    return S.different_author_pairs(spark, files, files.count(), SEED)


@register("w3_sample_split_legacy", f"""WITH {FILES}, {diff_pairs_sql()},
n AS (SELECT count(*) AS n FROM dpairs),
r AS (SELECT sample_id, row_number() OVER (ORDER BY {H('pair', 'sample_id')}, sample_id) - 1 AS rk FROM dpairs)
SELECT sample_id, CASE WHEN rk < floor(0.8 * n) THEN 'train' WHEN rk < floor(0.8 * n) + floor(0.1 * n) THEN 'val'
                       ELSE 'test' END AS split
FROM r, n WHERE rk < floor(0.8 * n) + 2 * floor(0.1 * n)""")
def w3_sample_split_legacy(spark, sf):
    """W3 over the J5 pair set: 80% train, 10% val, next 10% test (disjoint form)."""
    files = files_from_orders(spark, sf)
    n = files.count()
    pairs = S.different_author_pairs(spark, files, n, SEED).select("sample_id")
    return S.sample_split_legacy(pairs, int(0.8 * n), int(0.1 * n), id_col="sample_id", seed=SEED)


def _m15_sql() -> str:
    fs = "fs AS (SELECT f.*, sp.split FROM f JOIN sp USING (author))"
    return f"""WITH {split3_sql()},
{rr_sql(fs, 0.5, 'split', 'fs')},
ords AS (SELECT author, file_id, row_number() OVER (PARTITION BY author
         ORDER BY {H('ord', 'file_id')}, file_id) - 1 AS ordinal FROM fs),
{pair_ranks_sql("SELECT split, author, n_files, quota FROM rr", 'split')},
matched AS (SELECT ij.split, o1.file_id AS file_1, o2.file_id AS file_2, 1 AS label
            FROM ij JOIN ords o1 ON o1.author = ij.author AND o1.ordinal = ij.i
                    JOIN ords o2 ON o2.author = ij.author AND o2.ordinal = ij.j),
dcnt AS (SELECT split, author, count(*) AS n_files FROM fs GROUP BY split, author),
aidx AS (SELECT split, author, row_number() OVER (PARTITION BY split ORDER BY {H('aidx', 'author')}, author) - 1
         AS author_idx FROM dcnt),
gp AS (SELECT a.split, a.a, m.n FROM (SELECT split, count(*) AS a FROM aidx GROUP BY split) a
       JOIN (SELECT split, CAST(sum(quota) AS BIGINT) AS n FROM rr GROUP BY split) m USING (split)),
s0 AS (SELECT gp.split, gp.a, x.sample_id FROM gp, LATERAL (SELECT unnest(generate_series(0, gp.n - 1)) AS sample_id) x),
s1 AS (SELECT split, sample_id, {H('diffa1', 'split', 'sample_id')} % a AS a1,
              {H('diffa2', 'split', 'sample_id')} % (a - 1) AS a2r FROM s0),
s2 AS (SELECT split, sample_id, a1, CASE WHEN a2r >= a1 THEN a2r + 1 ELSE a2r END AS a2 FROM s1),
s3 AS (SELECT s2.split, s2.sample_id, x1.author AS author_1, x2.author AS author_2 FROM s2
       JOIN aidx x1 ON x1.split = s2.split AND x1.author_idx = s2.a1
       JOIN aidx x2 ON x2.split = s2.split AND x2.author_idx = s2.a2),
s4 AS (SELECT s3.*, {H('difff1', 's3.split', 's3.sample_id')} % c1.n_files AS o1,
              {H('difff2', 's3.split', 's3.sample_id')} % c2.n_files AS o2
       FROM s3 JOIN dcnt c1 ON c1.author = s3.author_1 JOIN dcnt c2 ON c2.author = s3.author_2),
unmatched AS (SELECT s4.split, d1.file_id AS file_1, d2.file_id AS file_2, 0 AS label FROM s4
       JOIN ords d1 ON d1.author = s4.author_1 AND d1.ordinal = s4.o1
       JOIN ords d2 ON d2.author = s4.author_2 AND d2.ordinal = s4.o2),
allp AS (SELECT * FROM matched UNION ALL SELECT * FROM unmatched)
SELECT split, file_1, file_2, label, {H('shuffle', 'split', 'file_1', 'file_2', 'label')} AS shuffle_key FROM allp"""


@register("m15_pair_dataset", _m15_sql())
def m15_pair_dataset(spark, sf):
    """W2 -> A6 quotas -> W7 matched + J5 unmatched (match rate .5) -> U2."""
    return build_pair_dataset(spark, files_from_orders(spark, sf), fraction=0.5, val_test=0.1, seed=SEED)


@register("m15_pair_dataset_summary", f"""SELECT split, label, count(*) AS pairs FROM ({_m15_sql()})
GROUP BY split, label""")
def m15_pair_dataset_summary(spark, sf):
    d = m15_pair_dataset(spark, sf)
    return d.groupBy("split", "label").agg(F.count(F.lit(1)).alias("pairs"))


# ------------------------------------------------------------------ W9 / W18 / W8


def simclr_sql(batch: int = 64, files: str = FILES, share: int = 4, draws: int = 4096) -> str:
    """W9 by definition: the owners of ``draws`` drawn positions of each batch, the
    first ``batch`` distinct ones."""
    return f"""WITH {files}, {CNT},
m AS (SELECT author, n_files FROM cnt WHERE n_files >= 2),
mf AS (SELECT f.* FROM f JOIN m USING (author)),
ords AS (SELECT author, file_id, row_number() OVER (PARTITION BY author
         ORDER BY {H('ord', 'file_id')}, file_id) - 1 AS ordinal FROM mf),
ns AS (SELECT count(*) // {share} AS n FROM f),
nb AS (SELECT CAST(ceil(n / {batch}.0) AS BIGINT) AS nb, n FROM ns),
gx AS (SELECT author, file_id, row_number() OVER (ORDER BY {H('esg', 'file_id')}, file_id) - 1 AS midx FROM mf),
dt AS (SELECT batch, t, {H('esp', 'batch', 't')} % (SELECT count(*) FROM mf) AS midx FROM
       (SELECT unnest(generate_series(0, nb - 1)) AS batch FROM nb), (SELECT generate_series AS t FROM generate_series(0, {draws - 1}))),
k AS (SELECT batch, author, min(t) AS t FROM dt JOIN gx USING (midx) GROUP BY batch, author),
p AS (SELECT * FROM (SELECT k.batch, k.author, m.n_files, row_number() OVER (PARTITION BY batch ORDER BY t) AS slot
                     FROM k JOIN m USING (author)) WHERE slot <= {batch}),
p2 AS (SELECT p.*, batch * {batch} + slot - 1 AS sample_id,
              {H('es1', 'batch', 'author')} % n_files AS o1, {H('es2', 'batch', 'author')} % (n_files - 1) AS o2r
       FROM p),
p3 AS (SELECT p2.*, CASE WHEN o2r >= o1 THEN o2r + 1 ELSE o2r END AS o2 FROM p2 WHERE sample_id < (SELECT n FROM ns))
SELECT sample_id, CAST(batch AS INTEGER) AS batch, CAST(slot - 1 AS INTEGER) AS slot, p3.author,
       d1.file_id AS file_1, d2.file_id AS file_2
FROM p3 JOIN ords d1 ON d1.author = p3.author AND d1.ordinal = p3.o1
        JOIN ords d2 ON d2.author = p3.author AND d2.ordinal = p3.o2"""


@register("w9_simclr_batches", simclr_sql(64))
def w9_simclr_batches(spark, sf):
    """Batches of 64 distinct authors (weighted by files, without replacement),
    two distinct files each; n_samples = files / 4."""
    files = files_from_orders(spark, sf)
    n = files.count() // 4
    out = S.simclr_batches(spark, files, 64, n, SEED)
    return out.select("sample_id", F.col("batch").cast("int").alias("batch"),
                      F.col("slot").cast("int").alias("slot"), "author", "file_1", "file_2")


@register("w18_shuffle_and_batch", f"""WITH {FILES}, n AS (SELECT count(*) AS n FROM f)
SELECT file_id, CAST(ntile(CAST(ceil(n / 100.0) AS BIGINT)) OVER (ORDER BY {H('batch0', 'file_id')}, file_id) AS INTEGER)
       AS batch FROM f, n""")
def w18_shuffle_and_batch(spark, sf):
    """Hash-shuffled batches of ~100 files (ntile remainder rule)."""
    return S.shuffle_and_batch(files_from_orders(spark, sf).select("file_id"), 100, "file_id", 0, SEED)


W8_SQL = f"""WITH {FILES}, {CNT}, {ORDS},
o AS (SELECT ords.*, cnt.n_files FROM ords JOIN cnt USING (author)),
gall AS (SELECT author, file_id, row_number() OVER (ORDER BY author, {H('gall', 'file_id')}, file_id) - 1 AS gidx FROM o),
gmul AS (SELECT author, file_id, n_files, row_number() OVER (ORDER BY {H('gmul', 'file_id')}, file_id) - 1 AS midx
         FROM o WHERE n_files > 1),
nn AS (SELECT (SELECT count(*) FROM o) AS n_all, (SELECT count(*) FROM gmul) AS n_multi),
s AS (SELECT generate_series AS sample_id FROM generate_series(0, (SELECT n_all FROM nn) - 1)),
sl AS (SELECT sample_id, CASE WHEN {H('e0m', 'sample_id')} / {2.0 ** 52!r} < 0.5 THEN 1 ELSE 0 END AS label FROM s),
m1 AS (SELECT sl.sample_id, g.author, g.n_files FROM sl, nn JOIN gmul g ON g.midx = {H('e0mf', 'sl.sample_id')} % nn.n_multi
       WHERE sl.label = 1),
m2 AS (SELECT sample_id, author, {H('e0m1', 'sample_id')} % n_files AS o1,
              {H('e0m2', 'sample_id')} % (n_files - 1) AS o2r FROM m1),
m3 AS (SELECT sample_id, author, o1, CASE WHEN o2r >= o1 THEN o2r + 1 ELSE o2r END AS o2 FROM m2),
matched AS (SELECT m3.sample_id, 1 AS label, a.file_id AS file_1, b.file_id AS file_2 FROM m3
            JOIN o a ON a.author = m3.author AND a.ordinal = m3.o1 JOIN o b ON b.author = m3.author AND b.ordinal = m3.o2),
wt AS (SELECT author, n_files, CAST(n_files AS HUGEINT) * (n_all - n_files) AS w FROM cnt, nn),
cum AS (SELECT author, n_files, w, sum(w) OVER (ORDER BY {H('w8a', 'author')}, author) AS hi FROM wt),
tot AS (SELECT CAST(sum(w) AS HUGEINT) AS w FROM wt),
t AS (SELECT sl.sample_id, (CAST({H('e0n1', 'sample_id')} AS HUGEINT) * 4503599627370496 + {H('e0n2', 'sample_id')}) % tot.w AS u
      FROM sl, tot WHERE sl.label = 0),
t2 AS (SELECT t.sample_id, cum.author, cum.n_files FROM t JOIN cum ON cum.hi - cum.w <= t.u AND t.u < cum.hi),
st AS (SELECT author, min(gidx) AS start FROM gall GROUP BY author),
t3 AS (SELECT t2.sample_id, t2.author, t2.n_files, st.start, {H('e0n3', 't2.sample_id')} % t2.n_files AS o1,
              {H('e0n4', 't2.sample_id')} % (nn.n_all - t2.n_files) AS r FROM t2 JOIN st ON st.author = t2.author, nn),
unmatched AS (SELECT t3.sample_id, 0 AS label, a.file_id AS file_1, b.file_id AS file_2 FROM t3
       JOIN o a ON a.author = t3.author AND a.ordinal = t3.o1
       JOIN gall b ON b.gidx = CASE WHEN t3.r < t3.start THEN t3.r ELSE t3.r + t3.n_files END)
SELECT * FROM matched UNION ALL SELECT * FROM unmatched"""


@register("w8_random_pair_epoch", W8_SQL)
def w8_random_pair_epoch(spark, sf):
    """One epoch (as many samples as files) of random matched/non-matched pairs."""
    files = files_from_orders(spark, sf)
    return S.random_pair_epoch(spark, files, files.count(), 0.5, SEED)
