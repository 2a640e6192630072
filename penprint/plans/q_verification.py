"""Registered verification queries (M5–M10, W11–W15, A13–A15, A23, A24, U4,
X16–X19) over the 9-fold closed set of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.functions.vectors import euclidean_distance, l2_norm, l2_normalize
from penprint.operators import verification as V
from penprint.operators.histogram import density_grid, kde_grid
from penprint.plans.closed_set import closed_set
from penprint.plans.registry import register
from penprint.plans.sqlparts import closed_set_sql, cosine_sql
from penprint.tables import files_from_embeddings, table

K = 9
SEED = "p"
MAX_AUTHORS = 1600  # the reference's bound on the authors of a closed set
SET_SIZES = (1, 2, 3, 4)


def _cs(spark, sf):
    return closed_set(files_from_embeddings(spark, sf), K, MAX_AUTHORS, SEED).persist()


def _fit(spark, sf):
    cs = _cs(spark, sf)
    same, diff = V.fit_verifier(cs, K)
    return cs, same, diff


# ------------------------------------------------------------------ SQL pieces

SAME_SQL = (f"same_v AS (SELECT a.label, {cosine_sql('a.embedding', 'b.embedding')} AS similarity "
            f"FROM cs a JOIN cs b ON a.label = b.label AND a.fold > b.fold)")
DIFF_SQL = (f"diff_v AS (SELECT {cosine_sql('a.embedding', 'b.embedding')} AS similarity FROM cs a JOIN cs b "
            f"ON a.row_index % {K} = b.row_index % {K} AND a.row_index > b.row_index AND a.label <> b.label)")


def _edge(i: str, p: str = "") -> str:
    return f"(CASE WHEN ({i}) >= {p}nb THEN {p}hi ELSE ({i}) * (({p}hi - {p}lo) / {p}nb) + {p}lo END)"


def hist_sql(name: str, values: str) -> str:
    """CTEs ``{name}_b`` (n, lo, hi, nb) and ``{name}`` (bin, lo, hi, count, pdf)."""
    return f"""{name}_st AS (SELECT count(*) AS n, min(similarity) AS mn, max(similarity) AS mx,
    quantile_cont(similarity, 0.25) AS q1, quantile_cont(similarity, 0.75) AS q3 FROM {values}),
{name}_p AS (SELECT n, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi,
    (mx - mn) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM {name}_st),
{name}_w AS (SELECT *, CASE WHEN fd <> 0 THEN least(fd, sturges) ELSE sturges END AS width FROM {name}_p),
{name}_b AS (SELECT n, lo, hi, CASE WHEN width > 0 THEN CAST(ceil((hi - lo) / width) AS BIGINT) ELSE 1 END AS nb
    FROM {name}_w),
{name}_e AS (SELECT g.bin, {_edge('g.bin')} AS lo_e, {_edge('g.bin + 1')} AS hi_e
    FROM {name}_b, LATERAL (SELECT unnest(generate_series(0, nb - 1)) AS bin) g),
{name}_c0 AS (SELECT v.similarity AS x, p.lo, p.hi, p.nb,
    CAST(floor((v.similarity - p.lo) / (p.hi - p.lo) * p.nb) AS BIGINT) AS b0 FROM {values} v, {name}_b p),
{name}_c1 AS (SELECT *, CASE WHEN b0 = nb THEN nb - 1 ELSE b0 END AS b1 FROM {name}_c0),
{name}_c2 AS (SELECT *, CASE WHEN x < {_edge('b1')} THEN b1 - 1 ELSE b1 END AS b2 FROM {name}_c1),
{name}_c3 AS (SELECT *, CASE WHEN x >= {_edge('b2 + 1')} AND b2 <> nb - 1 THEN b2 + 1 ELSE b2 END AS bin FROM {name}_c2),
{name}_cnt AS (SELECT bin, count(*) AS cnt FROM {name}_c3 GROUP BY bin),
{name} AS (SELECT e.bin, e.lo_e AS lo, e.hi_e AS hi, coalesce(c.cnt, 0) AS count,
    coalesce(c.cnt, 0) / ((SELECT n FROM {name}_b) * (e.hi_e - e.lo_e)) AS pdf
    FROM {name}_e e LEFT JOIN {name}_cnt c USING (bin))"""


def lookup_sql(src: str, dst: str, hist: str, x: str, out: str, floor: bool = True) -> str:
    """CTE ``dst`` = ``src`` + column ``out`` = density of ``hist`` at ``x``."""
    e = lambda i: _edge(i, "_")
    val = f"coalesce(CASE WHEN {x} >= _lo AND {x} < _hi THEN hh.pdf END, 0.0)"
    if floor:
        val = f"greatest({val}, 1e-11)"
    return f"""{dst}_0 AS (SELECT t.*, p.lo AS _lo, p.hi AS _hi, p.nb AS _nb,
    CAST(floor(({x} - p.lo) / (p.hi - p.lo) * p.nb) AS BIGINT) AS _b0 FROM {src} t, {hist}_b p),
{dst}_1 AS (SELECT *, CASE WHEN {x} < {e('_b0')} THEN _b0 - 1 ELSE _b0 END AS _b1 FROM {dst}_0),
{dst}_2 AS (SELECT *, CASE WHEN {x} >= {e('_b1 + 1')} THEN _b1 + 1 ELSE _b1 END AS _b2 FROM {dst}_1),
{dst} AS (SELECT z.* EXCLUDE (_lo, _hi, _nb, _b0, _b1, _b2), {val} AS {out}
    FROM {dst}_2 z LEFT JOIN {hist} hh ON hh.bin = z._b2)"""


def fit_sql() -> str:
    return f"""{closed_set_sql(K, SEED, MAX_AUTHORS)},
{SAME_SQL},
{DIFF_SQL},
{hist_sql('hs', 'same_v')},
{hist_sql('hd', 'diff_v')}"""


def trials_sql() -> str:
    parts = []
    for s in SET_SIZES:
        parts.append(f"""SELECT {s} AS set_size, ta.trial, tb.truth, ta.pos_a, tb.pos_b,
       {cosine_sql('ta.va', 'tb.vb')} AS similarity
FROM (SELECT label AS trial, fold AS pos_a, embedding AS va FROM cs WHERE fold < {s}) ta
JOIN (SELECT label AS trial, 1 AS truth, fold - {s} AS pos_b, embedding AS vb FROM cs WHERE fold >= {s} AND fold < {2 * s}
      UNION ALL
      SELECT CAST(y % a AS INTEGER), 0, CAST(y // a - {s} AS INTEGER), embedding
      FROM (SELECT cs.*, (row_index - 1 + n) % n AS y, a FROM cs, na) WHERE y // a >= {s} AND y // a < {2 * s}) tb
USING (trial)""")
    return f"""{fit_sql()},
na AS (SELECT count(DISTINCT label) AS a, count(*) AS n FROM cs),
tr AS ({' UNION ALL '.join(parts)}),
{lookup_sql('tr', 'trs', 'hs', 'similarity', 'p_same')},
{lookup_sql('trs', 'trd', 'hd', 'similarity', 'p_diff')},
llr AS (SELECT *, ln(p_same / p_diff) AS llr FROM trd)"""


SIGMOID = "(CASE WHEN {x} >= 0 THEN 1.0 / (1.0 + exp(-({x}))) ELSE exp({x}) / (1.0 + exp({x})) END)"

IND_SQL = f"""{trials_sql()},
ind AS (SELECT set_size, trial, truth, sum(llr) AS s FROM llr GROUP BY set_size, trial, truth),
scores AS (SELECT set_size, trial, truth, round({SIGMOID.format(x='s')}, 10) AS score FROM ind)"""


def _scores(spark, sf, scorer="independent"):
    cs, same, diff = _fit(spark, sf)
    n_rows = cs.count()  # every author has exactly K rows
    sc = V.score_trials(cs, same, diff, SET_SIZES, V.SCORERS[scorer], n_rows // K, n_rows)
    return sc.withColumn("score", F.round("score", 10))


@register("m5_fit_verifier", f"""WITH {fit_sql()}
SELECT 'same' AS kind, bin, round(lo, 9) AS lo, round(hi, 9) AS hi, count, round(pdf, 6) AS pdf FROM hs
UNION ALL
SELECT 'diff' AS kind, bin, round(lo, 9), round(hi, 9), count, round(pdf, 6) FROM hd""")
def m5_fit_verifier(spark, sf):
    """Same- and different-author similarity histograms (numpy 'auto' bins)."""
    _, same, diff = _fit(spark, sf)
    def fmt(h, kind):
        return h.bins.select(F.lit(kind).alias("kind"), "bin", F.round("lo", 9).alias("lo"),
                             F.round("hi", 9).alias("hi"), "count", F.round("pdf", 6).alias("pdf"))
    return fmt(same, "same").unionByName(fmt(diff, "diff"))


@register("u4_similarity_kinds", f"""WITH {closed_set_sql(K, SEED, MAX_AUTHORS)}, {SAME_SQL}, {DIFF_SQL}
SELECT 1 AS kind, round(similarity, 9) AS similarity FROM same_v
UNION ALL SELECT 0, round(similarity, 9) FROM diff_v""")
def u4_similarity_kinds(spark, sf):
    """W11 + W12 + U4: same (1) / different (0) author similarities."""
    k = V.similarity_kinds(_cs(spark, sf), K)
    return k.select("kind", F.round("similarity", 9).alias("similarity"))


@register("a23_similarity_extremes", f"""WITH {closed_set_sql(K, SEED, MAX_AUTHORS)}, {SAME_SQL}, {DIFF_SQL},
kinds AS (SELECT 1 AS kind, similarity FROM same_v UNION ALL SELECT 0, similarity FROM diff_v)
SELECT kind, count(*) AS n, round(max(similarity), 9) AS max_sim, round(min(similarity), 9) AS min_sim
FROM kinds GROUP BY kind""")
def a23_similarity_extremes(spark, sf):
    e = V.similarity_extremes(V.similarity_kinds(_cs(spark, sf), K))
    return e.select("kind", "n", F.round("max_sim", 9).alias("max_sim"), F.round("min_sim", 9).alias("min_sim"))


@register("m6_scores_independent", f"WITH {IND_SQL} SELECT set_size, trial, truth, score FROM scores")
def m6_scores_independent(spark, sf):
    """M8 + M6: trials for set sizes 1-4 scored by summed log-odds."""
    return _scores(spark, sf).select(F.col("set_size").cast("int").alias("set_size"), "trial", "truth", "score")


AVG_SQL = f"""{trials_sql()},
dg AS (SELECT set_size, trial, truth, (((pos_b - pos_a) % set_size) + set_size) % set_size AS diag, sum(llr) AS s
       FROM llr GROUP BY set_size, trial, truth, diag),
pr AS (SELECT set_size, trial, truth, {SIGMOID.format(x='s')} AS p FROM dg),
scores AS (SELECT set_size, trial, truth, round(avg(p), 10) AS score FROM pr GROUP BY set_size, trial, truth)"""


@register("m7_scores_averaged", f"WITH {AVG_SQL} SELECT set_size, trial, truth, score FROM scores")
def m7_scores_averaged(spark, sf):
    """Per-diagonal log-odds -> probability -> mean."""
    return _scores(spark, sf, "averaged").select(F.col("set_size").cast("int").alias("set_size"), "trial", "truth",
                                           "score")


CURVE_SQL = """,
g AS (SELECT set_size, score AS threshold, sum(truth) AS tp, sum(1 - truth) AS fp FROM scores GROUP BY set_size, score),
c AS (SELECT set_size, threshold,
             sum(tp) OVER (PARTITION BY set_size ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(fp) OVER (PARTITION BY set_size ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fps FROM g),
c2 AS (SELECT *, max(tps) OVER (PARTITION BY set_size) AS P, max(fps) OVER (PARTITION BY set_size) AS N,
    lag(fps) OVER w - 2 * fps + lead(fps) OVER w AS d2f, lag(tps) OVER w - 2 * tps + lead(tps) OVER w AS d2t
    FROM c WINDOW w AS (PARTITION BY set_size ORDER BY threshold DESC)),
roc AS (SELECT set_size, threshold, fps / N AS fpr, tps / P AS tpr FROM c2
        WHERE coalesce(d2f <> 0 OR d2t <> 0, true)
        UNION ALL SELECT DISTINCT set_size, 'infinity'::DOUBLE, 0.0, 0.0 FROM c2)"""
ROC_SQL = IND_SQL + CURVE_SQL


@register("w14_roc_curve", f"""WITH {ROC_SQL}
SELECT set_size, threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc""")
def w14_roc_curve(spark, sf):
    roc = V.roc_curve(_scores(spark, sf))
    return roc.select(F.col("set_size").cast("int").alias("set_size"), "threshold",
                      F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


REPORT_SQL = """,
au AS (SELECT set_size, sum(seg) AS auc FROM (SELECT set_size,
        (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS seg FROM roc
        WINDOW w AS (PARTITION BY set_size ORDER BY threshold DESC)) GROUP BY set_size),
ac AS (SELECT set_size, avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) = truth THEN 1.0 ELSE 0.0 END) AS accuracy,
        count(*) AS trials FROM scores GROUP BY set_size)
SELECT set_size, round(accuracy, 9) AS accuracy, trials, round(auc, 9) AS auc FROM ac JOIN au USING (set_size)"""


def _report(spark, sf, scorer):
    r = V.verification_report(_scores(spark, sf, scorer).persist())
    return r.select(F.col("set_size").cast("int").alias("set_size"), F.round("accuracy", 9).alias("accuracy"), "trials",
                    F.round("auc", 9).alias("auc"))


@register("m9_verification_report", f"WITH {ROC_SQL}{REPORT_SQL}")
def m9_verification_report(spark, sf):
    """M9: per set size (1-4) accuracy at .5 (A14) and ROC AUC (W14 + A24)."""
    return _report(spark, sf, "independent")


@register("m9_report_averaged", f"WITH {AVG_SQL}{CURVE_SQL}{REPORT_SQL}")
def m9_report_averaged(spark, sf):
    """M9 + D3: the same report with the averaged scorer (M7)."""
    return _report(spark, sf, "averaged")


@register("w15_pr_curve", f"""WITH {IND_SQL},
g AS (SELECT set_size, score AS threshold, sum(truth) AS tp, sum(1 - truth) AS fp FROM scores GROUP BY set_size, score),
c AS (SELECT set_size, threshold,
             sum(tp) OVER (PARTITION BY set_size ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(fp) OVER (PARTITION BY set_size ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fps FROM g),
c2 AS (SELECT *, max(tps) OVER (PARTITION BY set_size) AS P FROM c)
SELECT set_size, threshold, round(CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END, 9) AS precision,
       round(CASE WHEN P > 0 THEN tps / P ELSE 1.0 END, 9) AS recall FROM c2
UNION ALL SELECT DISTINCT set_size, NULL::DOUBLE, 1.0, 0.0 FROM c2""")
def w15_pr_curve(spark, sf):
    pr = V.precision_recall_curve(_scores(spark, sf))
    return pr.select(F.col("set_size").cast("int").alias("set_size"), "threshold",
                     F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@register("m10_density_curves", f"""WITH {fit_sql()},
gs AS (SELECT 'same' AS kind, g.point, g.point * ((hi - lo) / 100) + lo AS x
       FROM hs_b, LATERAL (SELECT unnest(generate_series(0, 99)) AS point) g),
gd AS (SELECT 'diff' AS kind, g.point, g.point * ((hi - lo) / 100) + lo AS x
       FROM hd_b, LATERAL (SELECT unnest(generate_series(0, 99)) AS point) g),
{lookup_sql('gs', 'gsp', 'hs', 'x', 'pdf', floor=False)},
{lookup_sql('gd', 'gdp', 'hd', 'x', 'pdf', floor=False)}
SELECT kind, point, round(x, 9) AS x, round(pdf, 6) AS pdf FROM gsp
UNION ALL SELECT kind, point, round(x, 9), round(pdf, 6) FROM gdp""")
def m10_density_curves(spark, sf):
    """Both densities on a 100-point grid over their support."""
    _, same, diff = _fit(spark, sf)
    def fmt(h, kind):
        g = density_grid(h, 100)
        return g.select(F.lit(kind).alias("kind"), F.col("point").alias("point"), F.round("x", 9).alias("x"),
                        F.round("pdf", 6).alias("pdf"))
    return fmt(same, "same").unionByName(fmt(diff, "diff"))


def _kde_sql(kind: str, cte: str) -> str:
    return f"""SELECT '{kind}' AS kind, CAST(g.point AS INTEGER) AS point, round(lo + step * g.point, 9) AS x,
round(sum(exp(-0.5 * pow((lo + step * g.point - v.similarity) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS pdf
FROM {cte} v, (SELECT n, bw, mn - 3 * bw AS lo, (mx - mn + 6 * bw) / 199 AS step FROM (SELECT count(*) AS n, min(similarity) AS mn,
max(similarity) AS mx, 0.25 * pow(count(*), -0.2) * stddev_samp(similarity) AS bw FROM {cte})) s,
(SELECT unnest(generate_series(0, 199)) AS point) g GROUP BY g.point, lo, step"""


@register("m10_kde_curves", f"""WITH {closed_set_sql(K, SEED, MAX_AUTHORS)}, {SAME_SQL}, {DIFF_SQL}
{_kde_sql('same', 'same_v')} UNION ALL {_kde_sql('diff', 'diff_v')}""")
def m10_kde_curves(spark, sf):
    """Gaussian densities of the same- and different-author similarities."""
    cs = _cs(spark, sf)
    def fmt(v, kind):
        return kde_grid(v, "similarity").select(F.lit(kind).alias("kind"), "point", F.round("x", 9).alias("x"),
                                                F.round("pdf", 6).alias("pdf"))
    return fmt(V.same_author_similarities(cs), "same").unionByName(fmt(V.fold_slice_similarities(cs, K), "diff"))


# ------------------------------------------------------------------ vectors / losses


@register("x16_l2_normalize", f"""SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS unit_sum
FROM embeddings""")
def x16_l2_normalize(spark, sf):
    """Norm of every embedding and the element sum of its unit copy."""
    e = table(spark, sf, "embeddings")
    u = l2_normalize("embedding")
    return e.select("vec_id", F.round(l2_norm("embedding"), 9).alias("norm"),
                    F.round(F.aggregate(u, F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


PAIRS_SQL = f"""{closed_set_sql(K, SEED, MAX_AUTHORS)},
na AS (SELECT count(DISTINCT label) AS a FROM cs),
pk AS (SELECT a.file_id AS file_1, b.file_id AS file_2, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS label,
              a.embedding AS va, b.embedding AS vb
       FROM cs a, na JOIN cs b ON b.row_index = a.row_index + na.a
       UNION ALL
       SELECT a.file_id, b.file_id, CASE WHEN a.label = b.label THEN 1 ELSE 0 END, a.embedding, b.embedding
       FROM cs a, na JOIN cs b ON b.row_index = a.row_index + na.a + 1),
pp AS (SELECT file_1, file_2, label, sqrt(greatest(list_sum(list_transform(generate_series(1, len(va)),
                   lambda i: (va[i]::DOUBLE - vb[i]::DOUBLE) * (va[i]::DOUBLE - vb[i]::DOUBLE))), 1e-7)) AS distance FROM pk)"""


def _pairs(spark, sf):
    """Verification pairs from the closed set: every row with the same author's
    row in the next fold (row + A) and with the next row after that (row + A + 1,
    a different author).  Equi-joins on the row index, one partner each —
    Euclidean distance (X18)."""
    cs = _cs(spark, sf)
    a_n = cs.select("label").distinct().count()
    a = cs.select(F.col("row_index").alias("_r"), F.col("file_id").alias("file_1"), F.col("label").alias("la"),
                  F.col("embedding").alias("va"))
    out = None
    for off in (a_n, a_n + 1):
        b = cs.select((F.col("row_index") - off).alias("_r"), F.col("file_id").alias("file_2"),
                      F.col("label").alias("lb"), F.col("embedding").alias("vb"))
        p = a.join(b, "_r").select("file_1", "file_2", (F.col("la") == F.col("lb")).cast("int").alias("label"),
                                   euclidean_distance("va", "vb").alias("distance"))
        out = p if out is None else out.unionByName(p)
    return out


@register("a15_contrastive_margin_loss", f"""WITH {PAIRS_SQL}
SELECT round(avg(label * distance * distance + (1 - label) * pow(greatest(1.0 - distance, 0.0), 2)), 9) AS loss,
       round(avg(CASE WHEN (CASE WHEN distance < 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
       count(*) AS pairs
FROM pp""")
def a15_contrastive_margin_loss(spark, sf):
    """A15 + A13 + X18 over closed-set verification pairs."""
    p = _pairs(spark, sf)
    return p.agg(F.round(V.margin_loss_expr(1.0), 9).alias("loss"),
                 F.round(V.verification_accuracy_expr(), 9).alias("accuracy"),
                 F.count(F.lit(1)).alias("pairs"))
