"""Author-level sampling: splits, quotas, per-author picks, pair draws, batches.

Input convention: a *files* DataFrame with columns ``author`` and ``file_id``
(any extra columns are carried where it makes sense).  Every random choice is
``rng.h(seed, tag, ids...)``; nothing depends on partitioning or row order.

Skew rules followed throughout (one author may own a third of all files):
per-author counts use partial aggregation; per-author ranks use the bucketed
ordinal of ``ranking.py``; per-sample work is keyed by the sample id; nothing
enumerates all pairs of an author.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions.rng import HASH_BITS, draw, h, u01
from penprint.operators.ranking import bucketed_ordinal, first_k, hash_ordinal
from penprint.operators.scan import running_start
from penprint.tables import fan_out_ready

# ---------------------------------------------------------------- aggregates


def author_file_counts(files: DataFrame, author: str = "author") -> DataFrame:
    """A1: (author, n_files)."""
    return files.groupBy(author).agg(F.count(F.lit(1)).alias("n_files"))


def author_probabilities(files: DataFrame, author: str = "author") -> DataFrame:
    """A4: p(author) = files / total.  The total is one scalar aggregate, so no
    single-partition ``sum() over ()`` window is needed."""
    total = files.count()
    return author_file_counts(files, author).withColumn(
        "probability", F.col("n_files") / F.lit(float(total)))


SPLIT_AUTHOR_FILES = 1 << 16  # authors above this many files are ranked in hash buckets


def file_ordinals(files: DataFrame, seed="p", author: str = "author", file_id: str = "file_id",
                  with_counts: bool = True, tag: str = "ord") -> DataFrame:
    """A2/A3 at scale: one row per (author, ordinal, file_id).

    The ordinal is the rank of ``h(seed, tag, file_id)`` (tie: file id) inside
    the author, so it is a uniformly random bijection files -> [0, n).  Rows
    instead of an array: an author's file list is never collected into one row.
    The files of an author with more than ``SPLIT_AUTHOR_FILES`` are cut into
    hash buckets of about so many; all others are ranked in one window.  Files
    without an author are left out.
    """
    counts = author_file_counts(files, author)
    hot = counts.where(F.col("n_files") > SPLIT_AUTHOR_FILES)
    known = files.where(F.col(author).isNotNull()).withColumn("_h", h(seed, tag, file_id))
    rest, parts = known, []
    if not hot.isEmpty():
        rest = known.join(hot.select(author), author, "left_anti")
        bits = F.ceil(F.log2(F.col("n_files") / SPLIT_AUTHOR_FILES))
        staged = known.join(hot, author).withColumn("_bits", bits.cast("int")).withColumn(
            "_b", F.expr(f"shiftright(_h, {HASH_BITS} - _bits)"))
        parts = [bucketed_ordinal(staged, [author], ["_b"], [F.col("_h"), F.col(file_id)], out="ordinal")
                 .drop("_b", "_bits")]
    # whole authors: one shuffle and one sort give both the count and the ordinal
    w = Window.partitionBy(author).orderBy("_h", file_id)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rest.withColumn("n_files", F.count(F.lit(1)).over(every)) if with_counts else rest
    out = out.withColumn("ordinal", (F.row_number().over(w) - 1).cast("bigint"))
    for p in parts:
        out = out.unionByName(p if with_counts else p.drop("n_files"))
    return out.drop("_h")


def author_starts(counts: DataFrame, author: str = "author", out: str = "_start") -> DataFrame:
    """(author, n_files, start): the place of each author's first file where all
    files lie contiguously by author, in author order."""
    return running_start(counts.select(author, "n_files"), [F.col(author).asc()], "n_files", out)


def min_files_per_author(files: DataFrame, k: int, author: str = "author") -> DataFrame:
    """keep authors with at least k files (aggregate + left-semi join;
    AQE broadcasts the author list when small and splits a skewed author)."""
    keep = author_file_counts(files, author).where(F.col("n_files") >= k).select(author)
    return files.join(keep, author, "left_semi")


def max_matches_per_author(counts: DataFrame, m: int = 200) -> DataFrame:
    """A5: quota = min(m, C(min(m, n), 2)) for authors with n >= 2."""
    c = F.least(F.lit(m), F.col("n_files"))
    return (counts.where(F.col("n_files") >= 2)
            .withColumn("quota", F.least(F.lit(m).cast("bigint"), (c * (c - 1) / 2).cast("bigint"))))


def matches_summary(quotas: DataFrame) -> DataFrame:
    """Median and mean matches per author."""
    return quotas.agg(F.median("quota").cast("double").alias("median_matches"),
                      F.avg("quota").alias("mean_matches"))


def _full_rounds(hist: list[tuple[int, int]], total: int) -> tuple[int, int]:
    """(full rounds, matches left for the next round) for caps/counts ``hist``."""
    capacity = sum(c * n for c, n in hist)
    if total > capacity:
        raise ValueError(f"total {total} exceeds the matching capacity {capacity}")
    done, prev_cap, active, full_rounds = 0, 0, sum(n for _, n in hist), 0
    for cap, n in sorted(hist):
        seg = (cap - prev_cap) * active
        if done + seg > total:
            full_rounds = prev_cap + (total - done) // active
            done += (full_rounds - prev_cap) * active
            break
        done += seg
        prev_cap = cap
        full_rounds = cap
        active -= n
    return full_rounds, total - done


def match_quota_round_robin(counts: DataFrame, total: int | None = None, seed="p",
                            fraction: float | None = None, author: str = "author",
                            group: str | None = None, totals: dict | None = None) -> DataFrame:
    """Round i = 1, 2, ...: every author with more than i files gets one more
    match, until ``total`` matches are handed out; the last round goes to a
    hash-random subset of the eligible authors.

    Closed form instead of a loop over rounds: after r full rounds an author has
    ``min(n-1, r)`` matches, so the number of full rounds follows from the
    histogram of file counts (its size is bounded by sqrt(2 * files) distinct
    values, so collecting it is safe).  Raises when ``total`` exceeds the
    capacity sum(n-1) (the reference would loop forever).

    With ``group`` (e.g. the split) every group gets its own total
    (``totals[g]`` or ``fraction`` of its capacity) in the same plan.
    """
    elig = counts.where(F.col("n_files") >= 2)
    gcols = [group] if group else []
    rows = elig.groupBy(*gcols, "n_files").agg(F.count(F.lit(1)).alias("cnt")).collect()
    hists: dict = {}
    for r in rows:
        hists.setdefault(r[group] if group else None, []).append((int(r["n_files"]) - 1, int(r["cnt"])))
    params = []
    for g, hist in hists.items():
        cap = sum(c * n for c, n in hist)
        t = (totals or {}).get(g) if group else total
        if t is None:
            t = int(cap * fraction)
        params.append((g, *_full_rounds(hist, t)))
    spark = counts.sparkSession
    if group:
        gtype = counts.schema[group].dataType.simpleString()
        p = spark.createDataFrame(params, f"{group} {gtype}, _full long, _rem long")
        base = elig.join(F.broadcast(p), group)  # one row per group
    else:
        base = elig.withColumn("_full", F.lit(params[0][1] if params else 0)).withColumn(
            "_rem", F.lit(params[0][2] if params else 0))
    base = base.withColumn("quota", F.least(F.col("n_files") - 1, F.col("_full")).cast("bigint"))
    cand = (base.where((F.col("n_files") - 1 >= F.col("_full") + 1) & (F.col("_rem") > 0))
            .select(*gcols, author, "_rem").withColumn("_h", h(seed, "rr", author)))
    extra = (hash_ordinal(cand, gcols, "_h", [author], out="_o").where(F.col("_o") < F.col("_rem"))
             .select(author, F.lit(1).cast("bigint").alias("_x")))
    base = (base.join(extra, author, "left")
            .withColumn("quota", F.col("quota") + F.coalesce(F.col("_x"), F.lit(0))).drop("_x", "_full", "_rem"))
    return base.where(F.col("quota") > 0)


# ---------------------------------------------------------------- splits


def _split_sizes(n_authors: int, fractions) -> list[int]:
    return [int(f * n_authors) for f in fractions]


def author_split(files: DataFrame, val: float = 0.1, test: float = 0.1, seed="p",
                 author: str = "author") -> DataFrame:
    """Author-disjoint split.  Authors are ranked by ``h(seed,'split',a)``;
    the first int(val*A) are ``val``, the next int(test*A) ``test``, the rest
    ``train``.  Returns (author, split)."""
    authors = files.select(author).distinct().withColumn("_h", h(seed, "split", author))
    a = authors.count()
    nv, nt = _split_sizes(a, [val, test])
    r = hash_ordinal(authors, [], "_h", [author], out="_r", rows=a)
    split = (F.when(F.col("_r") < nv, "val").when(F.col("_r") < nv + nt, "test").otherwise("train"))
    return r.select(author, split.alias("split"))


def author_split_three_way(files: DataFrame, val_test: float = 0.1, seed="p",
                           author: str = "author") -> DataFrame:
    """train = int((1-2f)*A) authors, val = test = int(f*A); leftovers dropped."""
    authors = files.select(author).distinct().withColumn("_h", h(seed, "split", author))
    a = authors.count()
    ntr, nvt = _split_sizes(a, [1 - 2 * val_test, val_test])
    r = hash_ordinal(authors, [], "_h", [author], out="_r", rows=a)
    split = (F.when(F.col("_r") < ntr, "train").when(F.col("_r") < ntr + nvt, "val")
             .when(F.col("_r") < ntr + 2 * nvt, "test"))
    return r.select(author, split.alias("split")).where(F.col("split").isNotNull())


def split_membership(files: DataFrame, splits: DataFrame, author: str = "author") -> DataFrame:
    """Attach the split of each file's author (equi-join on the author table)."""
    return files.join(splits, author, "inner")


def sample_split_legacy(pairs: DataFrame, n_train: int, n_val: int, id_col: str = "pair_id",
                        seed="p", overlapping_test: bool = False) -> DataFrame:
    """Split *pairs* (not author-disjoint) after a hash shuffle.  Default test
    = the n_val pairs after val; ``overlapping_test`` reproduces the reference
    slice [train : train + 2*val] that contains all of val."""
    pairs = pairs.withColumn("_h", h(seed, "pair", id_col)).persist()  # counted, cut and ranked: made once
    r = hash_ordinal(pairs, [], "_h", [id_col], out="_r", rows=pairs.count())
    tr, va = n_train, n_val
    if overlapping_test:
        out = r.where(F.col("_r") < tr + 2 * va).withColumn(
            "splits", F.when(F.col("_r") < tr, F.array(F.lit("train")))
            .when(F.col("_r") < tr + va, F.array(F.lit("val"), F.lit("test")))
            .otherwise(F.array(F.lit("test"))))
        return out.withColumn("split", F.explode("splits")).drop("splits", "_h", "_r")
    split = (F.when(F.col("_r") < tr, "train").when(F.col("_r") < tr + va, "val")
             .when(F.col("_r") < tr + 2 * va, "test"))
    return r.withColumn("split", split).where(F.col("split").isNotNull()).drop("_h", "_r")


def shuffle_and_batch(df: DataFrame, size: int, id_col: str, epoch: int = 0, seed="p") -> DataFrame:
    """Permute rows by ``h(seed, epoch, id)`` and cut into ceil(n/size)
    nearly equal batches (``array_split``/``ntile`` remainder rule: the first
    n mod B batches get one extra row).  1-based ``batch``."""
    n = df.count()
    nb = max(1, math.ceil(n / size))
    q, r = divmod(n, nb)
    ranked = hash_ordinal(df.withColumn("_h", h(seed, f"batch{epoch}", id_col)), [], "_h", [id_col],
                          out="_o", rows=n)
    big = r * (q + 1)
    batch = F.when(F.col("_o") < big, F.floor(F.col("_o") / (q + 1))).otherwise(
        F.lit(r) + F.floor((F.col("_o") - big) / F.lit(max(q, 1))))
    return ranked.withColumn("batch", (batch + 1).cast("int")).drop("_h", "_o")


# ---------------------------------------------------------------- pair draws


def unrank_pair(r: Column) -> tuple[Column, Column]:
    """Pair rank r in [0, C(n,2)) -> (i, j), i < j (colex order).
    j = floor((1 + sqrt(1 + 8r)) / 2) corrected by one for float rounding."""
    j0 = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(8.0) * r.cast("double"))) / 2).cast("bigint")
    tri = lambda j: j * (j - 1) / 2
    j1 = F.when(tri(j0).cast("bigint") > r, j0 - 1).otherwise(j0)
    j = F.when(tri(j1 + 1).cast("bigint") <= r, j1 + 1).otherwise(j1)
    i = (r - (j * (j - 1) / 2).cast("bigint")).cast("bigint")
    return i, j


ROW_DRAWS = 512  # draw budgets up to this are drawn as one array


def _draw_budget(q: Column, space: Column, level: int) -> Column:
    """Draws that most likely hold q distinct values: their expected number
    space * ln(space / (space - q)) with room, twice as many at each level.  A
    short key costs another level, so small keys get little more than they need."""
    c, k = space.cast("double"), q.cast("double")
    likely = c * F.log((c + 0.5) / (c - k + 0.5)) * 1.3 + F.least(c, k * k / c) * 5 + 4
    return (F.ceil(likely) * F.lit(2 ** level)).cast("bigint")


def sample_distinct(groups: DataFrame, key: str, space: str, quota: str, seed="p", tag: str = "comb",
                    max_levels: int = 40) -> DataFrame:
    """``quota`` distinct values of [0, ``space``) per ``key``, uniformly without
    replacement, never enumerating a large space.

    The first q *distinct* values of the draw sequence ``h(seed, tag, key, t)
    mod space``, t = 0, 1, ...  Draws are made in a budget of the likely
    number (``_draw_budget``); a key whose budget yields fewer than q distinct values (a quota near the whole space
    needs about space * ln(space) draws) is redone with a doubled budget — the
    answer does not depend on the budget.  Draw generation is chunked so a hot
    key's draws spread over many tasks; the per-key rank by draw order uses the
    bucketed ordinal.  Keys of at most ``ROW_DRAWS`` draws, which are nearly all,
    are drawn inside their row, without a shuffle.  Keys must be unique; a null
    key gets nothing drawn.  A quota of the whole space is every value, so nothing has
    to be drawn for it (``draw_t`` is the value then).

    Output (key, value, draw_t).
    """
    base = groups.select(key, F.col(space).alias("_C"), F.col(quota).alias("_q")).where(F.col("_q") > 0).persist()
    chunk = 4096

    def spans(df, size):
        """Rows numbered 0 .. size - 1 of each key, made chunk by chunk."""
        df = df.withColumn("_ch", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       F.floor((size - 1) / chunk).cast("bigint"))))
        return fan_out_ready(df).withColumn("draw_t", F.explode(F.sequence(
            F.col("_ch") * chunk, F.least(F.col("_ch") * chunk + chunk, size) - 1)))

    def in_row(df):
        """The draws of each key as an array, ``_picks`` the first q distinct ones
        (null where the budget holds fewer): no row is made but those kept."""
        draws = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_T") - 1),
                            lambda t: F.pmod(h(seed, tag, key, t), F.col("_C")))
        got = fan_out_ready(df).withColumn("_draws", draws).withColumn("_d", F.array_distinct("_draws"))
        return got.select(key, "_C", "_q", "_draws", F.when(
            F.size("_d") >= F.col("_q"), F.slice("_d", F.lit(1), F.col("_q").cast("int"))).alias("_picks")).persist()

    def in_rows(df):
        """The first draw of each distinct value, ranked in draw order."""
        t = spans(df, F.col("_T")).withColumn("value", F.pmod(h(seed, tag, key, "draw_t"), F.col("_C")))
        firsts = t.groupBy(key, "_C", "_q", "_T", "value").agg(F.min("draw_t").alias("draw_t"))
        firsts = firsts.withColumn("_b", F.floor(F.col("draw_t") * 1024 / F.col("_T")).cast("bigint"))
        return bucketed_ordinal(firsts, [key], ["_b"], [F.col("draw_t")], out="_o").drop("_b").persist()

    whole = spans(base.where((F.col("_q") >= F.col("_C")) & (F.col("_C") > 0)), F.col("_C"))
    results = [whole.select(key, F.col("draw_t").alias("value"), "draw_t")]
    todo = base.where((F.col("_q") < F.col("_C")) & F.col(key).isNotNull())
    for level in range(max_levels):
        todo = todo.withColumn("_T", _draw_budget(F.col("_q"), F.col("_C"), level))
        few, short = in_row(todo.where(F.col("_T") <= ROW_DRAWS)), []
        if not few.isEmpty():
            kept = few.where(F.col("_picks").isNotNull()).select(key, "_draws", F.explode("_picks").alias("value"))
            results.append(kept.select(key, "value", (F.array_position("_draws", F.col("value")) - 1).alias("draw_t")))
            short.append(few.where(F.col("_picks").isNull()).select(key, "_C", "_q"))
        many = todo.where(F.col("_T") > ROW_DRAWS)
        if not many.isEmpty():
            ranked = in_rows(many)
            lacking = (ranked.groupBy(key, "_C", "_q").agg(F.count(F.lit(1)).alias("_d"))
                       .where(F.col("_d") < F.col("_q")).drop("_d"))
            results.append(ranked.where(F.col("_o") < F.col("_q")).join(lacking.select(key), key, "left_anti")
                           .select(key, "value", "draw_t"))
            short.append(lacking)
        if not short:
            break
        todo = short[0] if len(short) == 1 else short[0].unionByName(short[1])
        if todo.isEmpty():
            break
    else:
        raise RuntimeError("distinct sampling did not converge")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def sample_pair_ranks(quotas: DataFrame, seed="p", tag: str = "comb", author: str = "author",
                      max_levels: int = 40) -> DataFrame:
    """W7 engine: ``quota`` distinct pair ranks in [0, C(n,2)) per author
    (``sample_distinct``), unranked to file ordinals (i < j).
    Output: (author, pair_rank, draw_t, i, j)."""
    q = quotas.select(author, "quota", (F.col("n_files") * (F.col("n_files") - 1) / 2).cast("bigint").alias("_space"))
    out = sample_distinct(q, author, "_space", "quota", seed, tag, max_levels)
    i, j = unrank_pair(F.col("value"))
    return out.select(author, F.col("value").alias("pair_rank"), "draw_t", i.alias("i"), j.alias("j"))


def diff_author_sample(emb: DataFrame, m: int = 50, max_authors: int | None = 1500, seed="p",
                       author: str = "author", file_id: str = "file_id", vec: str = "embedding") -> DataFrame:
    """For every author (>= 2 files; the first ``max_authors`` by name),
    ``m`` embeddings of *other* authors drawn without replacement, each paired
    with all of the author's own embeddings.

    Rows are laid out contiguously by author in a global index (``author_starts``
    plus the file's ordinal); an author's m draws come from [0, N - n_a) and skip
    its own block, so no candidate set is enumerated.  Output (author, own_id, other_id, similarity)."""
    from penprint.functions.vectors import cosine_similarity
    from penprint.plans.closed_set import limit_authors
    counts = author_file_counts(emb, author).where(F.col("n_files") >= 2)
    keep = limit_authors(counts.select(author), max_authors, author)
    e = emb.join(keep, author, "left_semi")
    blocks = author_starts(counts.join(keep, author, "left_semi"), author, "start").persist()
    n_all = int(blocks.agg(F.sum("n_files")).first()[0] or 0)
    gi = (file_ordinals(e, seed, author, file_id, with_counts=False, tag="w10g")
          .join(blocks.select(author, "start"), author)
          .withColumn("gidx", F.col("start") + F.col("ordinal")).drop("start", "ordinal"))
    groups = blocks.withColumn("_space", F.lit(n_all) - F.col("n_files")).withColumn(
        "_q", F.least(F.lit(m), F.col("_space")))
    draws = sample_distinct(groups, author, "_space", "_q", seed, "w10")
    draws = draws.hint("merge").join(blocks, author).withColumn(
        "gidx", F.when(F.col("value") < F.col("start"), F.col("value")).otherwise(F.col("value") + F.col("n_files")))
    other = gi.select("gidx", F.col(file_id).alias("other_id"), F.col(vec).alias("_vo"))
    own = gi.select(author, F.col(file_id).alias("own_id"), F.col(vec).alias("_va"))
    pairs = draws.select(author, "gidx").join(other, "gidx").join(own, author)
    return pairs.select(author, "own_id", "other_id", cosine_similarity("_va", "_vo").alias("similarity"))


def sample_k_combinations(files: DataFrame, quotas: DataFrame, seed="p", tag: str = "comb",
                          author: str = "author", file_id: str = "file_id",
                          ordinals: DataFrame | None = None) -> DataFrame:
    """``quota`` distinct same-author file pairs per author (label 1).
    Pair (i, j) of ordinals is mapped to files through the (author, ordinal)
    index with two equi-joins.  Output (author, file_1, file_2, draw_t)."""
    ords = ordinals if ordinals is not None else file_ordinals(files, seed, author, file_id,
                                                               with_counts=False)
    ranks = sample_pair_ranks(quotas, seed, tag, author)
    o1 = ords.select(author, F.col("ordinal").alias("i"), F.col(file_id).alias("file_1"))
    o2 = ords.select(author, F.col("ordinal").alias("j"), F.col(file_id).alias("file_2"))
    # the size of the authors' table says nothing about the pairs made of it: no broadcast
    return (ranks.hint("merge").join(o1, [author, "i"]).join(o2, [author, "j"])
            .select(author, "file_1", "file_2", "draw_t"))


def author_index(files: DataFrame, seed="p", author: str = "author", group: str | None = None) -> DataFrame:
    """Distinct authors with a hash-random dense index ``author_idx`` (0-based),
    within ``group`` when given."""
    gcols = [group] if group else []
    a = files.select(*gcols, author).distinct().withColumn("_h", h(seed, "aidx", author)).persist()  # ranked in two passes
    return hash_ordinal(a, gcols, "_h", [author], out="author_idx").drop("_h")


def different_author_pairs(spark, files: DataFrame, n, seed="p", tag: str = "diff",
                           author: str = "author", file_id: str = "file_id",
                           ordinals: DataFrame | None = None,
                           authors: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """N pairs with different authors, with replacement.  Author 1 uniform,
    author 2 uniform among the others (draw in [0, A-1) and shift past author 1),
    then one uniform file of each.  Keyed by sample id, so no author skew.

    With ``group`` (e.g. split), ``n`` is a dict group -> samples and authors
    are drawn inside their group; all groups run in one plan."""
    gcols = [group] if group else []
    aidx = authors if authors is not None else author_index(files, seed, author, group).persist()
    ords = ordinals if ordinals is not None else file_ordinals(files, seed, author, file_id).persist()
    if group:
        sizes = {r[group]: r["a"] for r in aidx.groupBy(group).agg(F.count(F.lit(1)).alias("a")).collect()}
        plan, off = [], 0
        for g, k in sorted(n.items()):
            plan.append((g, off, int(k), int(sizes.get(g, 0))))
            off += int(k)
        total = off
        split = None
        for g, o, k, _ in plan:
            cond = F.col("id") < o + k
            split = F.when(cond, F.lit(g)) if split is None else split.when(cond, F.lit(g))
        gp = spark.createDataFrame(plan, f"{group} string, _off long, _n long, _A long")
        s = spark.range(total).withColumn(group, split).join(F.broadcast(gp), group)
        s = s.withColumn("sample_id", F.col("id") - F.col("_off")).drop("id")
        a_col = F.col("_A")
    else:
        a = aidx.count()
        s = spark.range(n).withColumnRenamed("id", "sample_id")
        a_col = F.lit(a)
    key = gcols + ["sample_id"]
    s = s.withColumn("_a1", F.pmod(h(seed, f"{tag}a1", *key), a_col))
    s = s.withColumn("_a2", F.pmod(h(seed, f"{tag}a2", *key), a_col - 1))
    s = s.withColumn("_a2", F.when(F.col("_a2") >= F.col("_a1"), F.col("_a2") + 1).otherwise(F.col("_a2")))
    # an author's number and file count in one table: a sample meets it once a side
    sized = aidx.join(ords.where("ordinal = 0").select(author, "n_files"), author).persist()
    a1, a2 = (sized.select(*gcols, F.col("author_idx").alias(f"_a{i}"), F.col(author).alias(f"author_{i}"),
                           F.col("n_files").alias(f"_n{i}")) for i in (1, 2))
    s = s.join(a1, gcols + ["_a1"]).join(a2, gcols + ["_a2"])
    s = s.withColumn("_o1", F.pmod(h(seed, f"{tag}f1", *key), F.col("_n1")))
    s = s.withColumn("_o2", F.pmod(h(seed, f"{tag}f2", *key), F.col("_n2")))
    f1 = ords.select(F.col(author).alias("author_1"), F.col("ordinal").alias("_o1"),
                     F.col(file_id).alias("file_1"))
    f2 = ords.select(F.col(author).alias("author_2"), F.col("ordinal").alias("_o2"),
                     F.col(file_id).alias("file_2"))
    return (s.join(f1, ["author_1", "_o1"]).join(f2, ["author_2", "_o2"])
            .select(*gcols, "sample_id", "author_1", "author_2", "file_1", "file_2"))


def label_and_union(matched: DataFrame, unmatched: DataFrame, seed="p") -> DataFrame:
    """Matched pairs (label 1) and non-matched pairs (label 0) in one table,
    with a hash ``shuffle_key`` for callers that need a random order."""
    m = matched.select("file_1", "file_2", F.lit(1).alias("label"))
    u = unmatched.select("file_1", "file_2", F.lit(0).alias("label"))
    out = m.unionByName(u)
    return out.withColumn("shuffle_key", h(seed, "shuffle", "file_1", "file_2", "label"))


# ---------------------------------------------------------------- batches


def _distinct_authors(batches: DataFrame, index: DataFrame, n_files: int, size: int, seed, author: str,
                      budget: int) -> DataFrame:
    """(batch, author, slot) of the first ``size`` distinct authors among the
    owners of ``budget`` drawn file positions of each batch; a batch that holds
    fewer comes back with what it has."""
    t = fan_out_ready(batches).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))))
    t = t.withColumn("midx", draw(seed, "esp", n_files, "batch", "_t")).join(index, "midx")
    first = t.groupBy("batch", author).agg(F.min("_t").alias("_t"))
    return first_k(first, ["batch"], [F.col("_t")], size, out="slot").drop("_t")


def weighted_author_batches(spark, index: DataFrame, n_files: int, n_batches: int, size: int, seed="p",
                            author: str = "author", max_levels: int = 40) -> DataFrame:
    """(batch, author, slot): for each batch ``size`` distinct authors, drawn one
    after the other with probability proportional to their files, without
    replacement.

    Drawing file positions t = 0, 1, ... uniformly and passing over owners already
    drawn has exactly that law, so a batch costs a few times ``size`` rows however
    many authors there are.  A batch whose draws own too few authors (a hot author
    takes most of them) is drawn again with four times as many; the answer does
    not depend on the budget.  ``index``: (midx, author), the owner of each
    position below ``n_files``.
    """
    todo = spark.range(n_batches).select(F.col("id").cast("int").alias("batch"))
    results, budget = [], 2 * size + 32
    for _ in range(max_levels):
        got = _distinct_authors(todo, index, n_files, size, seed, author, budget).persist()
        full = got.where(F.col("slot") == size).select("batch")
        results.append(got.join(full, "batch", "left_semi"))
        short = todo.join(full, "batch", "left_anti")
        if short.limit(1).count() == 0:
            break
        todo, budget = short, 4 * budget
    else:
        raise RuntimeError("weighted author draws did not converge")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def simclr_batches(spark, files: DataFrame, batch_size: int, n_samples: int, seed="p",
                   author: str = "author", file_id: str = "file_id") -> DataFrame:
    """Contrastive batches.  Only authors with > 1 file.  Batch b draws
    ``batch_size`` distinct authors with probability proportional to their file
    count, without replacement (``weighted_author_batches``), then two distinct
    files of each author.  ``ceil(n/batch)`` batches; the last one is cut so
    exactly ``n_samples`` rows are produced.
    """
    multi = min_files_per_author(files, 2, author)
    ords = file_ordinals(multi, seed, author, file_id).persist()  # used four times below
    counts = ords.where("ordinal = 0").select(author, "n_files")
    n_authors, n_files = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_files"), F.lit(0))).first()
    if n_samples > 0 and n_authors < batch_size:
        raise ValueError(f"a batch of {batch_size} needs as many authors with two files")
    index = hash_ordinal(ords.select(author, file_id).withColumn("_g", h(seed, "esg", file_id)), [], "_g", [file_id],
                         out="midx", rows=int(n_files)).select("midx", author)
    nb = math.ceil(n_samples / batch_size)
    picked = weighted_author_batches(spark, index, max(int(n_files), 1), nb, batch_size, seed, author)
    picked = picked.withColumn("sample_id", F.col("batch").cast("bigint") * batch_size + F.col("slot") - 1)
    picked = picked.where(F.col("sample_id") < n_samples).join(counts, author)
    picked = picked.withColumn("_o1", F.pmod(h(seed, "es1", "batch", author), F.col("n_files")))
    picked = picked.withColumn("_o2", F.pmod(h(seed, "es2", "batch", author), F.col("n_files") - 1))
    picked = picked.withColumn("_o2", F.when(F.col("_o2") >= F.col("_o1"), F.col("_o2") + 1)
                               .otherwise(F.col("_o2")))
    f1 = ords.select(author, F.col("ordinal").alias("_o1"), F.col(file_id).alias("file_1"))
    f2 = ords.select(author, F.col("ordinal").alias("_o2"), F.col(file_id).alias("file_2"))
    return (picked.join(f1, [author, "_o1"]).join(f2, [author, "_o2"])
            .select("sample_id", "batch", (F.col("slot") - 1).alias("slot"), author, "file_1", "file_2"))


def random_pair_epoch(spark, files: DataFrame, n: int, match_rate: float = 0.5, seed="p",
                      epoch: int = 0, author: str = "author", file_id: str = "file_id") -> DataFrame:
    """One epoch of the on-the-fly pair generator.

    Per sample: match with probability ``match_rate``.  Match: a uniform file
    among authors with > 1 file picks the author, then two distinct uniform
    files of that author.  Non-match: two distinct uniform files with different
    authors.  Drawing both and redrawing while the authors are equal has the
    same law as drawing the first author with weight n_a * (N - n_a), a uniform
    file of it, and a uniform one of the N - n_a files outside; so nothing is
    redrawn and the plan is the same for any skew.

    The weights' running sum is cut into ranges of equal width; an author is
    listed in each range that it touches, and a draw meets the authors of its
    range in an equi-join.  Raises ValueError where a kind of pair cannot exist.
    """
    tag = f"e{epoch}"
    ords = file_ordinals(files, seed, author, file_id).persist()
    counts = ords.select(author, "n_files").distinct().persist()
    n_all, n_authors, n_multi, total = counts.agg(
        F.sum("n_files"), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("n_files") > 1, F.col("n_files"))), F.lit(0)),
        F.sum(F.col("n_files").cast("decimal(19,0)") * F.col("n_files").cast("decimal(19,0)"))).first()
    n_all = int(n_all or 0)
    weight = n_all * n_all - int(total or 0)
    if match_rate < 1 and not weight:
        raise ValueError("pairs of different authors need at least two authors")
    if match_rate > 0 and not n_multi:
        raise ValueError("pairs of one author need an author with two files")
    multi = ords.where(F.col("n_files") > 1)
    gmul = hash_ordinal(multi.withColumn("_g", h(seed, "gmul", file_id)), [], "_g", [file_id], out="midx",
                        rows=int(n_multi)).drop("_g")

    s = spark.range(n).withColumnRenamed("id", "sample_id")
    s = s.withColumn("label", (u01(seed, f"{tag}m", "sample_id") < match_rate).cast("int"))
    # matched
    m = s.where("label = 1").withColumn("midx", draw(seed, f"{tag}mf", max(int(n_multi), 1), "sample_id"))
    m = m.join(gmul.select("midx", author, "n_files"), "midx")
    m = m.withColumn("_o1", F.pmod(h(seed, f"{tag}m1", "sample_id"), F.col("n_files")))
    m = m.withColumn("_o2", F.pmod(h(seed, f"{tag}m2", "sample_id"), F.col("n_files") - 1))
    m = m.withColumn("_o2", F.when(F.col("_o2") >= F.col("_o1"), F.col("_o2") + 1).otherwise(F.col("_o2")))
    f1 = ords.select(author, F.col("ordinal").alias("_o1"), F.col(file_id).alias("file_1"))
    f2 = ords.select(author, F.col("ordinal").alias("_o2"), F.col(file_id).alias("file_2"))
    matched = m.join(f1, [author, "_o1"]).join(f2, [author, "_o2"]).select(
        "sample_id", "label", "file_1", "file_2")
    # non-matched: authors laid out by a hash, with the running sum of their weights
    big = lambda c: c.cast("decimal(38,0)")
    w = counts.withColumn("_h", h(seed, "w8a", author)).withColumn("_b", F.shiftright(F.col("_h"), HASH_BITS - 10))
    w = w.withColumn("_w", big(F.col("n_files").cast("decimal(19,0)") * (F.lit(n_all) - F.col("n_files")).cast("decimal(19,0)")))
    per = w.groupBy("_b").agg(big(F.sum("_w")).alias("_sum"))
    per = per.withColumn("_off", big(F.sum("_sum").over(Window.orderBy("_b")) - F.col("_sum"))).select("_b", "_off")
    inside = Window.partitionBy("_b").orderBy("_h", author).rowsBetween(Window.unboundedPreceding, 0)
    starts = author_starts(counts, author).select(author, "_start")
    w = (w.join(starts, author).join(per, "_b").withColumn("_to", big(F.col("_off") + F.sum("_w").over(inside)))
         .withColumn("_from", big(F.col("_to") - F.col("_w"))).where(F.col("_w") > 0))
    width = max(1, -(-weight // max(1, min(int(n_authors), 1 << 20))))
    slot = lambda c: F.floor(c / F.lit(width).cast("decimal(38,0)")).cast("bigint")
    w = w.withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to") - 1))))
    draws = s.where("label = 0").select("sample_id", big(
        (big(h(seed, f"{tag}n1", "sample_id")) * F.lit(1 << HASH_BITS).cast("decimal(17,0)")
         + h(seed, f"{tag}n2", "sample_id")) % F.lit(max(weight, 1)).cast("decimal(38,0)")).alias("_u"))
    first = (draws.withColumn("_slot", slot(F.col("_u"))).join(w, "_slot")
             .where((F.col("_from") <= F.col("_u")) & (F.col("_u") < F.col("_to"))).select("sample_id", author, "n_files", "_start"))
    # all files contiguous by author: the second draw skips the first author's block
    gall = (file_ordinals(files.select(author, file_id), seed, author, file_id, with_counts=False, tag="gall")
            .join(starts, author).withColumn("gidx", F.col("_start") + F.col("ordinal")))
    c = first.withColumn("_o1", F.pmod(h(seed, f"{tag}n3", "sample_id"), F.col("n_files")))
    c = c.withColumn("_r", F.pmod(h(seed, f"{tag}n4", "sample_id"), F.lit(n_all) - F.col("n_files")))
    c = c.withColumn("gidx", F.when(F.col("_r") < F.col("_start"), F.col("_r")).otherwise(F.col("_r") + F.col("n_files")))
    g2 = gall.select("gidx", F.col(file_id).alias("file_2"))
    unmatched = (c.join(f1, [author, "_o1"]).join(g2, "gidx")
                 .select("sample_id", F.lit(0).alias("label"), "file_1", "file_2"))
    return matched.unionByName(unmatched)
