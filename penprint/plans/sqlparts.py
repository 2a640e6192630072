"""Reusable DuckDB SQL fragments for the oracle side."""

from __future__ import annotations

from penprint.functions.rng import sql_h


def cosine_sql(a: str, b: str) -> str:
    return (f"(list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / "
            f"(sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * "
            f"sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[]))))")


def closed_set_sql(k: int, seed: str = "p", max_authors: int | None = None) -> str:
    """CTEs ``cs`` (file_id, author, embedding, label, fold, row_index) over ``embeddings``."""
    lim = f"ORDER BY author LIMIT {max_authors}" if max_authors else ""
    return f"""
f AS (SELECT vec_id AS file_id, label AS author, embedding FROM embeddings),
elig AS (SELECT author FROM (SELECT author FROM f GROUP BY author HAVING count(*) >= {k}) {lim}),
lab AS (SELECT author, (row_number() OVER (ORDER BY author) - 1) AS label FROM elig),
nauth AS (SELECT count(*) AS a FROM lab),
pick AS (SELECT f.file_id, f.author, f.embedding, lab.label,
                row_number() OVER (PARTITION BY f.author ORDER BY {sql_h(seed, 'file', 'f.file_id')}, f.file_id) - 1 AS fold
         FROM f JOIN lab USING (author)),
cs0 AS (SELECT * FROM pick WHERE fold < {k}),
cs AS (SELECT file_id, author, embedding, CAST(label AS INTEGER) AS label,
              CAST(ntile({k}) OVER (ORDER BY fold, label) - 1 AS INTEGER) AS fold,
              CAST(fold * (SELECT a FROM nauth) + label AS BIGINT) AS row_index
       FROM cs0)"""


def draws_sql(q: str, space: str) -> str:
    """Enough draws for q distinct values: a quota near the whole space needs
    about space * ln(space) of them."""
    return (f"CASE WHEN {space} <= 4 * {q} + 64 THEN CAST({space} * (ln({space}) + 25) AS BIGINT) + 64 "
            f"ELSE 2 * {q} + 31 END")


def distinct_sql(groups: str, key: str, tag: str, seed: str = "p") -> str:
    """Oracle of ``sampling.sample_distinct`` for a CTE ``groups`` with columns
    (key, sp, q): CTE ``dv`` (key, value)."""
    return f"""dq AS (SELECT {key} AS k, sp, q FROM {groups} WHERE q > 0),
ds AS (SELECT k, q, sp, unnest(generate_series(0, {draws_sql('q', 'sp')})) AS t FROM dq),
ds1 AS (SELECT k, q, {sql_h(seed, tag, 'k', 't')} % sp AS value, t FROM ds),
ds2 AS (SELECT k, q, value, min(t) AS t FROM ds1 GROUP BY k, q, value),
ds3 AS (SELECT * FROM (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY t) AS o, q FROM ds2) WHERE o <= q),
dv AS (SELECT k AS {key}, value FROM ds3)"""
