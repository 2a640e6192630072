"""Token streams (A7 rows) and the reserved-identifier vocabulary (K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions.lexer import ALPHABET, CPP_KEYWORDS, identifier_tokens, identifiers, lex, token_class
from penprint.operators.ranking import first_k
from penprint.operators.scan import running_start
from penprint.session import cut_lineage


def token_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keywords=CPP_KEYWORDS) -> DataFrame:
    """X9 as rows: (id, pos, class, token) — position explicit, since rows are
    unordered.  The class is computed after the explode, as a plain (codegen)
    expression."""
    t = docs.select(id_col, F.posexplode(lex(text)).alias("pos", "token"))
    return t.select(id_col, "pos", token_class(F.col("token"), keywords).alias("class"), "token")


def _first_rows(rows: DataFrame, id_col: str, fraction: float) -> DataFrame:
    """The first ``fraction`` of the rows in (document, position) order.  A
    distributed running sum of the documents' row counts tells which documents
    are in whole; only the one at the cut is ordered."""
    per = cut_lineage(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")))
    n_docs, total = per.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    limit = int(total * fraction)
    starts = cut_lineage(running_start(per, [F.col(id_col).asc_nulls_first()], "_n", "_start", rows=n_docs))
    whole = starts.where(F.col("_start") + F.col("_n") <= limit).select(F.col(id_col).alias("_id"))
    out = rows.join(whole, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    cut = starts.where((F.col("_start") < limit) & (F.col("_start") + F.col("_n") > limit)).first()
    if cut is None:
        return out
    part = rows.where(F.col(id_col).eqNullSafe(F.lit(cut[id_col]))).orderBy("pos", "token")
    return out.unionByName(part.limit(limit - cut["_start"]))


def top_identifiers(docs: DataFrame, n: int, fraction: float | None = None, id_col: str = "doc_id",
                    text: str = "text", keywords=CPP_KEYWORDS, max_len: int = 20,
                    tokens_col: str | None = None) -> DataFrame:
    """K1: identifiers cut to ``max_len`` characters, counted; the n + 100 most
    frequent (ties: token ascending), the 63 single characters of the spelling
    alphabet removed, the first n kept.  Output (rank, token, count).

    ``fraction`` counts only the first fraction of the identifier rows in
    (document, position) order, as the reference does with 1/3.  The count is
    a partial aggregate; only n + 100 rows are ever ordered (TakeOrderedAndProject).
    """
    if fraction is None and tokens_col is not None:
        rows = docs.select(F.explode(identifier_tokens(F.col(tokens_col), keywords)).alias("token"))
    elif fraction is None:
        rows = docs.select(F.explode(identifiers(text, keywords)).alias("token"))
    else:
        rows = _first_rows(token_rows(docs, id_col, text, keywords).where(F.col("class") == "identifier"),
                           id_col, fraction)
    counts = rows.groupBy(F.left(F.col("token"), F.lit(max_len)).alias("token")).agg(
        F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.col("count").desc(), F.col("token")).limit(n + 100)
    top = top.where(~F.col("token").isin(list(ALPHABET)))
    ranked = first_k(top, [], [F.col("count").desc(), F.col("token")], n, out="rank")
    return ranked.select(F.col("rank").cast("int").alias("rank"), "token", "count")
