"""Registered text queries (F1–F5, F9–F11, X1, X2, X4–X6, X9–X15, X21, K1,
J2, J3, A8, A9, A11, S14) over ``documents`` (author = source), ``pages`` and
``conversations``.  Every query reads whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.functions import lexer as L
from penprint.functions import text as T
from penprint.functions.rng import h, sql_h
from penprint.operators import dedup as D
from penprint.operators.tokens import token_rows, top_identifiers
from penprint.plans.registry import register
from penprint.tables import spread, table

SEED = "p"


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CHAR_LIST_SQL = "[" + ", ".join(_sql_str(c) for c in T.CHAR_TABLE) + "]"
CHAR_IDS_SQL = (f"list_concat([1], list_transform(CASE WHEN text = '' THEN [] ELSE string_split(text, '') END, lambda c: CASE WHEN list_position("
                f"{CHAR_LIST_SQL}, c) > 0 THEN list_position({CHAR_LIST_SQL}, c) + 1 ELSE {T.CHAR_OOV} END), [0])")
WS = T.WS_CLASS

# ------------------------------------------------------------------ filters


@register("f1_filter_extension", r"""SELECT page_id, split_part(url, '/', 3) AS host,
regexp_extract(split_part(url, '/', 3), '\.([^./]*)$', 1) AS ext FROM pages
WHERE regexp_extract(split_part(url, '/', 3), '\.([^./]*)$', 1) IN ('com', 'org')""")
def f1_filter_extension(spark, sf):
    """case-sensitive extension filter (on the host name's last label)."""
    p = table(spark, sf, "pages").select("page_id", F.coalesce(F.element_at(F.split("url", "/"), 3), F.lit(""))
                                         .alias("host"))
    p = p.withColumn("ext", T.file_extension("host"))
    return p.where(F.col("ext").isin("com", "org"))


@register("f2_filter_min_size", """SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) > 100""")
def f2_filter_min_size(spark, sf):
    """strictly more than 100 bytes."""
    d = _docs(spark, sf).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return d.where(F.col("n_bytes") > 100)


@register("f3_low_char_files", "SELECT doc_id FROM documents WHERE strlen(text) < 150")
def f3_low_char_files(spark, sf):
    """files with fewer than 150 bytes."""
    return _docs(spark, sf).where(F.octet_length("text") < 150).select("doc_id")


@register("f4_filter_language", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def f4_filter_language(spark, sf):
    return _docs(spark, sf).where(F.col("lang") == "en").select("doc_id", "source")


@register("f9_derive_path_columns", r"""SELECT page_id, split_part(url, '/', 1) AS scheme, split_part(url, '/', 3) AS host,
split_part(url, '/', 4) AS lang, regexp_extract(split_part(url, '/', 5), '^([^?#]*)', 1) AS page FROM pages""")
def f9_derive_path_columns(spark, sf):
    """path components by position."""
    parts = F.split("url", "/")
    part = lambda i: F.coalesce(F.element_at(parts, i), F.lit(""))
    return table(spark, sf, "pages").select("page_id", part(1).alias("scheme"), part(3).alias("host"),
                                            part(4).alias("lang"),
                                            F.regexp_extract(part(5), r"^([^?#]*)", 1).alias("page"))


@register("f10_numeric_user_id", "SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS user_num FROM documents")
def f10_numeric_user_id(spark, sf):
    return _docs(spark, sf).select("doc_id", T.numeric_user_id("source", 3).alias("user_num"))


@register("f11_build_relative_path", """SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR) || '.txt')
AS relative_path FROM documents""")
def f11_build_relative_path(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat_ws("/", "source", "lang", F.concat(
        F.col("doc_id").cast("string"), F.lit(".txt"))).alias("relative_path"))


@register("x21_format_ordinal", "SELECT page_id, printf('%03d %s', page_id, split_part(url, '/', 4)) AS label FROM pages")
def x21_format_ordinal(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.format_ordinal("page_id", F.coalesce(F.element_at(F.split("url", "/"), 4),
                                                                      F.lit(""))).alias("label"))


# ------------------------------------------------------------------ encodings


@register("x1_char_encode", f"""SELECT doc_id, len(ids) AS n_ids, ids FROM (SELECT doc_id, {CHAR_IDS_SQL} AS ids FROM documents)
WHERE len(ids) > 10""")
def x1_char_encode(spark, sf):
    """X1 + F5: character ids of every document (kept when more than 10 ids)."""
    # F5 on the id count = characters + 2, so the filter never re-evaluates the encoder
    d = _docs(spark, sf).where(F.length("text") + 2 > 10)
    d = d.select("doc_id", T.char_encode("text").alias("ids"))
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


@register("x2_binary_encode", f"""SELECT doc_id, CAST(list_sum(list_transform(ids, lambda i:
list_sum(list_transform(generate_series(0, 7), lambda b: (i >> b) & 1)))) AS BIGINT) AS set_bits,
8 * len(ids) AS n_bits FROM (SELECT doc_id, {CHAR_IDS_SQL} AS ids FROM documents)""")
def x2_binary_encode(spark, sf):
    """8-bit binary form of the character ids; set bits and total bits per document."""
    bits = T.binary_encode(T.char_encode("text"))
    flat = F.flatten(bits)
    return _docs(spark, sf).select("doc_id", F.aggregate(flat, F.lit(0).cast("bigint"),
                                                         lambda a, x: a + x).alias("set_bits"),
                                   (F.size(flat)).cast("bigint").alias("n_bits"))


@register("x4_clean_for_subwords", """SELECT doc_id, replace(replace(replace(text, chr(0), ''), chr(9), '[TAB]'), chr(10), '[EOL]')
AS cleaned FROM documents""")
def x4_clean_for_subwords(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_for_subwords("text").alias("cleaned"))


@register("x5_corpus_lines", """SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] || '[EOL]' || chr(10) AS line
FROM (SELECT doc_id, string_split(replace(replace(text, chr(0), ''), chr(9), '[TAB]'), chr(10)) AS parts FROM documents),
LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)""")
def x5_corpus_lines(spark, sf):
    """X4 (by-line) + X5: one row per source line."""
    d = _docs(spark, sf).select("doc_id", F.posexplode(T.clean_lines_for_subwords("text")).alias("line_no", "line"))
    return d.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")


@register("x6_whitespace_keeping_split", f"""SELECT doc_id, len(p) AS n_pieces, p AS pieces FROM (
SELECT doc_id, list_concat(CASE WHEN regexp_matches(text, '^{WS}') OR length(text) = 0 THEN [''] ELSE [] END,
  regexp_extract_all(text, '({WS}+|[^{T.WS_SET}]+)', 1),
  CASE WHEN regexp_matches(text, '{WS}$') THEN [''] ELSE [] END) AS p FROM documents)""")
def x6_whitespace_keeping_split(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.whitespace_keeping_split("text").alias("pieces"))
    return d.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces")


@register("x11_crop_prefix_with_end", f"""SELECT doc_id,
list_concat([2], ids[1:least(len(ids), 500) - 2], [2]) AS cropped
FROM (SELECT doc_id, {CHAR_IDS_SQL} AS ids FROM documents)""")
def x11_crop_prefix_with_end(spark, sf):
    return _docs(spark, sf).select("doc_id", T.crop_prefix_with_end(T.char_encode("text"), 500).alias("cropped"))


@register("x12_pad_to", f"""SELECT doc_id, list_concat(ids[1:1200], list_transform(generate_series(1, greatest(1200 - len(ids[1:1200]), 0)),
lambda x: 0)) AS padded FROM (SELECT doc_id, {CHAR_IDS_SQL} AS ids FROM documents)""")
def x12_pad_to(spark, sf):
    return _docs(spark, sf).select("doc_id", T.pad_to(T.char_encode("text"), 1200).alias("padded"))


@register("x13_random_crop", f"""SELECT doc_id,
CASE WHEN length(text) > 200 THEN {sql_h(SEED, 'crop', 'doc_id')} % (length(text) - 200 + 1) ELSE 0 END AS start,
CASE WHEN length(text) > 200 THEN substr(text, ({sql_h(SEED, 'crop', 'doc_id')} % (length(text) - 200 + 1)) + 1, 200)
     ELSE text END AS crop,
greatest(200 - length(text), 0) AS pad FROM documents""")
def x13_random_crop(spark, sf):
    """A 200-character window at a hash-uniform start (NUL padding length reported)."""
    n = F.length("text")
    start = F.when(n > 200, F.pmod(h(SEED, "crop", "doc_id"), n - 200 + 1)).otherwise(F.lit(0))
    crop = T.random_crop("text", 200, SEED, "doc_id")
    return _docs(spark, sf).select("doc_id", start.cast("bigint").alias("start"),
                                   F.regexp_replace(crop, "\u0000+$", "").alias("crop"),
                                   F.greatest(F.lit(200) - n, F.lit(0)).cast("bigint").alias("pad"))


@register("x14_truncate_lines", """SELECT doc_id, list_transform(string_split(text, chr(10))[1:20], lambda l: left(l, 80)) AS lines
FROM documents""")
def x14_truncate_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", T.truncate_lines("text", 20, 80).alias("lines"))


@register("x15_concat_pair", f"""SELECT a.doc_id AS doc_1, b.doc_id AS doc_2,
len(list_concat(a.ids, [-1], b.ids)) AS n_ids, list_concat(a.ids, [-1], b.ids) AS ids
FROM (SELECT doc_id, {CHAR_IDS_SQL.replace('string_split(text', 'string_split(left(text, 100)')} AS ids FROM documents) a
JOIN (SELECT doc_id, {CHAR_IDS_SQL.replace('string_split(text', 'string_split(left(text, 100)')} AS ids FROM documents) b
ON b.doc_id = a.doc_id + 1""")
def x15_concat_pair(spark, sf):
    """Consecutive documents cut to 100 characters, joined by a separator id."""
    d = _docs(spark, sf).select("doc_id", T.char_encode(T.truncate_text("text", 100)).alias("ids"))
    a = d.select(F.col("doc_id").alias("doc_1"), F.col("ids").alias("a"))
    b = d.select((F.col("doc_id") - 1).alias("doc_1"), F.col("doc_id").alias("doc_2"), F.col("ids").alias("b"))
    p = a.join(b, "doc_1").select("doc_1", "doc_2", T.concat_pair("a", "b", F.lit(-1)).alias("ids"))
    return p.select("doc_1", "doc_2", F.size("ids").cast("bigint").alias("n_ids"), "ids")


# ------------------------------------------------------------------ lexer


def _tok_sql() -> str:
    case = "CASE " + " ".join(
        f"WHEN regexp_full_match(tok, {_sql_str(p)}) THEN "
        + ("(CASE WHEN list_contains(" + "[" + ", ".join(_sql_str(k) for k in L.CPP_KEYWORDS) + "]"
           + ", tok) THEN 'keyword' ELSE 'identifier' END)" if c == "identifier" else _sql_str(c))
        for c, p in L.TOKEN_RULES) + " END"
    return (f"toks AS (SELECT doc_id, pos, tok, {case} AS class FROM (SELECT doc_id, "
            f"unnest(regexp_extract_all(text, {_sql_str(L.TOKEN_PATTERN)})) AS tok, "
            f"unnest(generate_series(1, len(regexp_extract_all(text, {_sql_str(L.TOKEN_PATTERN)})))) AS pos "
            f"FROM documents))")


@register("x9_lex_class_counts", f"""WITH {_tok_sql()}
SELECT doc_id, class, count(*) AS n_tokens FROM toks GROUP BY doc_id, class""")
def x9_lex_class_counts(spark, sf):
    """The token stream of every document, counted per class."""
    t = token_rows(_docs(spark, sf))
    return t.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n_tokens"))


TOP_N = 50
ALPHA_SQL = "[" + ", ".join(_sql_str(c) for c in L.ALPHABET) + "]"
TOPID_SQL = f"""{_tok_sql()},
idc AS (SELECT left(tok, 20) AS token, count(*) AS cnt FROM toks WHERE class = 'identifier' GROUP BY left(tok, 20)),
idt AS (SELECT token, cnt FROM idc ORDER BY cnt DESC, token LIMIT {TOP_N + 100}),
idf AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) AS rk FROM idt
        WHERE NOT list_contains({ALPHA_SQL}, token)),
top AS (SELECT CAST(rk AS INTEGER) AS rank, token, cnt AS count FROM idf WHERE rk <= {TOP_N})"""


@register("k1_top_identifiers", f"WITH {TOPID_SQL} SELECT rank, token, count FROM top")
def k1_top_identifiers(spark, sf):
    """K1: the 50 most frequent identifiers (cut to 20 characters), single
    characters removed, over all documents."""
    return top_identifiers(_docs(spark, sf), TOP_N)


def _enc_sql() -> str:
    ops = "[" + ", ".join(_sql_str(o) for o in L.OPERATORS) + "]"
    kws = "[" + ", ".join(_sql_str(k) for k in L.CPP_KEYWORDS) + "]"
    cls = "CASE class " + " ".join(f"WHEN {_sql_str(k)} THEN {v}" for k, v in L.CLASS_IDS.items()) + " END"
    res_base = L.KEYWORD_BASE + len(L.CPP_KEYWORDS)
    spell = (f"list_transform(string_split(tok, ''), lambda ch: CASE WHEN list_position({ALPHA_SQL}, ch) > 0 "
             f"THEN list_position({ALPHA_SQL}, ch) + {L.ALPHABET_BASE - 1} ELSE 0 END)")
    return f"""{TOPID_SQL},
rl AS (SELECT list(token ORDER BY rank) AS reserved FROM top),
te AS (SELECT doc_id, pos, CASE
   WHEN class = 'operator' THEN [list_position({ops}, tok) + {L.OPERATOR_BASE - 1}]
   WHEN class = 'keyword' THEN [list_position({kws}, tok) + {L.KEYWORD_BASE - 1}]
   WHEN class = 'identifier' THEN (CASE WHEN list_position(rl.reserved, tok) > 0
        THEN [list_position(rl.reserved, tok) + {res_base - 1}] ELSE {spell} END)
   ELSE [{cls}] END AS ids FROM toks, rl)"""


@register("x10_encode_tokens", f"""WITH {_enc_sql()}
SELECT d.doc_id, coalesce(e.ids, []::INTEGER[]) AS ids FROM documents d LEFT JOIN
(SELECT doc_id, CAST(flatten(list(ids ORDER BY pos)) AS INTEGER[]) AS ids FROM te GROUP BY doc_id) e USING (doc_id)""")
def x10_encode_tokens(spark, sf):
    """X9 + X10: lexer-token ids of every document with the K1 identifiers reserved."""
    # token arrays take many times the text, so K1 and the encoder each lex the
    # documents where they are read; nothing is kept between them
    lexed = _docs(spark, sf).select("doc_id", L.lex("text").alias("toks"))
    top = top_identifiers(lexed, TOP_N, tokens_col="toks")
    reserved = [r["token"] for r in top.orderBy("rank").collect()]  # bounded: TOP_N
    return lexed.select("doc_id", L.encode_token_array("toks", reserved).alias("ids"))


# ------------------------------------------------------------------ dedup / audit


@register("j2_drop_duplicates_by_cluster", """SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS f
FROM documents) WHERE doc_id = f""")
def j2_drop_duplicates_by_cluster(spark, sf):
    """S5 + J2: exact-copy clusters; all but the first copy are dropped."""
    d = _docs(spark, sf)
    dups = D.duplicates_from_clusters(D.content_clusters(d, "doc_id"), "doc_id")
    return D.drop_duplicates_by_cluster(d.select("doc_id"), dups, "doc_id")


@register("a11_cross_author_duplicates", """SELECT md5(text) AS cluster, count(*) AS copies, count(DISTINCT source) AS authors,
max(length(text)) AS length FROM documents GROUP BY md5(text) HAVING count(DISTINCT source) > 1""")
def a11_cross_author_duplicates(spark, sf):
    g = D.cross_author_duplicates(_docs(spark, sf), "doc_id", "source")
    return g.select("cluster", "copies", "authors", F.col("length").cast("bigint").alias("length"))


@register("j3_keep_last_submission", """SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER
(PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def j3_keep_last_submission(spark, sf):
    """Per (conversation, role) the last turn wins."""
    c = table(spark, sf, "conversations").select("conv_id", "role", "turn", "text")
    return D.keep_last(c, ["conv_id", "role"], ["turn"])


@register("a8_corpus_length_stats", """SELECT max(length(text)) AS max_chars, count(*) AS n_files,
round(avg(length(text)), 6) AS avg_chars FROM documents""")
def a8_corpus_length_stats(spark, sf):
    return _docs(spark, sf).agg(F.max(F.length("text")).cast("bigint").alias("max_chars"),
                                F.count(F.lit(1)).alias("n_files"),
                                F.round(F.avg(F.length("text")), 6).alias("avg_chars"))


@register("a9_special_char_audit", """SELECT CAST(count_if(contains(text, chr(0))) AS BIGINT) AS with_nul,
CAST(count_if(contains(replace(text, chr(0), ''), chr(0))) AS BIGINT) AS with_nul_after_clean,
CAST(count_if(contains(text, chr(9))) AS BIGINT) AS with_tab,
CAST(count_if(contains(text, chr(13))) AS BIGINT) AS with_cr FROM documents""")
def a9_special_char_audit(spark, sf):
    d = _docs(spark, sf)
    return d.agg(F.count_if(F.col("text").contains("\u0000")).alias("with_nul"),
                 F.count_if(F.regexp_replace("text", "\u0000", "").contains("\u0000")).alias("with_nul_after_clean"),
                 F.count_if(F.col("text").contains("\t")).alias("with_tab"),
                 F.count_if(F.col("text").contains("\r")).alias("with_cr"))


@register("s14_ingest_audit", """WITH d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents)
SELECT CASE WHEN strlen(text) <= 100 THEN 'too_small' WHEN doc_id <> f THEN 'duplicate' ELSE 'loaded' END AS reject_reason,
count(*) AS files, CAST(count_if(contains(text, '�')) AS BIGINT) AS with_replacement_chars FROM d GROUP BY 1""".replace(
    "\\ufffd", "�"))
def s14_ingest_audit(spark, sf):
    """Files loaded / rejected by size (<= 100 bytes) / by duplicate, one pass."""
    d = _docs(spark, sf).select("doc_id", "text")
    dups = D.duplicates_from_clusters(D.content_clusters(d, "doc_id"), "doc_id")
    return D.ingest_audit(d, 100, dups, "doc_id")
