"""License scans by a positional index of rare words, in DataFrame functions.

Template texts of licences are indexed by their telling words: word -> (template,
position).  The document frequency of these words is counted over all documents.
The key word with the highest IDF of each template opens candidates: a document
without any of them holds no template.  In the others every occurrence of an
indexed word votes for (template, place of the template's start in the document),
postings meet where their relative positions agree, and a placement counts if all
mandatory key words stand at their places and at least ``COVERAGE`` of the
telling words do.

Base phrases are places where the phrase's words stand consecutively.

Edge cases: a null text is empty (no words, no labels, null places, score 0);
repeated rows are scanned one by one; words of the index that no document has
get the highest IDF; ties of IDF go by the word.  The choice of the opening words
changes the work, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from penprint.llm.frames import saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVERAGE = 0.5

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening lines of licences (label, text, mandatory key phrase).
TEMPLATES = [
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "permission to use copy modify and or distribute"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
]
# Words too common to tell a licence; not indexed outside base phrases.
COMMON = "a and any are copy for free in into is of or the terms this to under use with without".split()


def postings() -> list[tuple]:
    """(word, template, position, key) of the telling words and key words."""
    out = []
    for t, (_, text, key) in enumerate(TEMPLATES):
        words, keys = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(keys)] == keys)
        for i, w in enumerate(words):
            if w not in COMMON:
                out.append((w, t, i, at <= i < at + len(keys)))
    return out


def opening_words(df: dict) -> list[str]:
    """The rarest key word of each template: every placement has it."""
    return sorted({min((df.get(w, 0), w) for w, t, _, key in postings() if key and t == one)[1]
                   for one in range(len(TEMPLATES))})


def _values(spark, rows, names: str) -> DataFrame:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else str(x).lower()
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: its number of words, and the place and word of
    every occurrence of an indexed word."""
    index = sorted({w for w, *_ in postings()} | {w for p in BASE for w in p.split()})

    def scan(words: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: words[i].isin(index))
        at = F.when(F.size(words) > 0, at).otherwise(F.array().cast("array<int>"))
        return F.struct(F.size(words).cast("long").alias("n_words"),
                        F.transform(at, lambda i: F.struct(i.alias("at"), words[i].alias("word"))).alias("hits"))

    # the words are bound once, as the only element of an array
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    return (docs.select(F.col(id_col).alias("doc_id"), F.transform(F.array(words), scan)[0].alias("s"))
            .select("doc_id", "s.n_words", "s.hits", F.monotonically_increasing_id().alias("row")))


def _base(phrase: str) -> Column:
    """Places of a phrase: indexed words that follow each other."""
    words = phrase.split()

    def here(k):
        ok = F.lit(True)
        for j, w in enumerate(words):
            nxt = F.try_element_at("hits", k + 1 + j)
            ok = ok & (nxt["word"] == w) & (nxt["at"] == F.col("hits")[k]["at"] + j)
        return F.coalesce(ok, F.lit(False))

    idx = F.when(F.size("hits") > 0, F.sequence(F.lit(0), F.size("hits") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(idx, here), lambda k: F.col("hits")[k]["at"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_places) for every row."""
    spark = docs.sparkSession
    occ = saved(occurrences(docs, id_col, text_col))
    index = F.broadcast(_values(spark, postings(), "word, template, pos, key"))  # fixed size
    sizes = {t: (sum(p[1] == t for p in postings()), sum(p[1] == t and p[3] for p in postings()))
             for t in range(len(TEMPLATES))}
    about = F.broadcast(_values(spark, [(t, TEMPLATES[t][0], *sizes[t]) for t in sizes],
                                "template, label, n_telling, n_key"))  # fixed size
    # document frequency of each indexed word (as many rows as the index has words)
    df = {r[0]: r[1] for r in occ.select(F.explode(F.array_distinct("hits.word")).alias("word"))
          .groupBy("word").count().collect()}
    opening = opening_words(df)

    hits = (occ.where(F.exists("hits", lambda h: h["word"].isin(opening))).select("row", F.explode("hits").alias("h"))
            .select("row", "h.at", "h.word"))
    placed = (hits.join(index, "word")
              .groupBy("row", "template", (F.col("at") - F.col("pos")).alias("start"))
              .agg(F.count("*").alias("n"), F.sum(F.col("key").cast("int")).alias("keys"))
              .join(about, "template")
              .where((F.col("keys") == F.col("n_key")) & (F.col("n") >= COVERAGE * F.col("n_telling"))))
    found = (placed.groupBy("row")
             .agg(F.collect_set("label").alias("found"), F.count("*").alias("n_places"),
                  F.max(F.col("n") / F.col("n_telling")).alias("score")))

    places = {label: _base(phrase) for phrase, label in BASE.items()}
    base = occ.select("row", "doc_id", "n_words", *[p.alias(f"_{i}") for i, p in enumerate(places.values())])
    every = F.concat(*[F.col(f"_{i}") for i in range(len(places))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_{i}") > 0, label) for i, label in enumerate(places)]))
    join = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    return (base.select("row", "doc_id", "n_words", every.alias("places"), labels.alias("own"))
            .join(found, "row", "left")
            .select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                    F.array_min("places").cast("long").alias("first_word"),
                    F.array_max("places").cast("long").alias("last_word"),
                    join(F.col("own")).alias("base_labels"),
                    join(F.concat("own", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score"),
                    F.coalesce("n_places", F.lit(0)).cast("long").alias("n_places")))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join(f"('{w}', {t}, {i}, {k})" for w, t, i, k in postings())
    names = ", ".join(f"({t}, '{x[0]}')" for t, x in enumerate(TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT a.doc_id, a.place, '{label}' AS label FROM w a " + " ".join(
            f"JOIN w w{j} ON w{j}.doc_id = a.doc_id AND w{j}.place = a.place + {j} AND w{j}.word = '{x}'"
            for j, x in enumerate(p.split()) if j) + f" WHERE a.word = '{p.split()[0]}'"
        for p, label in BASE.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH post(word, template, pos, key) AS (VALUES {rows}), names(template, label) AS (VALUES {names}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM d),
base AS ({phrases}),
bagg AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi FROM base GROUP BY 1),
hits AS (SELECT doc_id, place, word FROM w WHERE word IN (SELECT word FROM post)),
about AS (SELECT template, count(*) AS n_telling, count(*) FILTER (key) AS n_key FROM post GROUP BY 1),
placed AS (SELECT h.doc_id, p.template, h.place - p.pos AS start, count(*) AS n, count(*) FILTER (p.key) AS keys
        FROM hits h JOIN post p ON h.word = p.word GROUP BY 1, 2, 3),
good AS (SELECT placed.doc_id, names.label, n / n_telling AS score FROM placed
        JOIN about ON placed.template = about.template JOIN names ON placed.template = names.template
        WHERE keys = n_key AND n >= {COVERAGE} * n_telling),
gagg AS (SELECT doc_id, count(*) AS n, max(score) AS score FROM good GROUP BY 1),
lab AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM
        (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM good) GROUP BY 1),
blab AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM
        (SELECT DISTINCT doc_id, label FROM base) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(bagg.n, 0) AS n_base,
  CAST(bagg.lo AS BIGINT) AS first_word, CAST(bagg.hi AS BIGINT) AS last_word,
  coalesce(blab.s, '') AS base_labels, coalesce(lab.s, '') AS labels,
  CAST(coalesce(gagg.score, 0) AS DOUBLE) AS score, coalesce(gagg.n, 0) AS n_places
FROM d LEFT JOIN bagg ON d.doc_id = bagg.doc_id LEFT JOIN gagg ON d.doc_id = gagg.doc_id
LEFT JOIN lab ON d.doc_id = lab.doc_id LEFT JOIN blab ON d.doc_id = blab.doc_id
"""


OP1_SQL = _sql()
