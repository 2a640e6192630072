import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents table from {id: text} or a list of (id, text[, lang])."""
    def build(rows, extra=False):
        rows = list(rows.items()) if isinstance(rows, dict) else rows
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # columns whose names the operators use themselves
            for c in ("_key", "_text", "_id", "grp", "kind", "bucket", "cls", "n", "key", "row", "word"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df
    return build


@pytest.fixture(scope="session")
def hostile():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text,
    characters of several bytes, and passages that come again."""
    import random
    r = random.Random(3)
    syllables = "the of an er th on é ñ ü tion ing ha ré 中文 🙂".split()

    def words(n):
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    passage = words(70)
    base = words(120).split()
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "a b"), (None, "null id " + passage)]
    rows += [(10 + i, words(20) + " " + passage + "\n" + words(r.randint(0, 30))) for i in range(12)]
    for i in range(12):  # near copies
        w = list(base)
        for _ in range(i):
            w[r.randrange(len(w))] = words(1)
        rows.append((30 + i, " ".join(w)))
    rows += [(50, passage), (51, passage), (52, passage.upper()), (53, "be " * 400), (54, "x" * 350)]
    rows += [(60, words(6000)), (61, "12 34. 56,7 %% !!")]
    return rows
