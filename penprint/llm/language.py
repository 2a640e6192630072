"""Language identification by error-correcting output codes.

Every language gets a binary codeword.  For each bit one binary byte n-gram
classifier is learned (log-odds of n-grams in the languages whose bit is 1
against the others).  A text's margins are compared with every codeword by a
logistic loss in which each classifier counts by how well it separates that
language in training (loss-weighted decoding); the nearest codeword wins, and a
small gap to the second one flags the answer as ambiguous.

Training reads at most about ``train_rows`` labelled rows of each language (a
documented bound: rows are chosen by a hash of id and text); prediction reads
every whole text.

Edge cases: a null text or one without a letter gives ``und`` with score 0, as
does a table without usable training rows; a single language has a one-word
code and is always predicted; ties go to the language first in name order;
repeated rows are predicted one by one; null labels are never learned.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

BINS = 1 << 13
TRAIN_ROWS = 4000
AMBIGUITY = 0.02
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """(n, bits) matrix of +1/-1.  Up to 7 languages: the exhaustive code of all
    2**(n-1) - 1 splits.  More: the best of 64 seeded random dense codes of
    10 * log2(n) bits by smallest distance between codewords."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 7:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    bits = bits or int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for seed in range(64):
        m = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, 1, -1).astype(np.int8)
        m = m[:, np.abs(m.sum(0)) < n]
        apart = (m.shape[1] - m.astype(int) @ m.T.astype(int)) // 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > far:
            best, far = m, least
    return best


def _bins(buf: np.ndarray, bins: int) -> list[np.ndarray]:
    """Hashed byte 2-, 3- and 4-grams that start at each position."""
    b = buf.astype(np.uint32)
    out, code = [], b
    for n in (2, 3, 4):
        if len(buf) < n:
            break
        code = (code[:-1] << np.uint32(8)) | b[n - 1:]
        h = (code + np.uint32(n * 0x01000193)) * np.uint32(2654435761)
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)) % np.uint32(bins))
    return out


def _counts(text: bytes, bins: int) -> np.ndarray:
    out = np.zeros(bins, np.int64)
    for i in range(0, max(len(text), 1), 1 << 22):  # long texts in pieces that overlap by 3 bytes
        piece = np.frombuffer(text[max(0, i - 3):i + (1 << 22)], np.uint8)
        for x in _bins(piece, bins):
            out += np.bincount(x, minlength=bins)
    return out


def _clean(text: str) -> bytes:
    return text.lower().encode()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          bins: int = BINS, train_rows: int = TRAIN_ROWS) -> dict:
    """Model from the rows of ``docs`` with a label.  The driver gets one row
    for each language and n-gram bin: bounded by languages * bins."""
    rows = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                    F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)),
                           F.lit(1 << 30)).alias("u")))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("u") < int((1 << 30) * min(1.0, train_rows / n))))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + _counts(_clean(text), bins)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "bin", "n"])

    got = (rows.where(keep).select("lang", "text").mapInArrow(count, "lang string, bin int, n long")
           .groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()) if sizes else []
    langs = sorted({r["lang"] for r in got})
    table = np.zeros((len(langs), bins))
    for r in got:
        table[langs.index(r["lang"]), r["bin"]] = r["n"]
    return fit(langs, table)


def fit(langs: list[str], table: np.ndarray) -> dict:
    """Binary classifiers and decoding weights from n-gram counts per language."""
    if not langs:
        return {"langs": [], "bins": table.shape[1]}
    code = codewords(len(langs))
    p = table / np.maximum(table.sum(1, keepdims=True), 1)  # each language weighs the same
    w = np.zeros((table.shape[1], code.shape[1]))
    floor = 0.1 / table.shape[1]
    for j in range(code.shape[1]):
        one, rest = p[code[:, j] > 0], p[code[:, j] < 0]
        if len(one) and len(rest):
            w[:, j] = np.log(one.mean(0) + floor) - np.log(rest.mean(0) + floor)
    skill = np.maximum((p @ w) * code, 0) + 1e-9
    return {"langs": langs, "bins": table.shape[1], "code": code, "w": w,
            "weight": skill / skill.sum(1, keepdims=True)}


def decode(model: dict, margins: np.ndarray, size: int) -> tuple[int, float, bool]:
    """Nearest codeword, confidence, ambiguity of one text of ``size`` n-grams."""
    scale = min(float(size), 60.0) ** 0.5
    loss = (model["weight"] * np.log1p(np.exp(np.clip(-model["code"] * margins * scale, -50, 50)))).sum(1)
    order = np.argsort(loss, kind="stable")
    share = np.exp(-(loss - loss[order[0]]) * 4)
    close = len(order) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUITY
    return int(order[0]), float(1 / share.sum()), bool(close)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: bins * code bits

    def run(batches):
        m = shared.value
        for b in batches:
            preds, scores, close = [], [], []
            for text in b.column(1).to_pylist():
                if not text or not m["langs"] or not _LETTER.search(text):
                    preds.append(UNDETERMINED), scores.append(0.0), close.append(True)
                    continue
                x = _counts(_clean(text), m["bins"])
                n = int(x.sum())
                best, score, tie = decode(m, x @ m["w"] / max(n, 1), n)
                preds.append(m["langs"][best]), scores.append(score), close.append(tie)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(close, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean"))


def keep_identified(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, whose language can be told: the text has a
    letter and its nearest codeword is not ambiguous.  Without a learned
    language only texts without a letter go."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            keep = []
            for text in b.column(at).to_pylist():
                known = bool(text and _LETTER.search(text))
                if known and m["langs"]:
                    x = _counts(_clean(text), m["bins"])
                    n = int(x.sum())
                    known = not decode(m, x @ m["w"] / max(n, 1), n)[2]
                keep.append(known)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def holdout(id_col: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~holdout("doc_id", 3, 1)))
    return (predict(docs, model)
            .select("doc_id", holdout("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous"))
