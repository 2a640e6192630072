"""Per-file embeddings and projections.

M12 has two routes:
(a) bring-your-own model: a batch function ``pandas.DataFrame -> 2-D array``
    applied with ``mapInPandas`` (one model load per task, Arrow batches);
(b) a built-in stylometric encoder: character n-grams -> ``HashingTF`` ->
    ``IDF`` -> L2 ``Normalizer``, all pyspark.ml stages.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, NGram, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.operators.bpe import slices


def char_ngram_embeddings(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 3,
                          dim: int = 1 << 12, min_doc_freq: int = 1, wanted: DataFrame | None = None) -> DataFrame:
    """M12(b): unit-length TF-IDF vectors of character n-grams (hashed).  All
    ``docs`` make the document frequencies; vectors are made of those whose ids
    are in ``wanted``, where given."""
    chars = docs.select(id_col, F.split(F.col(text), "").alias("_chars"))
    pipe = Pipeline(stages=[
        NGram(n=n, inputCol="_chars", outputCol="_grams"),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=min_doc_freq),
        Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0),
    ])
    model = pipe.fit(chars)
    out = model.transform(chars if wanted is None else chars.join(wanted.select(id_col).distinct(), id_col, "left_semi"))
    return out.select(id_col, vector_to_array("_vec", "float32").alias("embedding"))


def char_ngrams(text, n: int = 3):
    """Overlapping character n-grams of a whole text as strings (the raw terms
    hashed by ``char_ngram_embeddings``), built from array slices."""
    c = F.split(text if not isinstance(text, str) else F.col(text), "")
    m = F.greatest(F.size(c) - (n - 1), F.lit(0))
    parts = [F.slice(c, i + 1, m) for i in range(n)]
    return F.transform(F.arrays_zip(*parts), lambda z: F.concat(*[z[str(i)] for i in range(n)]))


def char_ngram_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 3) -> DataFrame:
    """(gram, n, docs): how often each character n-gram stands in all texts, and in
    how many documents (distinct non-null ids).

    Tasks count the grams of the texts they hold (n-grams are numbered rows of code
    points, sorted), so what is shuffled follows the distinct grams.  Only documents
    whose id is not unique need their (gram, id) pairs."""
    many = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col).persist()
    once = docs if many.isEmpty() else docs.join(many, id_col, "left_anti")

    def run(batches):
        for b in batches:
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for rows in slices(b.column(1), 1 << 20):
                at = range(rows.start, rows.stop)
                texts = [t or "" for t in b.column(1).slice(rows.start, len(at)).to_pylist()]
                code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
                size = np.array([len(t) for t in texts], np.int64)
                doc = np.repeat(np.arange(len(at)), size)
                if len(code) < n:
                    continue
                inside = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1])
                names, char = np.unique(code, return_inverse=True)
                grams = np.zeros(len(inside), np.int64)  # a number for each gram: the rank of its start, then a character
                for i in range(n):
                    if i:
                        grams = np.unique(grams, return_inverse=True)[1] * len(names)
                    grams += char[inside + i]
                _, first, gram, count = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
                pair = np.unique(gram * len(at) + doc[inside])
                has = np.bincount(pair // len(at), weights=known[at.start:at.stop][pair % len(at)], minlength=len(first))
                spelled = code[inside[first][:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([spelled[i:i + n] for i in range(0, len(spelled), n)], pa.string()), pa.array(count, pa.int64()),
                     pa.array(has.astype(np.int64))], ["gram", "n", "docs"])

    parts = once.select(id_col, text).mapInArrow(run, "gram string, n long, docs long")
    if not many.isEmpty():
        again = docs.join(many, id_col, "left_semi").select(id_col, F.explode(char_ngrams(text, n)).alias("gram"))
        parts = parts.unionByName(again.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("docs")))
    return parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def embed_with_model(df: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], np.ndarray]],
                     dim: int, id_col: str = "file_id", normalize: bool = True) -> DataFrame:
    """M12(a)/D2: ``load_model()`` runs once per task and returns a batch
    predictor; rows stream through it in Arrow batches."""
    def run(batches):
        predict = load_model()
        for pdf in batches:
            emb = np.asarray(predict(pdf), dtype=np.float32)
            if normalize:
                nrm = np.linalg.norm(emb, axis=1, keepdims=True)
                emb = emb / np.where(nrm == 0, 1, nrm)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "embedding": list(emb)})
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>"
    return df.mapInPandas(run, schema)


_MODELS: dict[str, Callable] = {}


def embed_sequences(df: DataFrame, load_model: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
                    model_key: str, id_col: str = "file_id", ids_col: str = "ids", pad_id: int = 0,
                    cells: int = 1 << 20, normalize: bool = True, double: bool = False) -> DataFrame:
    """M12(a)/D2 on id sequences: (id, embedding) by a model of one's own.

    ``load_model()`` gives ``predict(ids, lengths)``, rows of ids padded with
    ``pad_id`` and their lengths; it is called once a worker and ``model_key``.
    Rows that arrive together are sorted by length and cut into batches of at most
    ``cells`` padded cells (a longer row goes alone), so little is padded and a
    batch has bounded memory.  A null sequence is an empty one; a zero vector
    stays zero.  A prediction must not depend on a row's companions."""
    kind = np.float64 if double else np.float32

    def run(batches):
        if model_key not in _MODELS:
            _MODELS[model_key] = load_model()
        predict = _MODELS[model_key]
        for b in batches:
            rows = b.column(1)
            flat, start = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            order, at = np.argsort(size, kind="stable"), 0
            while at < len(order):
                end = at + 1  # the last row of a batch is its longest
                while end < len(order) and (end + 1 - at) * max(1, size[order[end]]) <= cells:
                    end += 1
                part = order[at:end]
                ids = np.full((len(part), int(size[part[-1]])), pad_id, np.int64)
                for r, k in enumerate(part):
                    ids[r, :size[k]] = flat[start[k]:start[k] + size[k]]
                emb = np.asarray(predict(ids, size[part]), kind)
                if normalize:
                    norm = np.sqrt((emb * emb).sum(axis=1, keepdims=True))
                    emb = emb / np.where(norm == 0, 1, norm)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(emb) + 1) * emb.shape[1], pa.int32()), pa.array(emb.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), vectors], [id_col, "embedding"])
                at = end

    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<{'double' if double else 'float'}>"
    return df.select(id_col, ids_col).mapInArrow(run, schema)


def project_pca(cs: DataFrame, k: int = 2, vec: str = "embedding", n_files: int | None = None) -> tuple[DataFrame, list]:
    """Centre (``StandardScaler(withMean=True, withStd=False)`` — Spark's
    PCA does not centre) and project on the first k principal components.
    ``n_files`` keeps the first n authors of every fold, as the reference.
    Returns (projection, explained variance ratio (A19))."""
    df = cs if n_files is None else cs.where(F.col("label") < n_files)
    v = df.withColumn("_v", array_to_vector(F.col(vec)))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v)
    centred = scaler.transform(v)
    pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    proj = pca.transform(centred).select(*[c for c in df.columns if c != vec],
                                         vector_to_array("_p").alias("pcs"))
    return proj, list(pca.explainedVariance.toArray())


def embedding_to_source(emb: DataFrame, files: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Attach the raw file path/text to sampled embeddings (equi-join)."""
    return emb.join(files, id_col)
