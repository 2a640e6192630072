import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from penprint.llm import suffixes
from tests.conftest import SF001
from tests.llm.test_jaccard import brute as linked
from tests.llm.test_packing import check


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "jaccard_join", "suffix_dedup", "decontamination", "packing"]


def test_run_against_brute_force(spark):
    """Every stage by its definition; the classifier keeps all texts here."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    bench = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    kept = {i for i, _, c in linked(rows, 80, 100, 5) if i == c}
    rows = [(i, t) for i, t in rows if i in kept]
    spans = suffixes.brute_force(dict(rows))
    out = []
    for i, t in rows:
        raw = t.encode()
        mask = np.zeros(len(raw), bool)
        for a, b in spans[i]:
            mask[a:b] = True
        if mask.any():
            mask = suffixes.whole_characters(raw, mask)
        t = np.frombuffer(raw, np.uint8)[~mask].tobytes().decode()
        if t:
            out.append((i, t))
    verbatim = {i for i, t in out if any(b in t for b in bench)}
    got = corpus_pipeline.run(spark, SF001).collect()
    have = {r.doc_id for r in got}
    assert have <= {i for i, _ in out} - verbatim
    left_out = {i for i, _ in out} - verbatim - have
    # what else goes holds a benchmark item in part
    for i in left_out:
        t = dict(out)[i]
        assert any(sum(b[k:k + 30] in t for k in range(0, len(b) - 30, 10)) > 1 for b in bench), i
    pad, _ = check([(i, t) for i, t in out if i in have], got, 2048)
    assert pad == 0


@pytest.mark.parametrize("extra", [False, True])
def test_stages_on_hostile_rows(make, hostile, spark, extra):
    docs = make(hostile + [hostile[6], hostile[6], (None, "a row of its own without any id " * 3)], extra=extra)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        if name != "packing":
            assert out.columns == columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
    ids = [r.doc_id for r in docs.collect()]
    # of the rows without an id one is near document 50; all of document 50 stands in earlier ones
    assert len(ids) == len(set(ids)) and None in ids and not {1, 2, 3, 50, 51} & set(ids)
    assert out.select("doc_id").distinct().count() == len(ids)


def test_near_copies_go_by_five_words(make, spark, hostile):
    """Two words in 100 changed: 0.81 of the five-word shingles, 0.88 of the three-word ones."""
    base = [f"w{i}" for i in range(100)]
    changed = [f"e{i}" if i in (30, 60) else w for i, w in enumerate(base)]
    far = [f"e{i}" if i in (20, 50, 80) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(far)), *hostile[16:36]]
    out = corpus_pipeline.drop_near_duplicates(spark, make(rows), SF001)
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in linked(rows, 80, 100, 5)})
    assert {1, 3} <= {r.doc_id for r in out.collect()} and 2 not in {r.doc_id for r in out.collect()}


def test_empty_table(make, spark):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        assert out.count() == 0


def test_clean_documents_stay(spark):
    """Documents without a copy, a shared passage or a benchmark item keep their text."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = corpus_pipeline.identify_language(spark, docs, SF001)
    assert out.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_texts_go_to_python_in_small_batches(spark, make):
    """A batch of texts is held outside the heap, twice while it grows."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        if name == "decontamination":  # no Python
            continue
        own = spark.newSession()
        docs = own.createDataFrame(make([(1, "one text"), (2, "two texts here")]).collect(), make([]).schema)
        stage(own, docs, "")
        got = own.range(0, 6000, 1, 1).selectExpr("repeat('x', 5000) t").mapInArrow(sizes, "n long").collect()
        assert len(got) > 1 and max(r.n for r in got) < 6 << 20, name
        chosen = spark.newSession()
        chosen.conf.set(key, "1m")
        stage(chosen, chosen.createDataFrame(docs.collect(), docs.schema), "")
        assert chosen.conf.get(key) == "1m"
