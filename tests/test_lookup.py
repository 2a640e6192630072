"""J9, S1, S6, M12(a): small fixtures and plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.operators.lookup import drop_file_index, pair_lookup, write_file_index
from penprint.plans.embed import embed_sequences
from penprint.sources import files as FS


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sort_merge(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def index(spark, tmp_path):
    rows = [("a", k, 100 + k) for k in range(40)] + [("b", k, 500 + k) for k in range(3)]
    name = write_file_index(spark.createDataFrame(rows, "author string, ordinal long, file_id long"),
                            path=str(tmp_path / "index"))
    yield name
    drop_file_index(spark, name)


def test_files_of_pairs_come_from_the_index_unshuffled(spark, index, sort_merge):
    pairs = spark.createDataFrame([("a", 0, 39, "x"), ("a", 0, 39, "x"), ("b", 2, 1, "y"), ("b", 0, 3, "no such ordinal"),
                                   ("c", 0, 1, "no such author"), (None, 0, 1, "null")],
                                  "author string, i long, j long, note string")
    got = pair_lookup(pairs, index)
    text = plan(got)
    assert text.count("Bucketed: true") == 2, text
    assert text.count("Exchange hashpartitioning") == 2, text  # the pairs alone, once for each side
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", "x", 100, 139), ("a", "x", 100, 139), ("b", "y", 502, 501)]
    assert got.columns == ["author", "note", "file_1", "file_2"]


def test_second_file_of_another_author(spark, index):
    pairs = spark.createDataFrame([("a", "b", 1, 2)], "author string, other string, i long, j long")
    assert tuple(pair_lookup(pairs, index, author_2="other").first()) == ("a", "b", 101, 502)


def test_no_pairs(spark, index):
    assert pair_lookup(spark.createDataFrame([], "author string, i long, j long"), index).count() == 0


@pytest.fixture
def tree(tmp_path):
    for name, body in {"c1/u1/p1/s1/x/a.py": b"old " * 40, "c1/u1/p1/s2/x/a.py": b"new " * 40,
                       "c1/u2/p1/s1/x/b c%.py": "é".encode() * 80, "c1/u2/p1/s1/x/d.py": b"\xe9" * 120}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(tmp_path / "tree")


def carried(df) -> str:
    """Output columns of all exchanges."""
    out = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
                                                 .fromString("formatted"))
    return " ".join(re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", out))


def test_winners_are_read_where_they_are_chosen(spark, tree, sort_merge):
    direct = FS.ingest_contest_tree(spark, tree, ["py"])
    by_scan = FS.ingest_contest_tree(spark, tree, ["py"], direct=False)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, by_scan.collect()))
    assert "content" in carried(by_scan) and carried(direct) and "content" not in carried(direct)


def test_attached_contents_move_no_bytes(spark, tree, sort_merge):
    subs = spark.createDataFrame([(1, "c1/u2/p1/s1/x/b c%.py"), (2, "missing.py"), (3, None),
                                  (4, "c1/u2/p1/s1/x/d.py"), (5, "c1/u2/p1/s1/x/d.py")], "id long, filepath string")
    for strict in (False, True):
        direct = FS.attach_contents(spark, subs, tree, strict=strict)
        by_scan = FS.attach_contents(spark, subs, tree, strict=strict, direct=False)
        got = {r.id: r.file_content for r in direct.collect()}
        assert got == {r.id: r.file_content for r in by_scan.collect()}
        assert got[1] == "é" * 80 and got[2] is got[3] is None and got[4] == got[5] == (None if strict else "é" * 120)
        assert "content" not in carried(direct) and "content" in carried(by_scan)


def test_embedding_batches_do_not_show(spark):
    """The same vectors however rows are batched; empty and null rows are zero."""
    rows = [(k, list(range(1, k % 23 + 1))) for k in range(1, 90)] + [(100, []), (101, None)]
    df = spark.createDataFrame(rows, "file_id long, ids array<int>").withColumn("clash", F.lit(1))

    def load():
        def predict(ids, lengths):
            assert ids.size <= 64 or len(ids) == 1
            inside = np.arange(ids.shape[1]) < lengths[:, None]
            return np.stack([(ids * inside).sum(axis=1), (ids * ids * inside).sum(axis=1)], axis=1)
        return predict

    got = {r.file_id: r.embedding for r in embed_sequences(df, load, "test sums", cells=64, pad_id=7).collect()}
    assert len(got) == len(rows)
    for k, ids in rows:
        x = np.array([sum(ids or []), sum(v * v for v in ids or [])], float)
        assert np.allclose(got[k], x / (np.linalg.norm(x) or 1), atol=1e-6)
