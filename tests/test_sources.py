"""File sources, sinks and experiment tables on small files written to tmp_path."""

import json

from pyspark.sql import functions as F

from penprint.operators.dedup import read_duplicate_cluster_text
from penprint.plans import experiments as X
from penprint.sources import catalog as C
from penprint.sources import files as FS
from penprint.sources import sinks as SK


def _write(path, data: bytes):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_g13_ingest_last_solution_wins(spark, tmp_path):
    root = tmp_path / "gcj"
    body = b"x = 1\n" * 40
    _write(root / "c1/u1/p1/s1/extracted/a.py", body + b"# first")
    _write(root / "c1/u1/p1/s2/extracted/a.py", body + b"# second")
    _write(root / "c1/u1/p1/s2/extracted/b.PY", body)           # extension is case-sensitive
    _write(root / "c1/u2/p1/s1/extracted/small.py", b"x")        # too small
    _write(root / "c1/u2/p1/s1/extracted/latin.py", body + "é".encode("cp1252"))
    df = FS.ingest_contest_tree(spark, str(root), ["py"], min_size=100)
    rows = {(r["username"], r["filepath"]): r for r in df.collect()}
    assert set(rows) == {("u1", "c1/u1/p1/s2/extracted/a.py"), ("u2", "c1/u2/p1/s1/extracted/latin.py")}
    assert rows[("u1", "c1/u1/p1/s2/extracted/a.py")]["file_content"].endswith("# second")
    assert rows[("u2", "c1/u2/p1/s1/extracted/latin.py")]["file_content"].endswith("é")
    both = FS.ingest_contest_tree(spark, str(root), ["py"], min_size=100, keep_repeats=True)
    assert both.where("username = 'u1'").count() == 2
    idx = FS.build_file_index(spark, str(root))
    assert idx.count() == 5 and idx.where("username = 'u2'").count() == 2


def test_g14_duplicate_clusters(spark, tmp_path):
    p = tmp_path / "dups.txt"
    p.write_text("x/L/s1.py:1\nx/L/s2.py:1\n\nx/L/s3.py:1\n")
    d = read_duplicate_cluster_text(spark, str(p), "L")
    dups = [r["submission_id"] for r in d.where("pos > 0").collect()]
    assert dups == ["s2"]


def test_g17_contest_metadata(spark, tmp_path):
    meta = {"competitions": [
        {"year": "2008", "round": [
            {"desc": "Qual", "contest": "c1", "problems": [{"name": "A", "id": "p1"}, {"name": "B", "id": "p2"}]},
            {"desc": "R1", "contest": "c2", "problems": [{"name": "C", "id": "p3"}]}]},
        {"year": "2009", "round": [{"desc": "Qual", "contest": "c3"},
                                   {"desc": "R1", "contest": "c4", "problems": [{"name": "D", "id": "p4"}]}]}]}
    p = tmp_path / "meta.json"
    p.write_text(json.dumps(meta, indent=2))
    rounds, problems = C.read_contest_metadata(spark, str(p))
    r = {x["contest"]: (x["year"], x["round_label"]) for x in rounds.collect()}
    assert r["c2"] == ("2008", "001 R1") and r["c4"] == ("2009", "001 R1")
    pr = {x["problem_id"]: x["problem_label"] for x in problems.collect()}
    assert pr == {"p1": "000 A", "p2": "001 B", "p3": "002 C", "p4": "003 D"}
    subs = spark.createDataFrame([("c1", "p2"), ("c3", "zz")], "contest string, problem string")
    e = {x["problem"]: x["problem_label"] for x in C.enrich_with_metadata(subs, rounds, problems).collect()}
    assert e == {"p2": "001 B", "zz": "004 unknown_name"}


def test_problem_catalog_and_csv_readers(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    (tmp_path / "problem_list.csv").write_text("id,dataset\np1,A\np2,B\n")
    hdr = "submission_id,problem_id,user_id,date,language,original_language,filename_ext,status,cpu_time,memory,code_size,accuracy\n"
    (tmp_path / "metadata/p1.csv").write_text(hdr + "s1,p1,u0042,0,C++,C++,cpp,A,1,1,500,1\ns2,p1,u7,0,C++,C++,cpp,A,1,1,50,1\n")
    (tmp_path / "metadata/p2.csv").write_text(hdr + "s3,p2,u9,0,C++,C++,cpp,A,1,1,500,1\n")
    cat = C.read_problem_catalog(spark, str(tmp_path), dataset="A", language="C++").collect()
    assert [(r["username"], r["filepath"]) for r in cat] == [(42, "p1/C++/s1.cpp")]
    (tmp_path / "tok.csv").write_bytes("class,token\nidentifier,x\nclass,token\noperator,+\n".encode("latin-1"))
    assert C.read_tokens_csv(spark, str(tmp_path / "tok.csv")).count() == 2
    (tmp_path / "enc.csv").write_text('username|filename|file_content\nu|f|"[1, 2, 30, ]"\n')
    assert C.read_encoded_csv(spark, str(tmp_path / "enc.csv")).first()["file_content"] == [1, 2, 30]


def test_experiments_grid_and_tables(spark, tmp_path):
    params = {"a": [1, 2], "train": ["t1", "t2"], "val": ["v1", "v2"], "b": ["x", "y", "z"]}
    g = X.param_grid(spark, params, tied=["train", "val"]).orderBy("combination").collect()
    assert len(g) == 2 * 2 * 3
    assert [(json.loads(r["a"]), r["train"], r["val"], json.loads(r["b"])) for r in g][:4] == [
        (1, "t1", "v1", "x"), (1, "t1", "v1", "y"), (1, "t1", "v1", "z"), (1, "t2", "v2", "x")]
    assert sorted(r[0] for r in X.select_combinations(spark, "0 3:6").collect()) == [0, 3, 4, 5]
    d = spark.createDataFrame([("{'C': 100, 'kernel': 'rbf', 'probability': True}",)], "model_params string")
    m = d.select(X.parse_params().alias("m")).first()["m"]
    assert m == {"C": "100", "kernel": "rbf", "probability": "True"}
    hist = spark.createDataFrame([(0, 0, 2.0, 1.5), (0, 1, 1.0, 1.2), (0, 2, 0.5, 1.2)],
                                 "combination int, epoch int, loss double, val_loss double")
    be = X.best_epoch(hist).first()
    assert (be["epoch"], be["train_loss"]) == (1, 1.0)
    p1 = tmp_path / "exp1" / "m.csv"
    p1.parent.mkdir()
    p1.write_text("combination,model,accuracy\n0,knn,0.5\n1,svm,0.7\n")
    p2 = tmp_path / "exp2" / "m.csv"
    p2.parent.mkdir()
    p2.write_text("0,knn,0.9\n")
    res = C.read_experiments(spark, [str(p1), str(p2)], header_fallback=["combination", "model", "accuracy"])
    assert res.count() == 3
    lb = X.leaderboard(res.withColumn("k_cross_val", F.lit(9)).withColumn("max_authors", F.lit(150)))
    best = {r["model"]: (r["experiment"], r["accuracy"]) for r in lb.collect()}
    assert best == {"knn": ("exp2", 0.9), "svm": ("exp1", 0.7)}


def test_split_tables_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("val", 2), ("test", 3)], "split string, file_id int")
    SK.write_split_tables(df, str(tmp_path / "out"))
    assert [r["file_id"] for r in SK.read_split(spark, str(tmp_path / "out"), "val").collect()] == [2]
