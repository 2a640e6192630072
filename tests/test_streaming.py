from penprint.streaming.ingest import run_ingest


def test_incremental_ingest(spark, tmp_path):
    root = tmp_path / "tree"
    f = root / "c1/u1/p1/s1/extracted/a.py"
    f.parent.mkdir(parents=True)
    f.write_bytes(b"print(1)\n" * 20)
    (root / "c1/u1/p1/s1/extracted/b.txt").write_bytes(b"x" * 500)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run_ingest(spark, str(root), out, ck, ["py"])
    assert spark.read.parquet(out).count() == 1
    g = root / "c1/u2/p1/s1/extracted/c.py"
    g.parent.mkdir(parents=True)
    g.write_bytes(b"print(2)\n" * 20)
    run_ingest(spark, str(root), out, ck, ["py"])   # only the new file is processed
    df = spark.read.parquet(out)
    assert sorted(r["username"] for r in df.collect()) == ["u1", "u2"]
