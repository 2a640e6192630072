"""Empty, short and null inputs of the text and table operators."""

from pyspark.sql import functions as F

from penprint.functions import lexer as L
from penprint.functions import text as T
from penprint.operators import bpe, dedup
from penprint.plans.corpus import materialise_pairs
from penprint.plans.experiments import upsert_results
from penprint.sources.files import attach_contents, decode_bytes


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first().x


def test_character_ids_of_the_empty_text(spark):
    assert one(spark, "", T.char_encode("t")) == [1, 0]


def test_crop_of_short_rows(spark):
    df = spark.createDataFrame([([],), ([5],), ([5, 6],), ([5, 6, 7, 8],)], "ids array<int>")
    got = [r.x for r in df.select(T.crop_prefix_with_end("ids", 3).alias("x")).collect()]
    assert got == [[], [2], [2, 2], [2, 5, 2]]


def test_unicode_white_space_splits(spark):
    assert one(spark, "a\u00a0b\x1cc\u3000", T.whitespace_keeping_split("t")) == [
        "a", "\u00a0", "b", "\x1c", "c", "\u3000", ""]


def test_cuts_in_bytes(spark):
    assert bytes(one(spark, "é€x", T.cut_bytes("t", 3))) == "é€x".encode()[:3]
    got = one(spark, "éé\nab\nc", T.cut_line_bytes("t", 2, 3))
    assert [bytes(b) for b in got] == ["éé".encode()[:3], b"ab"]


def test_one_hot_zero_rows(spark):
    df = spark.createDataFrame([([0, 2, 9],)], "ids array<int>")
    got = df.select(T.one_hot("ids", 3, 5).alias("x")).first().x
    assert got == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0], [0, 0, 0]]


def test_upsert_keeps_null_keys_and_one_of_tied_rows(spark):
    old = spark.createDataFrame([(1, None, 5, "a"), (2, "x", 7, "b"), (2, "x", 7, "c")],
                                "k int, p string, run_ts int, v string")
    new = spark.createDataFrame([(1, "y", 3, "d", 1), (2, "x", 7, "e", 2)], "k int, p string, run_ts int, v string, extra int")
    got = {(r.k, r.p): (r.v, r.extra) for r in upsert_results(old, new, ["k", "p"]).collect()}
    assert got == {(1, None): ("a", None), (2, "x"): ("e", 2), (1, "y"): ("d", 1)}


def test_cleaning_symbols_are_never_spelled(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\td\n"), (2, ""), (3, "  \n")], "doc_id int, text string")
    merges = bpe.learn_merges(docs, 4)
    for left, right, _ in merges:
        assert all("[" not in x or "[EOL]" in x or "[TAB]" in x for x in (left, right))
    vocab = bpe.vocabulary(bpe.word_counts(docs), merges)
    got = {r.doc_id: r for r in bpe.subword_encode(docs, merges, vocab=vocab).collect()}
    assert "".join(got[1].pieces) == "a[EOL]\nb[EOL]\nc[TAB]d[EOL]\n"
    assert got[2].pieces == [] and got[2].ids == [bpe.BOS, bpe.EOS]
    assert "".join(got[3].pieces) == "  [EOL]\n" and len(got[3].ids) == len(got[3].pieces) + 2


def test_undecodable_bytes_give_null(spark):
    rows = [(1, bytearray("é".encode())), (2, bytearray(b"\xe9")), (3, bytearray(b"\x81\x8d\xff\xe9")),
            (4, bytearray(b"\xff\xfe" + "hé".encode("utf-16-le")))]
    df = spark.createDataFrame(rows, "i int, content binary")
    got = {r.i: r.t for r in df.select("i", decode_bytes(F.col("content")).alias("t")).collect()}
    assert got == {1: "é", 2: "é", 3: None, 4: "hé"}


def test_clusters_by_length_and_unions(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "a", "y"), (4, "b", "y"), (5, "c", "zzz")],
                               "file_id int, author string, text string")
    shared = dedup.cross_author_duplicates(df)
    ranks = {r.length: r.rank for r in dedup.order_clusters_by_length(shared).collect()}
    assert ranks == {1: 0, 2: 1}
    assert sorted(r.file_id for r in dedup.cluster_rows(df, shared).collect()) == [1, 2, 3, 4]
    a, b = (spark.createDataFrame([(i,) for i in x], "file_id int") for x in ([1, 2], [2, 3]))
    assert sorted(r.file_id for r in dedup.union_duplicates(a, b).collect()) == [1, 2, 3]


def test_contents_by_path(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.py").write_bytes(b"x = 1")
    (tmp_path / "u" / "b.py").write_bytes(b"\xe9")
    subs = spark.createDataFrame([("u/a.py",), ("u/b.py",), ("u/c.py",)], "filepath string")
    got = {r.filepath: r.file_content for r in attach_contents(spark, subs, str(tmp_path)).collect()}
    assert got == {"u/a.py": "x = 1", "u/b.py": "é", "u/c.py": None}
    strict = {r.filepath: r.file_content for r in attach_contents(spark, subs, str(tmp_path), strict=True).collect()}
    assert strict["u/b.py"] is None


def test_cluster_file_is_read_in_records(spark, tmp_path):
    f = tmp_path / "dups.txt"
    f.write_text("/d/py/s1.py:1\n/d/py/s2.py:1\n\n/d/py/s3.py:1\n/d/py/s4.py:2\n/d/py/s5.py:3\n")
    rows = dedup.read_duplicate_cluster_text(spark, str(f), "py").collect()
    assert sorted(r.submission_id for r in rows if r.pos > 0) == ["s2", "s4", "s5"]
    assert len({r.cluster for r in rows}) == 2


def test_id_spaces():
    assert L.vocabulary_size("chars") == 99
    assert L.vocabulary_size("tokens", n_reserved=7) == L.KEYWORD_BASE + len(L.CPP_KEYWORDS) + 7
    assert L.vocabulary_size("subwords", subword_vocab=30) == 30


def test_pair_layouts(spark):
    docs = spark.createDataFrame([(1, "ab\nc"), (2, "q")], "doc_id int, text string")
    pairs = spark.createDataFrame([(0, 1, 1, 2)], "sample_id int, label int, file_1 int, file_2 int")
    by_line = materialise_pairs(pairs, docs, "by_line", length=3, max_lines=2).first()
    assert [len(x) for x in by_line.input_1] == [5, 5] and len(by_line.input_2) == 1
    both = materialise_pairs(pairs, docs, "combined", length=1).first()
    assert both.input_1.count(-1) == 1 and both.input_2 is None
    split = materialise_pairs(pairs, docs, "split", length=4).first()
    assert len(split.input_1) == len(split.input_2) == 6
