import pytest

from penprint.llm import decontaminate

ITEM = {
    1: "Tom has 5 apples and gives 3 apples to his sister. After that, Tom counts the apples that he still has "
       "in the basket. How many apples does Tom have?",
    2: "A train leaves the old station at 9:30 and travels 120 km before it stops near a river for a while.",
    3: "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20",
    4: "too short",
}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([*ITEM.items(), (None, None)], "item_id long, text string")


def flagged(make, items, rows, **kw):
    got = decontaminate.find_leaks(make(rows, **kw), items).collect()
    return {(r.doc_id, r.item_id): r for r in got}, got


def test_exact_and_reparameterised(make, items):
    other = ITEM[1].replace("Tom", "Alice").replace("5", "812").replace("3", "7")
    mixed = ITEM[1].replace("5", "6", 1)
    rows = [(1, "Intro text here. " + ITEM[1] + " More words follow."), (2, other), (3, "Nothing to see in this text."),
            (4, ITEM[2].replace("120", "95").replace("9:30", "10:45")), (5, mixed), (6, None), (7, "")]
    got, _ = flagged(make, items, rows, extra=True)
    assert set(got) == {(1, 1), (2, 1), (4, 2), (5, 1)}
    assert got[1, 1].kind == "same" and got[1, 1].coverage > 0.8
    assert got[2, 1].kind == "reparameterised" and got[2, 1].consistency == 1.0
    assert got[4, 2].kind == "reparameterised"


def test_inconsistent_slots_are_no_leak(make, items):
    """The same item value stands for several values: not a re-parameterisation."""
    text = ITEM[1]
    for name in ("Ann", "Bob", "Cid"):
        text = text.replace("Tom", name, 1)
    text = text.replace("5", "7").replace("3", "7")
    got, _ = flagged(make, items, [(1, text)])
    assert got == {}


def test_consistent_place_after_inconsistent_ones(make, items):
    bad = ITEM[1]
    for name in ("Ann", "Bob", "Cid"):
        bad = bad.replace("Tom", name, 1)
    bad = bad.replace("5", "7").replace("3", "7")
    other = ITEM[1].replace("Tom", "Alice").replace("5", "812").replace("3", "7")
    part = ITEM[1][:-30]
    rows = [(1, bad + " " + ITEM[1]), (2, bad + " " + bad + " " + other), (3, bad + " " + bad),
            (4, bad + " Then came. " + part)]
    got, _ = flagged(make, items, rows)
    assert set(got) == {(1, 1), (2, 1), (4, 1)}
    assert got[1, 1].kind == got[4, 1].kind == "same" and got[2, 1].kind == "reparameterised"


SHORT = {
    5: "Which animal lays large eggs?", 6: "What is the capital of France?",
    8: "Which planet is closest to our own sun?", 10: "How many legs does a grown spider have in total?",
}


def test_short_items_after_a_colon_or_heading(make, spark):
    bench = spark.createDataFrame([*SHORT.items()], "item_id long, text string")
    lead = ["", "Question: ", "Some heading\n", 'They asked "', "It ends. "]
    rows = [(100 * k + i, f"{x}{t} Yes.") for k, x in enumerate(lead) for i, t in SHORT.items()]
    rows += [(900, "Question: Berlin planet is closest to our own sun"), (901, "Peter animal lays large eggs"),
             (902, "Question: What animal lays large stones?")]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.find_leaks(make(rows), bench).collect()}
    assert got == {(100 * k + i, i): "same" for k in range(len(lead)) for i in SHORT}


def test_number_lists_and_short_items_match_nothing(make, items):
    got, _ = flagged(make, items, [(1, "9 8 7 6 5 4 3 2 1 10 11 12 13 14 15 16 17"), (2, "too short")])
    assert got == {}


def test_copies_of_dense_items(make, spark):
    table = "Rome 12 km, Oslo 7 km, Bern 15 km, Lima 22 km, Cairo 31 km, Paris 9 km."
    sums = "What is 3 + 4?"
    title = "Anna Karl Berta Dora Emil Franz Gustav Heinrich Ida Julia"
    bench = {3: ITEM[3], 10: table, 11: sums, 12: title}
    frame = spark.createDataFrame([*bench.items()], "item_id long, text string")
    rows = [(100 + i, x + t + " And more.") for i, x in ((0, ""), (1, "Question: ")) for t in bench.values()]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    changed = [table.replace("12", "13").replace("7", "8").replace("15", "16").replace("22", "23").replace("31", "32"),
               "What is 5 + 6?", "Rudolf Siegfried Theodor Ulrich Viktor Wilhelm Xaver Zeppelin Otto Paula",
               "9 8 7 6 5 4 3 2 1 10 11 12 13 14 15 16 17"]
    got = decontaminate.find_leaks(make(rows + [(50 + k, t) for k, t in enumerate(changed)]), frame).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, i) for k, i in enumerate([*bench, *bench])}
    assert {(r.kind, r.consistency) for r in got} == {("same", 1.0)} and all(r.coverage > 0.5 for r in got)


def test_repeated_rows_null_ids_and_long_texts(make, items):
    rows = [(1, ITEM[2]), (1, ITEM[2]), (None, ITEM[2]), (2, "word salad " * 20000 + ITEM[2]), (3, ITEM[2] + " " + ITEM[1])]
    got, all_rows = flagged(make, items, rows)
    assert set(got) == {(1, 2), (None, 2), (2, 2), (3, 2), (3, 1)} and len(all_rows) == 5


def test_empty_tables(make, items, spark):
    assert decontaminate.find_leaks(make([]), items).count() == 0
    assert decontaminate.find_leaks(make([(1, ITEM[1])]), items.limit(0)).count() == 0


def test_large_item_tables_are_not_broadcast(make, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 1)
    got, _ = flagged(make, items, [(1, ITEM[1]), (2, "else")])
    assert set(got) == {(1, 1)}


def test_verbatim_items_of_the_given_tables(spark):
    from tests.conftest import SF001
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if d.text and b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, SF001).collect()}
    assert want and got == want
