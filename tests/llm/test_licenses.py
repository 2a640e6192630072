import re

from penprint.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """Words and the base places of a text by the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), sorted(places), ",".join(sorted(labels))


ROWS = [
    (1, None), (2, ""), (3, "no licence here"), (4, "CC BY"), (5, "cc by cc-by, CC/BY. ccby"),
    (6, "All rights reserved. all RIGHTS reserved all rights"), (7, "GNU General Public License"),
    (8, "general  public\nlicense all rights reserved cc by"), (9, "all all rights rights reserved"),
    (10, "Licensed under the Apache License, Version 2.0."), (11, "the MIT license"),
    (12, "Licensed under CC BY-NC 4.0"), (13, "This work is licensed under the GNU General Public License, version 3."),
    (14, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (15, "all rights reserved " * 3000), (16, "é all rights ré served naïve cc by"), (None, "cc by"), (4, "CC BY"),
    (17, "apache and license"), (18, "license " * 50 + "mit license"), (19, "ALL RIGHTS RESERVEDİ K cc by"),
]


def test_base_places_against_brute_force(make):
    got = licenses.scan_licenses(make(ROWS, extra=True)).collect()
    assert len(got) == len(ROWS)
    want = sorted(((i, *brute(t)) for i, t in ROWS), key=repr)
    have = sorted(((r.doc_id, r.n_words, r) for r in got), key=lambda x: repr((x[0], x[1], x[2].base_labels)))
    assert sorted(((d, n) for d, n, _ in have), key=repr) == sorted(((d, n) for d, n, *_ in want), key=repr)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for i, t in ROWS:
        n, places, labels = brute(t)
        r = by[i]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), labels), i
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None)), i
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_template_labels(make):
    got = {r.doc_id: r for r in licenses.scan_licenses(make(ROWS)).collect()}
    assert got[10].labels == "apache-2.0" and got[12].labels == "cc-by,cc-by-nc-4.0"
    assert "gpl-3.0" in got[13].labels and "gpl" in got[13].labels.split(",")
    assert got[14].labels == "mit" and got[11].labels == "mit"
    assert got[17].labels == "" and got[3].labels == "" and got[3].score == 0
    assert got[18].labels == "mit" and got[15].n_places == 3000


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted."
LINES = {
    "mit": "Released under the MIT license.", "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "Licensed under the GNU General Public License version 3.",
}


def test_bsd_line_hides_no_other_licence(make):
    alone = dict(enumerate(LINES.values()))
    rows = [*alone.items(), (10, BSD), *((20 + i, BSD + " " + t) for i, t in alone.items()),
            (30, " ".join([BSD, *LINES.values()])), (31, " ".join(["x y"] + [*LINES.values(), BSD] * 2))]
    got = {r.doc_id: r for r in licenses.scan_licenses(make(rows)).collect()}
    for i, label in enumerate(LINES):
        assert {label, "bsd"} <= set(got[20 + i].labels.split(",")), label
        assert got[20 + i].n_places == got[10].n_places + got[i].n_places and got[20 + i].score == 1
    assert set(got[30].labels.split(",")) == {"bsd", "gpl", *LINES} == set(got[31].labels.split(","))
    assert got[30].n_places == got[10].n_places + sum(got[i].n_places for i in alone)
    assert got[31].n_places == 2 * got[30].n_places


def test_sql_follows_the_query_on_several_licences(make, spark, tmp_path):
    """The given tables hold one licence a text; here they stand together."""
    import duckdb

    from tests.oracle import compare
    alone = dict(enumerate(LINES.values()))
    rows = [*alone.items(), (10, BSD), *((20 + i, BSD + " " + t) for i, t in alone.items()),
            *((40 + i, t + " x " + BSD) for i, t in alone.items()),
            (30, " ".join([BSD, *LINES.values()])), (31, " ".join(["x y"] + [*LINES.values(), BSD] * 2)), (50, None), (51, "")]
    make(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, said = compare(spark, str(tmp_path), "op1", licenses.op1_license_scan, licenses.OP1_SQL, con)
    assert ok, said


def test_empty_table(make):
    assert licenses.scan_licenses(make([])).count() == 0


def test_no_python_on_the_main_path(make):
    plan = licenses.scan_licenses(make(ROWS))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"))


def test_every_template_holds_its_key():
    for label, text, key in licenses.TEMPLATES:
        assert f" {key} " in f" {text} ", label
